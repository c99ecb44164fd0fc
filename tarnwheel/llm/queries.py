"""The operators as named queries over a folder of tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.llm import exact_dedup as dedup
from tarnwheel.llm import bpe, chat, fingerprints, importance, langid, lm_scoring, mixing, periodic, phrases, simhash, token_counts, topk_search
from tarnwheel.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY text)
    """
)
def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Group of equal texts of every document; the largest doc_id of a group stays."""
    found = dedup.exact_dedup(load_table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op10_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document; three-word shingles, two bits apart at most."""
    found = simhash.near_groups(load_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _mix_seed(salt: str, *columns: str) -> str:
    parts = " || ':' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"CAST('0x' || substr(md5('{mixing.SEED}:{salt}:' || {parts}), 1, 15) AS BIGINT)"


def _mix_covered(x: str) -> str:
    """Words taken of the first x words of a line, as in ``mixing``."""
    block = f"(({x}) * blocks // words)"
    copies = f"(({block} * quota + first) // blocks)"
    here = f"((({block} + 1) * quota + first) // blocks - {copies})"
    return f"(({copies} * words + {here} * (({x}) * blocks - {block} * words)) // blocks)"


@query(
    f"""
    WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
         s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
               FROM d GROUP BY source),
         w AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
         o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, no) AS k FROM w),
         -- the level if the first k sources stop at twice their size; the true one is the highest
         l AS (SELECT max((1.5 * (SELECT sum(source_size) FROM s) - stopped) / left_over) AS level FROM
                (SELECT coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
                        sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_over FROM o)),
         t AS (SELECT w.*, CASE WHEN 2 * source_size < level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target,
                      least(greatest(CAST(ceil(source_size / {mixing.SHARD_WORDS}) AS BIGINT), 1), {mixing.MAX_SHARDS}) AS shards FROM w, l),
         p AS (SELECT doc_id, size, source_size, target, no, {_mix_seed("shard", "doc_id")} % shards AS shard,
                      {_mix_seed("order", "doc_id")} AS place
               FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
         g AS (SELECT no, shard, CAST(sum(size) AS BIGINT) AS words, any_value(target) AS target FROM p GROUP BY no, shard HAVING sum(size) > 0),
         b AS (SELECT *, greatest(CAST(round(words / {mixing.BLOCK_WORDS}) AS BIGINT), 1) AS blocks FROM g),
         n AS (SELECT no, any_value(target) AS votes FROM b GROUP BY no),
         a AS (SELECT CAST(round(sum(votes) / {mixing.BLOCK_WORDS}) AS BIGINT) AS seats FROM n),
         q AS (SELECT no, row_number() OVER (ORDER BY votes / (2 * j + 1) DESC, no, j) AS r FROM n, a, range(a.seats) x(j)),
         m AS (SELECT no, count(*) AS seats FROM q, a WHERE r <= a.seats GROUP BY no),
         h AS (SELECT no, shard, row_number() OVER (PARTITION BY no ORDER BY words / (2 * j + 1) DESC, shard, j) AS r, m.seats
               FROM b JOIN m USING (no), range(m.seats) x(j)),
         c AS (SELECT no, shard, count(*) AS won FROM h WHERE r <= seats GROUP BY no, shard),
         f AS (SELECT no, shard, words, blocks, least(coalesce(won, 0), 2 * blocks) AS quota,
                      {_mix_seed("start", "no", "shard")} % blocks AS first
               FROM b LEFT JOIN c USING (no, shard)),
         z AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY no, shard ORDER BY place, doc_id, size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
    SELECT doc_id, size, source_size, target,
           CAST(coalesce({_mix_covered("start + size")} - {_mix_covered("start")}, 0) AS BIGINT) AS taken
    FROM z LEFT JOIN f USING (no, shard)
    """
)
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that a mix of the sources by weight takes."""
    return mixing.mix(load_table(spark, folder, "documents"))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = load_table(spark, folder, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(langid.held_out(), F.lit(False)))


@query()
def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.decode(bpe.encode(load_table(spark, folder, "documents"), path), path)
    return coded.select("doc_id", *bpe.digests())


@query()
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of every document."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(load_table(spark, folder, "documents"), path)


_CHAT_ESCAPED = r"""regexp_replace(replace({}, '\', '\\'),
    '([<\[])(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')"""


@query(
    f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
         e AS (SELECT *, '<|im_start|>' || {_CHAT_ESCAPED.format("role")} || '<|im_sep|>' ||
                      {_CHAT_ESCAPED.format("text")} || '<|im_end|>' AS f FROM r),
         t AS (SELECT *, length(f) AS chars, CAST(ceil(strlen(f) / 4) AS BIGINT) AS tokens,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM e),
         s AS (SELECT *, coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS st,
                      coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id), 0) AS sc,
                      CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) - tokens AS BIGINT) AS tok FROM t),
         p AS (SELECT *, greatest(1024 - 256 - st, 128) AS room FROM s),
         o AS (SELECT *, 2 * (tok // room) + CAST((tok + tokens - 1) // room > tok // room AS INT) AS win FROM p),
         w AS (SELECT conv_id, win, min(tok) AS first_tok, sum(chars) AS new_chars, min(nth) AS first_nth, any_value(sc) AS sc
               FROM o GROUP BY conv_id, win),
         h AS (SELECT w.conv_id, w.win, any_value(new_chars) + coalesce(sum(o.chars), 0)
                      + CASE WHEN least(any_value(first_nth), coalesce(min(o.nth), any_value(first_nth))) > 1 THEN any_value(w.sc) ELSE 0 END AS chars
               FROM w LEFT JOIN o ON o.conv_id = w.conv_id AND o.tok < w.first_tok AND o.tok >= w.first_tok - 256
               GROUP BY w.conv_id, w.win),
         f AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM h GROUP BY conv_id),
         d AS (SELECT conv_id, count(*) AS n_turns,
                      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                      coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '') AS target
               FROM r GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256, formatted_chars
    FROM d JOIN f USING (conv_id)
    """
)
def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations as training windows, and digests of what reads back from them."""
    text = "</s>[INST] ok [/INST]"
    rows = load_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(text)
    )
    return chat.digests(chat.windows(rows.union(extra)))


@query(
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
               FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
    """
)
def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector among all others."""
    return topk_search.top_k(load_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is the documents labelled good."""
    good = load_table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return lm_scoring.lm_scores(load_table(spark, folder, "documents"), good)


@query()
def op9_importance_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weight of every document and which four fifths a sample takes; the target is labelled good, not toxic."""
    good = load_table(spark, folder, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return importance.importance(load_table(spark, folder, "documents"), good)


def _lane(word: int, bit: int) -> str:
    return f"sum((w{word} >> {bit}) & 1)"


_WORDS_SQL = ", ".join(f"CAST('0x' || substr(h, {8 * j + 1}, 8) AS BIGINT) AS w{j}" for j in range(fingerprints.WORDS))
_HEAD_SQL = ", ".join(["count(*)", *[f"sum(w{j}) % 4294967296" for j in range(fingerprints.WORDS)]])
# the high half of a pair of lanes is printed first
_LANES_SQL = ", ".join(_lane(k + j, bit) for k in range(fingerprints.HALF) for bit in range(32) for j in (fingerprints.HALF, 0))


def _apart_sql(one: str, other: str) -> str:
    lanes = f"list_zip({one}.lanes, {other}.lanes)"
    return f"list_sum(list_transform({lanes}, lambda z: CAST(2 * (z[1] - z[2]) - ({one}.head[1] - {other}.head[1]) AS DOUBLE) ** 2))"


def _likeness_sql(one: str, other: str) -> str:
    whole = f"({_apart_sql(one, 'nil')} + {_apart_sql(other, 'nil')})"
    return f"CASE WHEN {whole} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - {_apart_sql(one, other)} / {whole}) END"


def _printed_sql(v: str) -> str:
    return f"list_aggregate(list_transform(list_concat({v}.head, {v}.lanes), lambda x: format('{{:08x}}', x)), 'string_agg', '')"


@query(
    rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
         o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM t),
         e AS (SELECT *, substr(text, 1, n - n // 2) || substr(next, 1, n // 2) AS edited FROM o),
         b AS (SELECT text AS body FROM e UNION SELECT edited FROM e),
         u AS (SELECT body, unnest(regexp_extract_all(body, '{fingerprints.PARAGRAPH}')) AS p FROM b),
         h AS (SELECT body, sha256(p) AS h FROM u),
         w AS (SELECT body, {_WORDS_SQL} FROM h),
         nil AS (SELECT list_transform(range({1 + fingerprints.WORDS}), lambda x: 0::BIGINT) AS head,
                        list_transform(range({fingerprints.LANES}), lambda x: 0::BIGINT) AS lanes),
         g AS (SELECT body, CAST([{_HEAD_SQL}] AS BIGINT[]) AS head, CAST([{_LANES_SQL}] AS BIGINT[]) AS lanes FROM w GROUP BY body),
         v AS (SELECT b.body, coalesce(g.head, nil.head) AS head, coalesce(g.lanes, nil.lanes) AS lanes
               FROM b LEFT JOIN g ON g.body = b.body, nil)
    SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, {_printed_sql("a")} AS fingerprint, {_printed_sql("c")} AS edited_fingerprint,
           {_likeness_sql("a", "c")} AS near_edited, {_likeness_sql("a", "d")} AS near_next
    FROM e JOIN v a ON a.body = text JOIN v c ON c.body = edited JOIN v d ON d.body = next, nil
    """
)
def op11_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document as a multiset of paragraphs, before and after an edit, and what it shares."""
    return fingerprints.fingerprints(load_table(spark, folder, "documents"))


def planted_period(doc_id: Column, text: Column) -> Column:
    """The text, of which one document in ten repeats some of its words to its end; by a hash of doc_id."""
    drawn = F.crc32(doc_id.cast("string"))
    tenth = F.floor(drawn / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        start = F.pmod(tenth, n)
        period = 1 + F.floor((n - start) / (3 + tenth % 8))
        repeated = F.transform(
            words, lambda word, i: F.when(i < start, word).otherwise(F.get(words, (start + (i - start) % period).cast("int")))
        )
        return F.when(n > 0, F.array_join(repeated, " "))

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # as an item of an array the text is split once
    changed = F.get(F.transform(F.array(words), planted), 0)
    return F.coalesce(F.when(drawn % 10 == 0, changed), text)


@query()
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of twelve words or more in every document, and the text without what they repeat."""
    text = planted_period(F.col("doc_id").cast("long"), F.col("text"))
    found = periodic.periodic_runs(load_table(spark, folder, "documents"), text=text)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.floor(1000 * F.col("longest.length") / (-F.col("longest.p"))).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
               FROM documents WHERE text IS NOT NULL),
         p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
         w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
         g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
               FROM w, range(1, 4) x(k) WHERE len(ws) >= k),
         c AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
         t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
         m AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= {phrases.LEAST}),
         u AS (SELECT lang, phrase, k, f AS a, j, array_to_string(ws[1:j], ' ') AS one, array_to_string(ws[j + 1:], ' ') AS other
               FROM m, range(1, 3) x(j) WHERE j < k),
         s AS (SELECT u.*, o.f AS l, h.f AS r, CAST((1000000::HUGEINT * a * a) // (o.f::HUGEINT * h.f) AS BIGINT) AS score
               FROM u JOIN c o ON o.lang = u.lang AND o.phrase = one JOIN c h ON h.lang = u.lang AND h.phrase = other),
         b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
         i AS (SELECT lang, array_to_string(ws[x:x + 1], ' ') AS phrase, max(f) AS f FROM m, range(1, 3) r(x) WHERE k = 3 GROUP BY ALL),
         z AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
               WHERE k = 3 OR i.f IS NULL OR 100 * i.f < {phrases.SUBSUMED} * a),
         q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
    SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= {phrases.TOP}
    """
)
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2,000 phrases of two or three words of each language that keep together most."""
    return phrases.collocations(load_table(spark, folder, "documents"))
