"""Queries that compare the texts of documents with each other and with a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.operators import contamination, lines, redaction
from tarnwheel.operators.similar_sets import Similar, similar_texts
from tarnwheel.plans.registry import query
from tarnwheel.sources.tables import load_table, stored

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"

_CLASSES = f"""
    t AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    c AS (SELECT ws, min(doc_id) AS class_id, count(*) AS class_size FROM t GROUP BY ws),
    s AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(ws) < 5 THEN list_filter([array_to_string(ws, ' ')], lambda w: w <> '')
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM c),
    n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
    m AS (SELECT one.class_id AS a, other.class_id AS b, count(*) AS common
          FROM s one JOIN s other ON one.g = other.g AND one.class_id < other.class_id GROUP BY ALL),
    p AS (SELECT a, b, x.n AS size_a, y.n AS size_b, common FROM m JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b
          WHERE common * 9 >= 4 * (x.n + y.n))
    """


def _similar(spark: SparkSession, folder: str) -> Similar:
    return similar_texts(load_table(spark, folder, "documents").select("doc_id", "text"))


@query(f"WITH {_CLASSES} SELECT *, common / (size_a + size_b - common) AS jaccard FROM p")
def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different texts with a Jaccard of 0.8 or more of their five-word shingles, by the smallest doc_id of each."""
    pairs = _similar(spark, folder).pairs
    return pairs.withColumn("jaccard", F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")))


@query(
    f"""
    WITH {_CLASSES}, l AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p UNION ALL SELECT b FROM p) GROUP BY id)
    SELECT doc_id, c.class_id, class_size, coalesce(links, 0) AS links
    FROM t JOIN c ON c.ws = t.ws LEFT JOIN l ON l.id = c.class_id
    """
)
def near_dup_links(spark: SparkSession, folder: str) -> DataFrame:
    """The class of equal words of every document, and to how many other classes it is similar."""
    found = _similar(spark, folder)
    ends = found.pairs.select(F.explode(F.array("a", "b")).alias("id"))
    links = stored(ends.groupBy("id").agg(F.count(F.lit(1)).alias("links")), "near-dup-links")
    counted = found.members.join(links.withColumnRenamed("id", "class_id"), "class_id", "left")
    return counted.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


_SPANS = f"""
    t AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    k AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g
          FROM (SELECT {_WORDS} AS ws FROM benchmark) WHERE len(ws) >= 8),
    x AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 7)) AS place FROM t WHERE len(ws) >= 8),
    h AS (SELECT DISTINCT doc_id, place FROM x JOIN k ON k.g = array_to_string(ws[place + 1:place + 8], ' ')),
    f AS (SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 8 THEN 0 ELSE 1 END AS begins FROM h),
    s AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM f),
    p AS (SELECT doc_id, min(place) AS start, max(place) - min(place) + 8 AS n_words, count(*) AS hits FROM s GROUP BY doc_id, span)
    """


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    hits = contamination.ngram_hits(load_table(spark, folder, "documents"), load_table(spark, folder, "benchmark"))
    return contamination.covered_spans(hits)


@query(f"WITH {_SPANS} SELECT * FROM p")
def contaminated_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of documents made of eight words in a row, or more, that also stand in the benchmark."""
    return _spans(spark, folder)


@query(
    f"""
    WITH {_SPANS}, c AS (SELECT doc_id, CAST(sum(n_words) AS BIGINT) AS covered, count(*) AS n_spans FROM p GROUP BY doc_id)
    SELECT doc_id, len(ws) AS n_words, coalesce(covered, 0) AS covered, coalesce(n_spans, 0) AS n_spans, covered IS NULL AS clean
    FROM t LEFT JOIN c USING (doc_id)
    """
)
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every document the benchmark covers; clean ones have no eight words in a row in common with it."""
    found = contamination.coverage(load_table(spark, folder, "documents"), _spans(spark, folder))
    return found.withColumn("clean", F.col("n_spans") == 0)


@query(
    """
    SELECT line, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line HAVING count(*) > 5
    """
)
def boilerplate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that occur more than five times in the documents."""
    return lines.frequent_lines(load_table(spark, folder, "documents"), 5)


_LINES = """
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
    """


def _lines_sql(partition: str, order: str) -> str:
    return f"""
    WITH {_LINES}, f AS (SELECT *, line = '' OR row_number() OVER (PARTITION BY {partition} ORDER BY {order}) = 1 AS stays FROM l)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '') AS text, count(*) FILTER (NOT stays) AS dropped
    FROM f GROUP BY doc_id
    """


@query(_lines_sql("doc_id, line", "place"))
def dedup_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with each of its lines only once, where it first stands."""
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    n_lines = F.size(lines.lines("text"))
    kept = lines.without_repeated_lines(docs.withColumn("before", n_lines))
    return kept.select("doc_id", "text", (F.col("before") - n_lines).cast("long").alias("dropped"))


@query(_lines_sql("line", "doc_id, place"))
def dedup_corpus_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with only those lines that no earlier document, and no earlier place in it, has."""
    return lines.without_corpus_repeats(load_table(spark, folder, "documents").select("doc_id", "text"))


# boundaries of words are those of ASCII here, too
_PII_PATTERNS = {
    "EMAIL": r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.]+",
    "CARD": r"\b(?:[0-9][ -]?){15}[0-9]\b",
    "PHONE": r"\+[0-9][0-9 ()-]{7,}[0-9]",
    "IP": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
}
_LUHN = "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0".format(
    d="CAST(regexp_replace(x, '[ -]', '', 'g')[i] AS INT)"
)
_PII_VALID = {"CARD": _LUHN, "IP": "len(list_filter(string_split(x, '.'), lambda o: CAST(o AS INT) > 255)) = 0"}


def _covered_sql() -> str:
    """Texts with spans written over, one kind after the other, as in ``redaction``."""
    steps = [f"c0 AS (SELECT doc_id, regexp_replace(text, '{redaction.ALL_BLOCKS}', chr(65533), 'g') AS t FROM documents)"]
    ascii_sql = redaction.ASCII.replace("'", "''")
    for number, (name, pattern) in enumerate(_PII_PATTERNS.items()):
        first, rest = redaction.blocks(number)
        over = f"translate(x[1], '{ascii_sql}', '{first}') || translate(x[2:], '{ascii_sql}', '{rest}')"
        if name in _PII_VALID:
            over = f"CASE WHEN {_PII_VALID[name]} THEN {over} ELSE x END"
        steps.append(
            f"s{number} AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, list_transform(regexp_extract_all(t, '{pattern}'), lambda x: {over}) AS f FROM c{number})"
        )
        joined = "array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(f[i], '')), '')"
        steps.append(f"c{number + 1} AS (SELECT doc_id, {joined} AS t FROM s{number})")
    return ", ".join(steps)


def _pii_span(number: int) -> str:
    start = redaction.BLOCK + 2 * number * redaction.BLOCK_SIZE
    return rf"[\x{{{start:x}}}-\x{{{start + 255:x}}}][\x{{{start + 256:x}}}-\x{{{start + 511:x}}}]*"


_REDACTED_SQL, _SPANS_SQL = "t", []
for _number, _name in enumerate(_PII_PATTERNS):
    _REDACTED_SQL = f"regexp_replace({_REDACTED_SQL}, '{_pii_span(_number)}', '[{_name}]', 'g')"
    _SPANS_SQL.append(f"len(regexp_extract_all(t, '{_pii_span(_number)}'))")
_PIECES = "|".join([*map(_pii_span, range(len(_PII_PATTERNS))), redaction.ALL_BLOCKS.replace("[", "[^", 1) + "+"])


@query(f"WITH {_covered_sql()} SELECT doc_id, {_REDACTED_SQL} AS text, CAST({' + '.join(_SPANS_SQL)} AS BIGINT) AS n_spans FROM c{len(_PII_PATTERNS)}")
def redact_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with e-mail addresses, card and phone numbers and IP addresses redacted."""
    return redaction.redact(load_table(spark, folder, "documents").select("doc_id", "text"))


@query(
    f"""
    WITH {_covered_sql()},
         p AS (SELECT doc_id, regexp_extract_all(t, '{_PIECES}') AS ps FROM c{len(_PII_PATTERNS)}),
         u AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS nth FROM p),
         o AS (SELECT *, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
                      (unicode(piece) - {redaction.BLOCK}) // {2 * redaction.BLOCK_SIZE} AS number FROM u)
    SELECT doc_id, {list(_PII_PATTERNS)}[number + 1] AS kind, start, length(piece) AS length,
           array_to_string(list_transform(range(1, length(piece) + 1), lambda i: chr(CAST(unicode(piece[i]) % 256 AS INT))), '') AS found
    FROM o WHERE number >= 0 AND number < {len(_PII_PATTERNS)}
    """
)
def pii_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where personal data stands in the documents, which undoes the redaction."""
    return redaction.spans(load_table(spark, folder, "documents").select("doc_id", "text"))
