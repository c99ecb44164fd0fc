"""The registered queries: against DuckDB where there is SQL, else against brute force; and the pipeline by stages."""

import hashlib
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from fixtures import ROWS, documents
from test_dedup import brute_components, brute_fingerprint
from test_near_copies import brute_kept
from test_periodic import brute_row
from test_text_models import brute_lm, brute_targets
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from tarnwheel.llm import bpe, queries
from tarnwheel.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "op1_exact_dedup", "op2_exact_topk", "op3_chat_format", "op4_language_id", "op5_token_counts", "op6_lm_scoring",
    "op7_source_mix", "op8_byte_bpe", "op9_importance_selection", "op10_simhash_near_dedup",
    "op11_document_fingerprints", "op12_periodic_runs",
    "op13_phrase_collocations",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def rows_of(spark, name, *columns):
    df = entry_module.queries()[name](spark, FOLDER)
    return sorted(map(tuple, df.select(*(columns or sorted(df.columns))).collect()))


def test_all_are_registered():
    assert sorted(queries.QUERIES) == sorted(NAMES)
    assert {*NAMES, "pipeline"} <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    picked = ", ".join(f'"{c}"' for c in sorted(df.columns))
    assert rows_of(spark, name) == sorted(duck.execute(f"SELECT {picked} FROM ({queries.ORACLES[name]})").fetchall())


def test_language(spark, texts):
    rows = rows_of(spark, "op4_language_id", "doc_id", "held_out", "lang_pred", "score")
    assert [r[:2] for r in rows] == [(d, zlib.crc32(str(d).encode()) % 3 == 1) for d in sorted(texts)]
    assert all(r[2] in ("en", "fr", "de", "es") and 0 <= r[3] <= 1 for r in rows)


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text in sorted(texts.items()):
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((doc_id, len(text.encode()), n, n > 1024))
    assert rows_of(spark, "op5_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def library_ids(text, made=[]):
    if not made:
        ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
        made.append(tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return made[0].encode_ordinary(text)


def digested(doc_id, text):
    ids = library_ids(text)
    return doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_bpe(spark, texts):
    got = rows_of(spark, "op8_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == [digested(*item) for item in sorted(texts.items())]


def test_near_groups(spark, texts):
    ids = sorted(texts)
    want = brute_components(ids, [brute_fingerprint(texts[i]) for i in ids])
    assert rows_of(spark, "op10_simhash_near_dedup", "doc_id", "fingerprint", "component_id") == want


def test_periodic_runs(spark, texts):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = rows_of(spark, "op12_periodic_runs", *columns)
    assert got == [brute_row(*item) for item in sorted(texts.items())]
    assert sum(r[1] > 0 for r in got) > len(texts) // 20


def test_lm_scoring(spark, duck):
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    good = {r[0] for r in duck.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    got = rows_of(spark, "op6_lm_scoring", "doc_id", "n_tokens", "target_loss", "background_loss")
    for found, want in zip(got, sorted(brute_lm(rows, good)), strict=True):
        assert found[:2] == want[:2] and found[2:] == pytest.approx(want[2:], abs=1e-7)


def test_scores_cover_every_document(spark, texts):
    for name in ("op6_lm_scoring", "op9_importance_selection", "op7_source_mix"):
        assert [r[0] for r in rows_of(spark, name, "doc_id")] == sorted(texts)


def test_pipeline_by_stages(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "byte_bpe":
            assert docs.columns == columns
    source = duck.execute("SELECT doc_id, text, source FROM documents").fetchall()
    # every document is in a known language
    assert sorted(r["doc_id"] for r in kept["language_id"]) == sorted(r[0] for r in source)
    last = {}
    for doc_id, text, _ in sorted(source):
        last[text] = doc_id
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == sorted(last.values())
    texts = {d: t for t, d in last.items()}
    named = brute_kept(texts)
    assert sorted(r["doc_id"] for r in kept["near_dedup"]) == named
    repeats = Counter(r["doc_id"] for r in kept["source_mix"])
    assert set(repeats) <= set(named) and max(repeats.values()) <= 2
    sizes = Counter()
    for r in kept["near_dedup"]:
        sizes[r["source"]] += len(r["text"].split())
    targets = brute_targets(dict(sizes))
    for s in sizes:
        # a source taken whole is taken whole, twice as twice
        if targets[s] == 2 * sizes[s]:
            assert {repeats[r["doc_id"]] for r in kept["near_dedup"] if r["source"] == s} == {2}
    want = sorted(digested(d, texts[d]) for d, n in repeats.items() for _ in range(n))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in kept["byte_bpe"])
    assert got == want
    assert all(r["ids"] == library_ids(texts[r["doc_id"]]) for r in kept["byte_bpe"][:20])


def test_no_task_of_a_stage_runs_two_python_workers(spark, capsys):
    """Each step of a task has a worker of its own, which lives on with all it holds."""
    stage = dict(corpus_pipeline.STAGES)["byte_bpe"]
    stage(spark, documents(spark), FOLDER).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_stages_bear_odd_rows_and_none(spark, tmp_path):
    for rows in (ROWS, []):
        docs = documents(spark, rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER)
            out.write.parquet(f"{tmp_path}/{len(rows)}-{k}")
            docs = spark.read.parquet(f"{tmp_path}/{len(rows)}-{k}")
        assert (docs.count() > 0) == bool(rows)


def test_run(spark):
    ran = corpus_pipeline.run(spark, FOLDER)
    assert ran.count() > 100
