"""Keyword search and reports over documents and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwheel.operators.pages import canonical_pages as find_canonical
from tarnwheel.operators.rowcounts import count_in_rows
from tarnwheel.operators.search import bm25, tf_idf
from tarnwheel.plans.registry import query
from tarnwheel.sources.tables import load_table, spread


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(load_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')"


@query(
    f"""
    WITH w AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
         t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
         d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
    SELECT doc_id, t.term, tf, df,
           round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / df), 8) AS weight
    FROM t JOIN d ON t.term = d.term
    """
)
def document_tf_idf(spark: SparkSession, folder: str) -> DataFrame:
    weights = tf_idf(_texts(spark, folder))
    return weights.withColumn("weight", F.round("weight", 8))


@query(
    f"""
    WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
         s AS (SELECT doc_id, len(words) AS len, len(list_filter(words, lambda x: x = 'the')) AS tf0,
                      len(list_filter(words, lambda x: x = 'and')) AS tf1 FROM w),
         c AS (SELECT count(*)::DOUBLE AS n, avg(len) AS al, sum((tf0 > 0)::INT)::DOUBLE AS d0,
                      sum((tf1 > 0)::INT)::DOUBLE AS d1 FROM s)
    SELECT doc_id, round(
      CASE WHEN tf0 > 0 THEN ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * tf0 * 2.2
        / (tf0 + 1.2 * (1 - 0.75 + 0.75 * len / al)) ELSE 0 END
      + CASE WHEN tf1 > 0 THEN ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * tf1 * 2.2
        / (tf1 + 1.2 * (1 - 0.75 + 0.75 * len / al)) ELSE 0 END, 8) AS score
    FROM s, c WHERE tf0 > 0 OR tf1 > 0
    """
)
def document_search(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 score of every document for two words."""
    found = bm25(_texts(spark, folder), ["the", "and"])
    return found.select("doc_id", F.round("score", 8).alias("score"))


@query(
    """
    SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS chars,
           min(n_chars) AS shortest, max(n_chars) AS longest
    FROM documents GROUP BY lang, source
    """
)
def document_report(spark: SparkSession, folder: str) -> DataFrame:
    documents = load_table(spark, folder, "documents")
    return documents.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_chars").alias("chars"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
    )


_LINKS = """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages"""


def _hrefs() -> Column:
    return F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))


@query(_LINKS)
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """The link graph as an edge table."""
    return load_table(spark, folder, "pages").select("page_id", F.explode(_hrefs()).alias("href"))


@query(f"SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM ({_LINKS}) GROUP BY href")
def link_targets(spark: SparkSession, folder: str) -> DataFrame:
    """How many links and pages point to each target; links are first counted in each page."""
    per_page = count_in_rows(load_table(spark, folder, "pages"), [], _hrefs(), "href", "n")
    return per_page.groupBy("href").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("pages"))


@query(
    """
    SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS pages,
           CAST(sum(length(html)) AS BIGINT) AS chars
    FROM pages GROUP BY 1
    """
)
def pages_per_host(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and characters per host; URLs that cannot be parsed count under NULL."""
    pages = load_table(spark, folder, "pages")
    return pages.groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars")
    )


_NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(lower(trim({})), '[?#].*$', ''), '^https?://(www\.|m\.)?', ''), '/$', '')"""


@query(
    rf"""
    WITH RECURSIVE
    l AS (SELECT page_id, {_NORMAL.format("url")} AS node,
                 regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']([^"''>]*)["'']', 1) AS href FROM pages),
    t AS (SELECT page_id, node, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN {_NORMAL.format("href")}
                 WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN {_NORMAL.format("split_part(node, '/', 1) || href")} END AS target FROM l),
    p AS (SELECT node, coalesce(arg_min(target, page_id) FILTER (target IS NOT NULL), node) AS target FROM t GROUP BY node),
    w AS (SELECT node, target AS "end", 1 AS depth FROM p
          UNION ALL SELECT w.node, p.target, depth + 1 FROM w JOIN p ON p.node = w."end" WHERE p.target <> w."end" AND depth < 200),
    d AS (SELECT node, max(depth) = 200 AS in_cycle, CASE WHEN max(depth) = 200 THEN min("end") FILTER (depth > 100) ELSE arg_max("end", depth) END AS canonical
          FROM w GROUP BY node),
    n AS (SELECT page_id, canonical, in_cycle FROM t JOIN d USING (node))
    SELECT page_id, canonical, min(page_id) OVER c AS first_id, count(*) OVER c AS copies, in_cycle
    FROM n WINDOW c AS (PARTITION BY canonical)
    """
)
def canonical_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical URL of every page, and how many pages share it."""
    return find_canonical(load_table(spark, folder, "pages"))
