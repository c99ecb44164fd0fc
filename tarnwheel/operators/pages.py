"""Which pages are the same page, by their URLs and by the canonical links they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwheel.operators.chains import ends
from tarnwheel.sources.tables import stored

_LINK = r'(?is)<link\b(?=[^>]*\brel\s*=\s*["\']?canonical\b)[^>]*?\bhref\s*=\s*["\']([^"\'>]*)["\']'


def normal_url(url: str | Column) -> Column:
    """A URL in lower case without scheme, ``www.`` or ``m.``, query, fragment and a last slash."""
    path = F.regexp_replace(F.lower(F.trim(url)), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(path, r"^https?://(www\.|m\.)?", ""), r"/$", "")


def canonical_link(html: str | Column) -> Column:
    """The target of the first canonical link of a page; NULL where it has none or an empty one."""
    return F.nullif(F.regexp_extract(html, _LINK, 1), F.lit(""))


def canonical_pages(pages: DataFrame) -> DataFrame:
    """(page_id, canonical, first_id, copies, in_cycle) of every page of (page_id, url, html).

    Pages with the same normal URL are one; of several that state a canonical link the one
    with the smallest page_id counts. ``canonical`` is where these links lead in the end, as
    a normal URL, be it of a page or not; links that go round in a cycle end at its smallest
    URL. ``first_id`` is the smallest page_id of all ``copies`` pages that end there. A link
    that is relative to its page is resolved against the host only if it begins with a slash;
    other relative ones are ignored, as are rows without page_id. A page without URL is alone.
    """
    own = F.coalesce(normal_url("url"), F.concat(F.lit("page:"), F.col("page_id").cast("string")))
    stated = canonical_link("html")
    host = F.split_part(own, F.lit("/"), F.lit(1))
    target = F.when(stated.rlike("(?i)^https?://"), normal_url(stated)).when(
        stated.startswith("/") & ~stated.startswith("//"), normal_url(F.concat(host, stated))
    )
    rows = stored(
        pages.where("page_id is not null").select("page_id", own.alias("node"), target.alias("target")), "canonical-links"
    )
    first = F.min_by("target", F.when(F.col("target").isNotNull(), F.col("page_id"))).alias("target")
    reached = stored(ends(rows.groupBy("node").agg(first)), "canonical-ends")
    named = stored(rows.join(reached, "node").select("page_id", F.col("end").alias("canonical"), "in_cycle"), "canonical-named")
    groups = named.groupBy("canonical").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return named.join(stored(groups, "canonical-groups"), "canonical").select("page_id", "canonical", "first_id", "copies", "in_cycle")
