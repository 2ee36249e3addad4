"""Operator 2, line dedup: lines that too large a share of a site's pages have are dropped from that site's pages.

A page's distinct lines (blank ones aside) are counted per site as 64-bit hashes and divided by the site's pages; a line
on more than ``MAX_RATIO`` of the pages, and on ``MIN_PAGES`` at least, is boilerplate there. A site can have no more such
lines than its lines a page divided by the ratio, so they travel as one array a site: broadcast while their counted number
is below ``BROADCAST_LINES``, else by a join on the site that Spark may split. A page's hashes are intersected with its
site's once, by hashing, and its lines are then looked up among the page's own boilerplate only. DataFrame functions only.

Defined results: null text stays null and has no lines; a null site is a site; blank lines (white space alone) are kept
and never counted; a line twice on a page counts once; a line on exactly the share allowed stays; repeated rows are pages
of their own; a text all of whose lines go is empty; very long texts and lines are taken whole; an empty table gives an
empty result; other columns are passed on by ``deduplicated``, whatever their names, and not read by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import stored, table, unused

MAX_RATIO, MIN_PAGES, BROADCAST_LINES = 0.05, 5, 100_000
#: What a blank line consists of.
BLANK = " \t\n\x0b\x0c\r"


def blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) == ""


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, bad): the hashes of a site's boilerplate lines; only sites that have some."""
    pages = docs.select(F.col(site_col).alias("site"), F.col(text_col).cast("string").alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    lines = F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: ~blank(x)))
    counts = pages.select("site", F.explode(F.transform(lines, lambda x: F.xxhash64(x))).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = totals.select(F.col("site").alias("__site"), "pages")
    over = counts.join(totals, counts.site.eqNullSafe(totals["__site"])).where(F.col("n") > max_ratio * F.col("pages"))
    return over.groupBy("site").agg(F.sort_array(F.collect_set("line")).alias("bad"))


def deduplicated(docs: DataFrame, text_col: str = "text", site_col: str = "source", counts: tuple[str, str] = ("__lines", "__dropped"), **limits: float) -> DataFrame:
    """docs with the boilerplate gone from the text, and how many lines there were and went, in columns named by counts."""
    bad = stored(boilerplate(docs, text_col, site_col, **limits), "boilerplate")
    n = bad.agg(F.sum(F.size("bad"))).first()[0] or 0
    site, own, kept = (unused(name, docs) for name in ("__site", "__bad", "__kept"))
    bad = bad.select(F.col("site").alias(site), F.col("bad").alias(own))
    if n <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    text = F.col(f"`{text_col}`")
    joined = docs.join(bad, F.col(f"`{site_col}`").eqNullSafe(F.col(site)), "left").drop(site)
    lines = F.split(text.cast("string"), "\n", -1)
    joined = joined.withColumn(own, F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), own))
    left = F.filter(lines, lambda x: blank(x) | ~F.array_contains(own, F.xxhash64(x)))
    joined = joined.withColumn(kept, F.when(F.size(own) > 0, left).otherwise(lines))
    number, gone = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(lines) - F.size(kept), F.lit(0))
    whole = F.when(gone > 0, F.array_join(kept, "\n")).otherwise(text)
    columns = [whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, number.alias(counts[0]), gone.alias(counts[1]))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return deduplicated(docs).select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"), "text")


BLANK_SQL = " || ".join(f"chr({ord(c)})" for c in BLANK)
ORACLE_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
held AS (SELECT source, unnest(list_distinct(lines)) AS line FROM pages),
bad AS (
  SELECT h.source, list(h.line) AS bad FROM (SELECT source, line, count(*) AS n FROM held WHERE trim(line, {BLANK_SQL}) <> '' GROUP BY source, line) h
  JOIN totals t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.n >= {MIN_PAGES} AND h.n > {MAX_RATIO}::DOUBLE * t.pages GROUP BY h.source),
kept AS (
  SELECT p.doc_id, p.text, p.lines, CASE WHEN b.bad IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(b.bad, x)) END AS kept
  FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM kept
"""
