"""Queries of stream sketches and Structured Streaming. The stream: orders by key, batches of 300, the customer as element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.similarity import PRIME
from loomwork.plans.mining import hash_table
from loomwork.sources.readers import parquet, sampled_lines
from loomwork.streaming import sketches, structured

BATCH = 300


def stream(spark: SparkSession, sf: str) -> DataFrame:
    orders = parquet(spark, sf, "orders")
    return orders.select((F.col("o_orderkey") + 1).alias("seq"), F.floor(F.col("o_orderkey") / BATCH).alias("batch"), F.col("o_custkey").alias("key"))


def bloom_filter(spark: SparkSession, sf: str) -> DataFrame:
    """ST2, ST4: elements seen before by any of their bits, by all of them, and in truth."""
    return sketches.bloom_flags(stream(spark, sf))


def bloom_filter_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """ST2, ST4, F7: string elements."""
    names = parquet(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    named = stream(spark, sf).join(names, "key").select("seq", "batch", F.col("c_name").alias("key"))
    return sketches.bloom_flags(sketches.numbered(named))


def false_positive_rates(spark: SparkSession, sf: str) -> DataFrame:
    """ST1, ST3: running rates at the ends of batches."""
    rates = sketches.false_positive_rates(sketches.bloom_flags(stream(spark, sf)))
    return rates.select("batch", F.round("any_rate", 6).alias("any_rate"), F.round("all_rate", 6).alias("all_rate"))


def distinct_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """ST5, A11, A12: textbook form."""
    return sketches.distinct_estimates(stream(spark, sf))


def distinct_estimates_half(spark: SparkSession, sf: str) -> DataFrame:
    """ST5 with four of each eight hashes summed."""
    return sketches.distinct_estimates(stream(spark, sf), used=4)


def reservoir(spark: SparkSession, sf: str) -> DataFrame:
    """ST6."""
    return sketches.reservoir_snapshots(stream(spark, sf))


def sampled_stream(spark: SparkSession, sf: str) -> DataFrame:
    """SRC7: customers drawn with replacement, in batches."""
    customers = parquet(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    return sampled_lines(customers, "key", [100] * 30, customers.count())


def streamed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A file stream through a watermark and daily windows."""
    counts = structured.run_to_end(structured.windowed_counts(structured.event_stream(spark, sf), "event_type"))
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def streamed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A set-form operator over each micro-batch."""
    per_batch = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    return structured.in_batches(structured.event_stream(spark, sf), per_batch).groupBy("event_type").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (bloom_filter, bloom_filter_of_names, false_positive_rates, distinct_estimates, distinct_estimates_half, reservoir, sampled_stream, streamed_counts, streamed_batches)}

STREAM = f"stream AS (SELECT o_orderkey + 1 AS seq, o_orderkey // {BATCH} AS batch, o_custkey AS key FROM orders)"


NAMED = f"""
names(c_custkey, code, i, acc) AS (
  SELECT c_custkey, hex(encode(c_name)), 0, CAST(0 AS BIGINT) FROM customer
  UNION ALL SELECT c_custkey, code, i + 1, (acc * 256 + CAST(('0x' || substr(code, 2 * i + 1, 2)) AS BIGINT)) % {PRIME} FROM names WHERE 2 * i < length(code)),
stream AS (SELECT o_orderkey + 1 AS seq, o_orderkey // {BATCH} AS batch, acc AS key FROM orders JOIN names ON o_custkey = c_custkey AND 2 * i = length(code))"""


def _flags(source: str) -> str:
    return f"""
WITH RECURSIVE {source}, {hash_table(sketches.BLOOM_HASHES)}, cells AS (SELECT seq, batch, key, (a * key + b) % {PRIME} % {sketches.BLOOM_BITS} AS cell FROM stream, h),
f AS (SELECT cell, min(seq) AS first FROM cells GROUP BY 1), n AS (SELECT key, min(seq) AS new_at FROM stream GROUP BY 1),
flags AS (SELECT seq, batch, c.key, bool_or(first < seq) AS seen_any, bool_and(first < seq) AS seen_all, seq = any_value(new_at) AS is_new FROM cells c JOIN f USING (cell) JOIN n ON n.key = c.key GROUP BY 1, 2, 3)"""


FLAGS = _flags(STREAM)


def _estimates(condition: str) -> str:
    return f"""
WITH {STREAM}, {hash_table(sketches.FM_HASHES)}, v AS (SELECT batch, i, (a * key + b) % {PRIME} AS v FROM (SELECT DISTINCT batch, key FROM stream), h),
r AS (SELECT batch, i, max(CASE WHEN v = 0 THEN 1 ELSE bit_count((v & -v) - 1) END) AS r FROM v GROUP BY 1, 2),
m AS (SELECT batch, i // {sketches.FM_GROUP} AS g, sum(CASE WHEN {condition} THEN pow(2.0::DOUBLE, r) ELSE 0 END) / {sketches.FM_GROUP} AS mean FROM r GROUP BY 1, 2),
e AS (SELECT batch, CAST(floor(median(mean)) AS BIGINT) AS estimate FROM m GROUP BY 1)
SELECT s.batch, n_elements, n_distinct, estimate FROM (SELECT batch, count(*) AS n_elements, count(DISTINCT key) AS n_distinct FROM stream GROUP BY 1) s JOIN e ON s.batch = e.batch"""


ORACLES = {
    "bloom_filter": f"{FLAGS} SELECT * FROM flags",
    "bloom_filter_of_names": f"{_flags(NAMED)} SELECT * FROM flags",
    "false_positive_rates": f"""{FLAGS}, o AS (SELECT batch, count(*) AS n, count(*) FILTER (seen_any AND is_new) AS p, count(*) FILTER (seen_all AND is_new) AS q FROM flags GROUP BY 1)
SELECT batch, round((sum(p) OVER w / sum(n) OVER w)::DOUBLE, 6) AS any_rate, round((sum(q) OVER w / sum(n) OVER w)::DOUBLE, 6) AS all_rate FROM o WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)""",
    "distinct_estimates": _estimates("true"),
    "distinct_estimates_half": _estimates(f"i % {sketches.FM_GROUP} < 4"),
    "reservoir": f"""
WITH {STREAM}, d AS (SELECT seq, key, (1664525 * seq + 1013904223) % {PRIME} AS draw, (69069 * seq + 362437) % {PRIME} AS place FROM stream),
t AS (SELECT seq, key, CASE WHEN seq <= {sketches.RESERVOIR} THEN seq - 1 WHEN draw * seq < {sketches.RESERVOIR}::BIGINT * {PRIME} THEN place * {sketches.RESERVOIR} // {PRIME} END AS slot FROM d),
marks AS (SELECT DISTINCT seq // {sketches.SNAPSHOT_EVERY} * {sketches.SNAPSHOT_EVERY} AS seqnum FROM stream WHERE seq >= {sketches.SNAPSHOT_EVERY})
SELECT seqnum, slot, arg_max(key, seq) AS key FROM marks JOIN t ON t.seq <= marks.seqnum WHERE slot IN {sketches.SNAPSHOT_SLOTS} GROUP BY 1, 2""",
    "streamed_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streamed_batches": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
