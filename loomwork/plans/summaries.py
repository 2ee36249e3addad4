"""Queries of the relational core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.scalars import band_of_difference, trailing_zeros, utf8_mod
from loomwork.operators import itemsets, relational
from loomwork.sources.readers import parquet


def supplier_nations(spark: SparkSession, sf: str) -> DataFrame:
    nation = parquet(spark, sf, "nation").select("n_nationkey", "n_name")
    return parquet(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_name")


def average_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Average quantity per supplier nation, best first."""
    out = relational.average_per_group(parquet(spark, sf, "lineitem"), supplier_nations(spark, sf), "l_suppkey", "n_name", "l_quantity")
    return out.withColumn("average", F.round("average", 6)).orderBy(F.col("average").desc(), "n_name")


def top_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best averages."""
    return relational.top_k(average_per_group(spark, sf), "average", "n_name")


def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A2, FL1: rows, rows whose date holds a substring, distinct users and types."""
    return relational.review_counts(parquet(spark, sf, "events"), "user_id", "event_type", F.col("ts").cast("string"), "2024-01-1")


def top_users(spark: SparkSession, sf: str) -> DataFrame:
    """A3, T1."""
    return relational.top_k(relational.count_by_key(parquet(spark, sf, "events"), "user_id"), "n", "user_id")


def top_types(spark: SparkSession, sf: str) -> DataFrame:
    return relational.top_k(relational.count_by_key(parquet(spark, sf, "events"), "event_type"), "n", "event_type")


def default_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """How rows lie as they were read."""
    return relational.partition_sizes(parquet(spark, sf, "events"))


def custom_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Dealt by the first character of the key."""
    return relational.partition_sizes(parquet(spark, sf, "events"), 4, F.ascii(F.col("user_id").cast("string")))


def partition_report(spark: SparkSession, sf: str) -> DataFrame:
    """U6, U7, SNK2: both layouts with their times."""
    return relational.partition_report(parquet(spark, sf, "events"), "user_id", 4, F.ascii(F.col("user_id").cast("string")))


def top_k_timing(spark: SparkSession, sf: str) -> DataFrame:
    """A full sort against the top ten."""
    return relational.top_k_timing(relational.count_by_key(parquet(spark, sf, "lineitem"), "l_partkey"), "n", "l_partkey")


def favourite_types(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's most frequent event type."""
    counts = parquet(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return relational.most_frequent_value(counts, "user_id", "event_type", "n")


def dated_baskets(spark: SparkSession, sf: str) -> DataFrame:
    """P3, FL4: baskets keyed by day and user, with more than two kinds of items."""
    events = parquet(spark, sf, "events").withColumn("basket_key", F.concat_ws("-", F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string")))
    return itemsets.baskets(events, "basket_key", "event_type", 2)


def left_with_means(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with their customer's balance; customers that are missing get the mean."""
    customers = parquet(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    orders = parquet(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return relational.with_means(orders, customers, "o_custkey", ["c_acctbal"]).select("o_orderkey", F.round("c_acctbal", 4).alias("balance"))


def lookup_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per part, 0 where there are none."""
    counts = parquet(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return relational.enriched(parquet(spark, sf, "part").select("p_partkey"), counts, "p_partkey", {"n": 0})


def dense_index(spark: SparkSession, sf: str) -> DataFrame:
    """SIM0."""
    return relational.dense_index(parquet(spark, sf, "orders"), "o_custkey")


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """A string as a big integer mod m, trailing zeros, the step function."""
    return parquet(spark, sf, "part").select("p_partkey", utf8_mod(F.col("p_name"), 69_997).alias("name_mod"), trailing_zeros(F.col("p_partkey")).cast("long").alias("zeros"), band_of_difference((F.col("p_size") - 25) / 6).alias("band"))


def json_field(spark: SparkSession, sf: str) -> DataFrame:
    """SRC2: a field of a JSON string, summed by type."""
    events = parquet(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.countDistinct("k").alias("n_k"))


QUERIES = {f.__name__: f for f in (average_per_group, top_groups, review_counts, top_users, top_types, default_partitions, custom_partitions, partition_report, top_k_timing, favourite_types, dated_baskets, left_with_means, lookup_counts, dense_index, scalar_functions, json_field)}

AVERAGE = "SELECT n_name, round(avg(l_quantity), 6) AS average FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"
ORACLES = {
    "average_per_group": AVERAGE,
    "top_groups": f"SELECT * FROM ({AVERAGE}) ORDER BY average DESC, n_name LIMIT 10",
    "review_counts": "SELECT count(*) AS n_review, count(*) FILTER (contains(CAST(ts AS VARCHAR), '2024-01-1')) AS n_review_in, count(DISTINCT user_id) AS n_user, count(DISTINCT event_type) AS n_business FROM events",
    "top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top_types": "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10",
    "custom_partitions": "SELECT CAST(ascii(CAST(user_id AS VARCHAR)) % 4 AS INTEGER) AS partition, count(*) AS n_items FROM events GROUP BY 1",
    "favourite_types": "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1",
    "dated_baskets": """
WITH b AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '-' || CAST(user_id AS VARCHAR) AS basket, event_type AS item FROM events)
SELECT basket, item FROM b WHERE basket IN (SELECT basket FROM b GROUP BY 1 HAVING count(*) > 2)""",
    "left_with_means": "WITH c AS (SELECT * FROM customer WHERE c_custkey % 3 <> 0) SELECT o_orderkey, round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM c)), 4) AS balance FROM orders LEFT JOIN c ON o_custkey = c_custkey",
    "lookup_counts": "SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey",
    "dense_index": "SELECT o_custkey AS value, dense_rank() OVER (ORDER BY o_custkey) - 1 AS index FROM (SELECT DISTINCT o_custkey FROM orders)",
    "scalar_functions": """
WITH RECURSIVE fold(p_partkey, code, i, acc) AS (
  SELECT p_partkey, hex(encode(p_name)), 0, CAST(0 AS BIGINT) FROM part
  UNION ALL
  SELECT p_partkey, code, i + 1, (acc * 256 + CAST(('0x' || substr(code, 2 * i + 1, 2)) AS BIGINT)) % 69997 FROM fold WHERE 2 * i < length(code))
SELECT p.p_partkey, f.acc AS name_mod,
  CAST(CASE WHEN p.p_partkey = 0 THEN 1 ELSE bit_count((p.p_partkey & -p.p_partkey) - 1) END AS BIGINT) AS zeros,
  CAST(CASE WHEN abs(p_size - 25) / 6.0::DOUBLE <= 0.85 THEN 1 WHEN abs(p_size - 25) / 6.0::DOUBLE <= 2 THEN 0.85 WHEN abs(p_size - 25) / 6.0::DOUBLE <= 3 THEN 0.5 WHEN abs(p_size - 25) / 6.0::DOUBLE <= 4 THEN 0.25 ELSE 0 END AS DOUBLE) AS band
FROM part p JOIN fold f ON p.p_partkey = f.p_partkey AND 2 * f.i = length(f.code)""",
    "json_field": "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS sum_k, count(DISTINCT CAST(props->>'$.k' AS BIGINT)) AS n_k FROM events GROUP BY 1",
}
