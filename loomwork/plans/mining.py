"""Queries of similarity joins, frequent itemsets and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import cluster, itemsets, similarity
from loomwork.sources import sinks
from loomwork.sources.readers import parquet

SUPPORT = 0.004


def minhash_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """SIM1: a hundred affine hashes of each supplier's parts."""
    return similarity.minhash(parquet(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").select("l_suppkey", F.col("i").cast("long").alias("i"), "value")


def jaccard_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """SIM1 to SIM5, J5: orders by their parts."""
    return similarity.jaccard_lsh(parquet(spark, sf, "lineitem"), "l_orderkey", "l_partkey").withColumn("similarity", F.round("similarity", 6))


def jaccard_exact(spark: SparkSession, sf: str) -> DataFrame:
    """SIM4 for all pairs, by prefix filtering."""
    return similarity.jaccard_exact(parquet(spark, sf, "lineitem"), "l_orderkey", "l_partkey").withColumn("similarity", F.round("similarity", 6))


def brand_baskets(spark: SparkSession, sf: str, more_than: int = 0) -> DataFrame:
    parts = parquet(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return itemsets.baskets(parquet(spark, sf, "lineitem").join(parts, "l_partkey"), "l_orderkey", "p_brand", more_than)


def support_of(rows: DataFrame) -> int:
    return max(2, -(-rows.select("basket").distinct().count() * 4 // 1000))


def named(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("items", ",").alias("items"), "support")


def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    """FI1 to FI6, FL7: brands bought together by 0.4 % of the orders."""
    rows = brand_baskets(spark, sf)
    return named(itemsets.frequent_itemsets(rows, support_of(rows)))


def frequent_itemsets_strict(spark: SparkSession, sf: str) -> DataFrame:
    """FL4: baskets of more than 3 brands, support above the threshold."""
    rows = brand_baskets(spark, sf, 3)
    return named(itemsets.frequent_itemsets(rows, support_of(rows), strict=True))


def son_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    """FI7, FI8: the two-pass form; the same answer."""
    rows = brand_baskets(spark, sf)
    return named(itemsets.son_itemsets(rows, support_of(rows))[1])


def itemset_report(spark: SparkSession, sf: str) -> DataFrame:
    """SNK5: the report's lines of the strict form's itemsets."""
    rows = brand_baskets(spark, sf, 3)
    found = itemsets.frequent_itemsets(rows, support_of(rows), strict=True)
    return sinks.itemset_lines(found, "Frequent Itemsets:", 1).select("size", "line")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))


def cluster_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """A10, CL3: n, sum and sum of squares of each cluster and dimension."""
    stats = cluster.summaries(points(spark, sf))
    long = stats.select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "s"))
    return long.select("cluster", "n", F.col("dim").cast("long").alias("dim"), F.round("s.total", 4).alias("total"), F.round("s.squares", 4).alias("squares"))


def nearest_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """CL5, J7, F18: all points go to the nearest summary within 2 sqrt(d), -1 beyond."""
    own = points(spark, sf)
    found = cluster.nearest(own.select("id", "features"), cluster.summaries(own), 16.0)
    return found.select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.round(F.coalesce("distance", F.lit(-1.0)), 4).alias("distance"))


def bfr_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """CL1 to CL9: clustering in five rounds."""
    return cluster.bfr(points(spark, sf), 10)[0]


def bfr_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """CL9, SNK7: the report's round lines."""
    found, rounds = cluster.bfr(points(spark, sf), 10, rounds=3)
    return sinks.cluster_report(rounds, found).where("section = 0")


QUERIES = {f.__name__: f for f in (minhash_signatures, jaccard_lsh, jaccard_exact, frequent_itemsets, frequent_itemsets_strict, son_itemsets, itemset_report, cluster_summaries, nearest_summaries, bfr_clusters, bfr_rounds)}


def hash_table(n: int) -> str:
    """h: the coefficients of n hash functions, in SQL."""
    a, b = similarity.coefficient_lists(n)
    return f"h AS (SELECT unnest(range({n})) AS i, unnest({a}) AS a, unnest({b}) AS b)"


PAIRS = """
WITH s AS (SELECT DISTINCT l_orderkey AS item, l_partkey AS member FROM lineitem), n AS (SELECT item, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.item AS id_1, b.item AS id_2, count(*) AS k FROM s a JOIN s b ON a.member = b.member AND a.item < b.item GROUP BY 1, 2)
SELECT id_1, id_2, round(k / (x.n + y.n - k)::DOUBLE, 6) AS similarity FROM c JOIN n x ON id_1 = x.item JOIN n y ON id_2 = y.item WHERE k >= 0.5 * (x.n + y.n - k)"""


def _levels(more_than: int, compare: str) -> str:
    """items, support, size of all itemsets, whatever their size."""
    small = f"WHERE basket IN (SELECT basket FROM b0 GROUP BY 1 HAVING count(*) > {more_than})" if more_than else ""
    return f"""
WITH RECURSIVE b0 AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT * FROM b0 {small}), t AS (SELECT greatest(2, CAST(ceil(count(DISTINCT basket) * 4 / 1000.0) AS BIGINT)) AS s FROM b),
f(basket, items, last, size) AS (
  SELECT basket, item, item, 1 FROM b UNION ALL SELECT f.basket, f.items || ',' || b.item, b.item, f.size + 1 FROM f JOIN b ON f.basket = b.basket AND b.item > f.last)
SELECT items, size, count(*) AS support FROM f GROUP BY 1, 2 HAVING count(*) {compare} (SELECT s FROM t)"""


STATS = "SELECT cluster, dim, count(*) AS n, sum(x) AS t, sum(x * x) AS q FROM (SELECT vec_id AS id, CAST(label AS BIGINT) AS cluster, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2"
ORACLES = {
    "minhash_signatures": f"""
WITH {hash_table(100)}
SELECT l_suppkey, CAST(i AS BIGINT) AS i, CAST(min((a * l_partkey + b) % {similarity.PRIME}) AS BIGINT) AS value FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), h GROUP BY 1, 2""",
    "jaccard_lsh": PAIRS,
    "jaccard_exact": PAIRS,
    "frequent_itemsets": f"SELECT items, support FROM ({_levels(0, '>=')})",
    "frequent_itemsets_strict": f"SELECT items, support FROM ({_levels(3, '>')})",
    "son_itemsets": f"SELECT items, support FROM ({_levels(0, '>=')})",
    "itemset_report": f"""
SELECT CAST(size AS INTEGER) AS size, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY string_split(items, ',')) AS line FROM ({_levels(3, '>')}) GROUP BY size
UNION ALL SELECT 0, 'Frequent Itemsets:'""",
    "cluster_summaries": f"SELECT cluster, n, CAST(dim AS BIGINT) AS dim, round(t, 4) AS total, round(q, 4) AS squares FROM ({STATS})",
    "nearest_summaries": f"""
WITH s AS ({STATS}),
p AS (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
d AS (SELECT id, cluster, sqrt(sum(pow(x - t / n, 2) / CASE WHEN q / n - pow(t / n, 2) > 1e-12 THEN q / n - pow(t / n, 2) ELSE 1 END)) AS distance FROM p JOIN s USING (dim) GROUP BY 1, 2),
b AS (SELECT id, min(distance) AS distance, arg_min(cluster, distance) AS cluster FROM d GROUP BY 1)
SELECT id, CASE WHEN distance < 16 THEN cluster ELSE -1 END AS cluster, round(CASE WHEN distance < 16 THEN distance ELSE -1 END, 4) AS distance FROM b""",
}
