"""Counts, top-k, averages, partitions, enrichment joins and error measures."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.storage import settled


def review_counts(reviews: DataFrame, user: str, business: str, date: Column, part: str) -> DataFrame:
    """n_review, n_review_in (dates that contain ``part``), n_user, n_business: one pass over three columns."""
    return reviews.agg(F.count("*").alias("n_review"), F.count_if(date.contains(part)).alias("n_review_in"), F.countDistinct(user).alias("n_user"), F.countDistinct(business).alias("n_business"))


def count_by_key(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def top_k(df: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """The k rows with the highest value, ties by key: per-partition heaps, no full sort."""
    return df.orderBy(F.col(value).desc(), F.col(key).asc()).limit(k)


def average_per_group(facts: DataFrame, dimension: DataFrame, on: str, group: str, value: str) -> DataFrame:
    """(group, average) over facts that have a group; partial aggregation precedes the shuffle."""
    return facts.join(dimension, on).where(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias("average"))


def partition_sizes(df: DataFrame, n: int | None = None, by: Column | None = None) -> DataFrame:
    """(partition, n_items) of df as it is, or dealt to n partitions by the number ``by`` (mod n)."""
    dealt = df if by is None else df.repartitionById(n, F.pmod(by, F.lit(n)).cast("int"))
    return dealt.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))


def partition_report(df: DataFrame, key: str, n: int, by: Column) -> DataFrame:
    """layout, n_partition, n_items (of each partition that has rows), exe_time: the seconds that the ten most frequent keys
    take on df as it lies and on df dealt by ``by``."""
    rows = []
    for layout, dealt in (("default", df), ("customized", df.repartitionById(n, F.pmod(by, F.lit(n)).cast("int")))):
        sizes = partition_sizes(dealt).orderBy("partition").collect()  # a row for each partition
        rows.append((layout, len(sizes), [r["n_items"] for r in sizes], timed(top_k(count_by_key(dealt, key), "n", key))))
    return df.sparkSession.createDataFrame(rows, "layout string, n_partition int, n_items array<long>, exe_time double")


def timed(df: DataFrame) -> float:
    """Seconds that computing every row takes; nothing is kept."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def top_k_timing(df: DataFrame, value: str, key: str, k: int = 10) -> DataFrame:
    """m1: seconds for a full sort; m2: for the top k by per-partition heaps."""
    full = df.orderBy(F.col(value).desc(), F.col(key).asc())
    return df.sparkSession.createDataFrame([(timed(full), timed(top_k(df, value, key, k)))], "m1 double, m2 double")


def most_frequent_value(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, value) with the highest weight in each group, the least value on ties."""
    return df.groupBy(group).agg(F.min_by(value, F.struct(-F.col(weight), F.col(value))).alias(value))


def enriched(df: DataFrame, dimension: DataFrame, on: str, fills: dict[str, Column | float]) -> DataFrame:
    """Left join; what is missing afterwards, or null in the dimension, becomes the fill."""
    joined = df.join(dimension, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), f if isinstance(f, Column) else F.lit(f)) for c, f in fills.items()})


def with_means(df: DataFrame, dimension: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Left join; missing values become the dimension's mean of the column. All means come from one pass."""
    means = dimension.agg(*[F.avg(c).alias(f"__mean_{c}") for c in columns])
    joined = df.join(dimension.select(on, *columns), on, "left").crossJoin(F.broadcast(means))  # means is one row
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__mean_{c}")) for c in columns}).drop(*[f"__mean_{c}" for c in columns])


def error_measures(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """rmse and the number of pairs."""
    return df.agg(F.sqrt(F.avg(F.pow(F.col(truth) - F.col(prediction), F.lit(2.0)))).alias("rmse"), F.count("*").alias("n"))


def error_histogram(df: DataFrame, truth: str, prediction: str, last: int = 4) -> DataFrame:
    """(bin, n): absolute errors in [0,1), [1,2), ..., from ``last`` on together."""
    bin_ = F.least(F.floor(F.abs(F.col(truth) - F.col(prediction))), F.lit(last)).cast("long")
    return df.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def dense_index(df: DataFrame, column: str, buckets: int = 64) -> DataFrame:
    """(value, index from 0) of the distinct values in order, of any type that sorts. Values are dealt to ranges of about
    equal size; offsets of ranges and places within them are exact, and no window holds more than a range."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    dealt = settled(values.repartitionByRange(buckets, "value").withColumn("bucket", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each bucket
    earlier = dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("value")) - 1
    return dealt.withColumn("place", place).join(F.broadcast(earlier), "bucket").select("value", (F.col("before") + F.col("place")).alias("index"))
