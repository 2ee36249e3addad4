"""Readers with declared schemas. Malformed records are errors (FAILFAST); headers are dropped by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.sources.workers import shipped

#: The schemas of the inputs.
REVIEW = "review_id string, user_id string, business_id string, stars double, useful long, funny long, cool long, text string, date string"
BUSINESS = "business_id string, city string, stars double, review_count long, is_open long, longitude double, latitude double, categories string, attributes map<string,string>"
USER = "user_id string, review_count long, average_stars double, fans long, useful long, funny long, cool long, compliment_hot long, compliment_note long, compliment_photos long, friends string"
TIP, PHOTO = "user_id string, business_id string, likes long", "business_id string"
RATING, PAIR = "user_id string, business_id string, stars double", "user_id string, business_id string"


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(spark: SparkSession, path: str, header_prefix: str | None = None) -> DataFrame:
    """One column ``value``; lines that begin with header_prefix are dropped wherever they stand."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").startswith(header_prefix)) if header_prefix else lines


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv_table(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=separator, header=header, mode="FAILFAST", enforceSchema=True)


def quoted_csv(spark: SparkSession, path: str, columns: dict[int, tuple[str, str]], width: int) -> DataFrame:
    """Some columns of a quoted CSV by position: {position: (name, type)}; numbers lose leading zeros by the cast."""
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).csv(path, header=True, quote='"', mode="PERMISSIVE")
    return raw.select(*[F.col(f"c{i}").cast(kind).alias(name) for i, (name, kind) in columns.items()])


def numeric_matrix(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """id, label, features from lines of numbers without a header: index, label, then the features."""
    columns = ["id double", "label double", *(f"f{i} double" for i in range(n_features))]
    raw = spark.read.schema(", ".join(columns)).csv(path, mode="FAILFAST")
    return raw.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.array(*[f"f{i}" for i in range(n_features)]).alias("features"))


def sampled_lines(lines: DataFrame, key: str, batch_sizes: list[int], n_keys: int, seed: int = 1) -> DataFrame:
    """A simulated stream: batch, seq and a line drawn with replacement for each place. lines has ``key`` from 0 to n_keys - 1."""
    spark = lines.sparkSession
    edges = [sum(batch_sizes[:i]) for i in range(len(batch_sizes) + 1)]
    batch = F.lit(0)
    for i, e in enumerate(edges[:-1]):
        batch = F.when(F.col("seq") > e, i).otherwise(batch)
    draws = spark.range(1, edges[-1] + 1).select(F.col("id").alias("seq")).withColumn("batch", batch)
    return draws.withColumn(key, F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(n_keys))).join(lines, key)


def in_memory(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
