"""Sinks and report formats. Reports are DataFrames of lines in a stated order, written by one last task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_summary(one_row: DataFrame, path: str) -> None:
    one_row.coalesce(1).write.mode("overwrite").json(path)


def csv_table(df: DataFrame, path: str, single_file: bool = True) -> None:
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path, header=True)


def text_report(lines: DataFrame, path: str, order: list[str | Column]) -> None:
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def quoted(items: Column) -> Column:
    """('a', 'b'), and ('a') for one item."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_lines(itemsets: DataFrame, title: str, section: int) -> DataFrame:
    """A title and a line for each size: section, size, line. itemsets has ``items`` (sorted array)."""
    by_size = itemsets.groupBy(F.size("items").alias("size")).agg(F.array_sort(F.collect_list("items")).alias("all"))
    lines = by_size.select(F.lit(section).alias("section"), "size", F.array_join(F.transform("all", quoted), ",").alias("line"))
    head = itemsets.sparkSession.createDataFrame([(section, 0, title)], "section int, size int, line string")
    return head.unionByName(lines)


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> DataFrame:
    return itemset_lines(candidates, "Candidates:", 0).unionByName(itemset_lines(frequent, "Frequent Itemsets:", 1))


def community_lines(communities: DataFrame) -> DataFrame:
    """One line for each community (``members`` sorted): by size, then first member."""
    return communities.select(F.size("members").alias("size"), F.col("members")[0].alias("first"), F.concat(F.lit("'"), F.array_join("members", "', '"), F.lit("'")).alias("line"))


def cluster_report(rounds: DataFrame, points: DataFrame) -> DataFrame:
    """section, nth, line from rounds (round, ds_points, cs_clusters, cs_points, rs_points) and points (id, cluster)."""
    heads = rounds.sparkSession.createDataFrame([(0, -1, "The intermediate results:"), (1, -1, "The clustering results:")], "section int, nth long, line string")
    first = rounds.select(F.lit(0).alias("section"), F.col("round").cast("long").alias("nth"), F.concat(F.lit("Round "), F.col("round").cast("string"), F.lit(": "), F.concat_ws(",", *[F.col(c).cast("string") for c in ("ds_points", "cs_clusters", "cs_points", "rs_points")])).alias("line"))
    second = points.select(F.lit(1).alias("section"), F.col("id").cast("long").alias("nth"), F.concat_ws(",", F.col("id").cast("string"), F.coalesce("cluster", F.lit(-1)).cast("string")).alias("line"))
    return heads.unionByName(first).unionByName(second)
