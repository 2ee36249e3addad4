"""Clustering in rounds by summaries: discard sets (DS), compressed sets (CS), and retained points (RS).

A summary is (cluster, n, total, squares): arrays per dimension. Within a round the summaries stand still: a point goes
to the nearest discard set under ``2 sqrt(d)`` standard deviations, else the nearest compressed set, else it is retained;
then all summaries are updated at once, so the order of points has no effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scalars import distance_from, moments, standardized_distance
from loomwork.operators.graph import connected_components, settled

#: Summaries that travel to every task as one array (some MB at a hundred dimensions); more are joined.
MOST_BROADCAST = 2048
#: Clusters of one k-means, whose model the driver holds; a round that retains more than twice as many points is
#: compressed more coarsely.
MOST_CLUSTERS = 4096
SUMMARY = "cluster long, n long, total array<double>, squares array<double>"


def summaries(points: DataFrame, cluster: str = "cluster", features: str = "features") -> DataFrame:
    """(cluster, n, total, squares) from rows with a cluster and an array; a partial aggregate per (cluster, dimension)."""
    long = points.select(F.col(cluster).alias("cluster"), F.posexplode(features).alias("dim", "x"))
    sums = long.groupBy("cluster", "dim").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("t"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"))
    ordered = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "t", "q"))).alias("s"))
    return ordered.select("cluster", "n", F.transform("s", lambda x: x["t"]).alias("total"), F.transform("s", lambda x: x["q"]).alias("squares"))


def nearest(points: DataFrame, stats: DataFrame, within: float) -> DataFrame:
    """points with the cluster of the nearest summary (the lower number on ties) and the distance, null beyond ``within``.
    Up to ``MOST_BROADCAST`` summaries are one broadcast row, and a point is placed where it lies; more are joined in
    parts that Spark splits."""
    if stats.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        every = stats.select(F.collect_list(F.struct("cluster", moments(F.col("n"), F.col("total"), F.col("squares")).alias("centre"))).alias("every"))
        own = F.transform("every", lambda s: F.struct(distance_from(F.col("features"), s["centre"]).alias("distance"), s["cluster"].alias("cluster")))
        best = points.crossJoin(F.broadcast(every)).withColumn("best", F.array_min(own))  # one row
        near = F.col("best.distance") < within
        return best.select(*[F.col(c) for c in points.columns], F.when(near, F.col("best.cluster")).alias("cluster"), F.when(near, F.col("best.distance")).alias("distance"))
    row = F.struct(standardized_distance(F.col("features"), F.col("n"), F.col("total"), F.col("squares")).alias("distance"), F.col("cluster"))
    best = points.crossJoin(stats).groupBy("id").agg(F.min(row).alias("best")).where(F.col("best.distance") < within)
    return points.join(best.select("id", F.col("best.cluster").alias("cluster"), F.col("best.distance").alias("distance")), "id", "left")


def k_means(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """points with a cluster from 0."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = settled(points.withColumn("__v", array_to_vector(F.col("features").cast("array<double>"))))
    places = points.select("features").distinct()
    if places.limit(k + 1).count() <= max(k, 1):  # at most k different points: each place is a cluster
        numbered = places.withColumn("cluster", F.row_number().over(Window.orderBy("features")).cast("long") - 1)
        return points.join(F.broadcast(numbered), "features")
    if k < 2:
        return points.withColumn("cluster", F.lit(0).cast("long"))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="__c", maxIter=20).fit(data)
    return model.transform(data).withColumn("cluster", F.col("__c").cast("long")).drop("__v", "__c")


def merged(stats: DataFrame) -> DataFrame:
    """Summaries added up by cluster."""
    long = stats.select("cluster", "n", F.posexplode(F.arrays_zip("total", "squares")).alias("dim", "s"))
    sums = long.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s.total").alias("t"), F.sum("s.squares").alias("q"))
    ordered = sums.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "t", "q"))).alias("s"))
    return ordered.select("cluster", "n", F.transform("s", lambda x: x["t"]).alias("total"), F.transform("s", lambda x: x["q"]).alias("squares"))


def merge_close(stats: DataFrame, within: float) -> DataFrame:
    """(cluster, into): clusters whose centres lie within so many deviations of each other go together, transitively."""
    a, b = stats.toDF("a", "n_a", "t_a", "q_a"), stats.toDF("b", "n_b", "t_b", "q_b")
    centre = F.transform("t_b", lambda x: x / F.col("n_b"))
    close = a.join(b, F.col("a") < F.col("b")).where(standardized_distance(centre, F.col("n_a"), F.col("t_a"), F.col("q_a")) < within).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(close)
    return stats.select("cluster").join(found, stats.cluster == found.id, "left").select("cluster", F.coalesce("component", "cluster").alias("into"))


def bfr(points: DataFrame, k: int, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((id, cluster) of every point, -1 if it stays alone; per-round counts) of points (id, features array<double>)."""
    spark = points.sparkSession
    points = settled(points.select("id", F.col("features").cast("array<double>").alias("features"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(rounds)).alias("turn")))
    d = points.select(F.size("features").alias("d")).first()
    within = 2 * (d["d"] if d else 1) ** 0.5
    first = points.where("turn = 0").select("id", "features")
    over = k_means(first, 5 * k, seed)
    alone = over.join(over.groupBy("cluster").agg(F.count("*").alias("m")).where("m = 1"), "cluster", "left_semi").select("id")
    member = settled(k_means(first.join(alone, "id", "left_anti"), k, seed).select("id", "features", "cluster"))
    ds, retained = settled(summaries(member)), settled(first.join(alone, "id"))
    assigned = member.select("id", "cluster")
    cs, cs_member = spark.createDataFrame([], SUMMARY), spark.createDataFrame([], "id long, cluster long")
    counts, next_id = [], 1_000_000

    def compress(retained: DataFrame, cs: DataFrame, cs_member: DataFrame, next_id: int):
        grouped = k_means(retained, min(1 + retained.count() // 2, MOST_CLUSTERS), seed)
        sizes = grouped.groupBy("cluster").agg(F.count("*").alias("m"))
        big = settled(grouped.join(sizes.where("m > 1"), "cluster", "left_semi").withColumn("cluster", F.col("cluster") + next_id))
        left = settled(retained.join(big.select("id"), "id", "left_anti").select("id", "features"))
        return left, settled(cs.unionByName(summaries(big))), settled(cs_member.unionByName(big.select("id", "cluster"))), next_id + 1_000_000

    retained, cs, cs_member, next_id = compress(retained, cs, cs_member, next_id)
    for turn in range(rounds):
        if turn:
            arrived = settled(nearest(points.where(F.col("turn") == turn).select("id", "features"), ds, within))
            taken, rest = arrived.where("cluster is not null"), arrived.where("cluster is null").select("id", "features")
            ds = settled(merged(ds.unionByName(summaries(taken))))
            assigned = assigned.unionByName(taken.select("id", "cluster"))
            near = settled(nearest(rest, cs, within))
            closer = near.where("cluster is not null")
            cs = settled(merged(cs.unionByName(summaries(closer))))
            cs_member = settled(cs_member.unionByName(closer.select("id", "cluster")))
            retained = settled(retained.unionByName(near.where("cluster is null").select("id", "features")))
            retained, cs, cs_member, next_id = compress(retained, cs, cs_member, next_id)
            into = settled(merge_close(cs, within))
            cs = settled(merged(cs.join(into, "cluster").drop("cluster").withColumnRenamed("into", "cluster")))
            cs_member = settled(cs_member.join(into, "cluster").select("id", F.col("into").alias("cluster")))
        if turn == rounds - 1:
            centres = cs.select(F.col("cluster").alias("id"), F.expr("transform(total, x -> x / n)").alias("features"))
            home = settled(nearest(centres, ds, within).where("cluster is not null").select(F.col("id").alias("cs"), F.col("cluster").alias("ds")))
            moved = cs_member.join(home, cs_member.cluster == home.cs)
            assigned = settled(assigned.unionByName(moved.select("id", F.col("ds").alias("cluster"))))
            gone = home.select(F.col("cs").alias("cluster"))
            cs, cs_member = settled(cs.join(gone, "cluster", "left_anti")), settled(cs_member.join(gone, "cluster", "left_anti"))
        counts.append((turn + 1, assigned.count(), cs.count(), cs_member.count(), retained.count()))
    everyone = assigned.unionByName(cs_member).unionByName(retained.select("id", F.lit(-1).cast("long").alias("cluster")))
    return everyone, spark.createDataFrame(counts, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long")
