"""Graphs as edge tables (src, dst) with src < dst: co-occurrence, degrees, label propagation, components, shortest-path
betweenness, modularity, and splitting by removal of the edges of highest betweenness.

Iterative operators are driver loops that build plans; each iteration ends in a table in spark.checkpoint.dir, so
lineage stays short, nothing is computed twice, and a lost executor costs one iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.storage import settled, stored


def memberships(rows: DataFrame, node: str, item: str) -> DataFrame:
    return rows.select(F.col(node).alias("node"), F.col(item).alias("item")).where("node is not null and item is not null").distinct()


def co_occurrence(rows: DataFrame, node: str, item: str) -> DataFrame:
    """(src, dst, weight): how many items two nodes share. An equi-join on the item, not a product of nodes."""
    rows = memberships(rows, node, item)
    return rows.toDF("src", "item").join(rows.toDF("dst", "item"), "item").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


#: Items up to which all pairs of a node's items are formed; pairs of nodes whose ids are broadcast.
MOST_PAIRED, MOST_BROADCAST = 32, 500_000


def overlapping(rows: DataFrame, node: str, item: str, least: int) -> DataFrame:
    """(src, dst, weight) of the pairs of nodes that share ``least`` items or more. Such a pair shares two among the rarest
    n - least + 2 of each one's n items, and one among the rarest n - least + 1. Nodes of up to MOST_PAIRED items meet in
    pairs of items, so that hardly any two meet that do not share as many; a larger one meets others in single rare items.
    Weights are then counted over all items of the nodes that met."""
    if least < 2:
        return co_occurrence(rows, node, item)
    rows = rows.select(F.col(node).alias("node"), F.col(item).alias("item")).where("node is not null and item is not null").repartition("node").distinct()
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("node"))).where(F.col("n") >= least)
    # One row for a small node; a large one keeps a row for each item. All in the one shuffle by node.
    sets = stored(rows.groupBy("node", "n", F.when(F.col("n") > MOST_PAIRED, F.col("item")).alias("part")).agg(F.collect_list("item").alias("items")).drop("part"), "sets")
    every = sets.select("node", "n", F.explode("items").alias("item"))
    small, alone = F.col("n") <= MOST_PAIRED, sets.where(F.col("n") > MOST_PAIRED).isEmpty()
    prefixes = sets.where(small).select("node", "items")
    if least > 2 or not alone:
        often = every.groupBy("item").agg(F.count("*").alias("often"))
        ranked = every.join(often, "item").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("often", "item")))
    if least > 2:
        prefixes = ranked.where(small & (F.col("rank") <= F.col("n") - (least - 2))).groupBy("node").agg(F.collect_list("item").alias("items"))
    met = met_in_two(prefixes)
    if not alone:
        rare = ranked.where(F.col("rank") <= F.col("n") - (least - 1)).select("node", "item", "n")
        large = rare.where(~small).select(F.col("node").alias("x"), "item")
        others = rare.select(F.col("node").alias("y"), "item", small.alias("small")).join(large, "item").where("small or x < y")
        met = met.unionByName(others.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct())
    met = stored(met, "met")
    if met.count() <= MOST_BROADCAST:
        ids = met.select(F.col("src").alias("node")).union(met.select("dst")).distinct()
        every = every.join(F.broadcast(ids), "node", "left_semi")
    counted = met.join(every.select(F.col("node").alias("src"), "item"), "src").join(every.select(F.col("node").alias("dst"), "item"), ["dst", "item"])
    return counted.groupBy("src", "dst").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def met_in_two(sets: DataFrame) -> DataFrame:
    """(src, dst), src < dst, of the nodes of (node, items) that share two items. What is shuffled are the pairs of one
    node's items, by a hash; the pairs of nodes that share but one are never formed."""
    ordered = sets.select("node", F.sort_array("items").alias("items"))
    firsts = ordered.select("node", "items", F.posexplode("items").alias("at", "p"))
    pairs = firsts.select("node", "p", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("q"))
    keyed = pairs.select(F.xxhash64("p", "q").alias("key"), "node")
    return keyed.toDF("key", "src").join(keyed.toDF("key", "dst"), "key").where("src < dst").select("src", "dst").distinct()


def heaviest(weighted: DataFrame, n: int) -> DataFrame:
    """The edges that weigh as much as the n-th heaviest, or more."""
    least = weighted.orderBy(F.col("weight").desc()).limit(n).agg(F.min("weight").alias("least"))
    return weighted.join(F.broadcast(least), F.col("weight") >= F.col("least")).select("src", "dst")  # least is one row


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def label_propagation(edges: DataFrame, steps: int = 5) -> DataFrame:
    """(id, label) after synchronous steps: each node takes its neighbours' most frequent label, the least on ties."""
    pairs = settled(both_ways(edges))
    labels = pairs.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(steps):
        votes = pairs.join(labels, pairs.dst == labels.id).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
        labels = settled(votes.groupBy(F.col("src").alias("id")).agg(best.alias("label")))
    return labels


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reachable. Least labels travel along edges and jump to their own label's
    label, so the number of steps is about the logarithm of the longest path."""
    pairs = settled(both_ways(edges))
    labels = pairs.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    while True:
        seen = pairs.join(labels, pairs.dst == labels.id).groupBy("src").agg(F.min("component").alias("least"))
        near = labels.join(seen, labels.id == seen.src).select("id", "component", F.least("component", "least").alias("next"))
        jump = labels.toDF("at", "further")
        now = settled(near.join(jump, near.next == jump["at"]).select("id", F.col("component").alias("before"), F.least("next", "further").alias("component")))
        if now.where("before != component").isEmpty():
            return now.select("id", "component")
        labels = now.select("id", "component")


def shortest_paths(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(root, id, distance, paths): how many shortest paths there are; level by level, visited pairs anti-joined."""
    pairs = settled(both_ways(edges))
    level = settled(pairs.select(F.col("src").alias("root")).distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.lit(1).cast("long").alias("paths")))
    seen, step = level, 0
    while longest is None or step < longest:
        step += 1
        reached = level.join(pairs, level.id == pairs.src).groupBy("root", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = settled(reached.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(step).alias("distance"), "paths"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def credits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, parent, id, credit) of each edge of each root's shortest-path tree: a node has a credit of 1 and what its
    children send up, and sends it to its parents by their numbers of shortest paths. Level by level from the deepest, so
    each edge is joined once a root."""
    pairs = both_ways(edges).toDF("id", "parent")
    deepest = paths.agg(F.max("distance")).first()[0] or 0
    sent = None
    out = paths.sparkSession.createDataFrame([], paths.select("root", F.col("id").alias("parent"), "id", F.lit(0.0).alias("credit")).schema)
    for level in range(deepest, 0, -1):
        nodes = paths.where(F.col("distance") == level).select("root", "id", "paths")
        if sent is None:
            nodes = nodes.withColumn("own", F.lit(1.0))
        else:
            nodes = nodes.join(sent, ["root", "id"], "left").select("root", "id", "paths", (1 + F.coalesce("flow", F.lit(0.0))).alias("own"))
        above = paths.where(F.col("distance") == level - 1).select("root", F.col("id").alias("parent"), F.col("paths").alias("parent_paths"))
        up = nodes.join(pairs, "id").join(above, ["root", "parent"])
        up = settled(up.select("root", "parent", "id", (F.col("own") * F.col("parent_paths") / F.col("paths")).alias("credit")))
        sent = up.groupBy("root", F.col("parent").alias("id")).agg(F.sum("credit").alias("flow"))
        out = up if level == deepest else out.unionByName(up)
    return out


def edge_betweenness(edges: DataFrame, digits: int = 5) -> DataFrame:
    """(src, dst, betweenness): for all pairs of nodes, the share of their shortest paths through the edge. Every node is a
    root once, so a pair counts from both its ends, and the sum is halved."""
    edges = settled(edges.select("src", "dst"))
    summed = credits(settled(shortest_paths(edges)), edges).groupBy(F.least("parent", "id").alias("src"), F.greatest("parent", "id").alias("dst")).agg(F.sum("credit").alias("b"))
    return summed.select("src", "dst", F.round(F.col("b") / 2, digits).alias("betweenness"))


def modularity(now: DataFrame, original: DataFrame, component: DataFrame) -> DataFrame:
    """One row, q: edges that exist now within communities, degrees and edge count of the original graph."""
    m = original.agg(F.count("*").alias("m"))
    k = degrees(original).join(component, "id", "right").groupBy("component").agg(F.sum(F.coalesce("degree", F.lit(0))).alias("k"))
    inside = now.join(component.toDF("src", "c1"), "src").join(component.toDF("dst", "c2"), "dst").where("c1 = c2").groupBy(F.col("c1").alias("component")).agg(F.count("*").alias("e"))
    parts = k.join(inside, "component", "left").crossJoin(F.broadcast(m))  # m is one row
    return parts.agg(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), F.lit(2.0))).alias("q"))


def without_busiest(edges: DataFrame, betweenness: DataFrame) -> DataFrame:
    """edges but all those tied at the highest (rounded) betweenness."""
    top = betweenness.agg(F.max("betweenness").alias("top"))
    busiest = betweenness.join(F.broadcast(top), F.col("betweenness") == F.col("top")).select("src", "dst")  # top is one row
    return edges.join(busiest, ["src", "dst"], "left_anti")


def components_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node, also of those that have no edge left."""
    return nodes.join(connected_components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def girvan_newman(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(id, component, q, round) of the first split with the highest modularity, round 0 being the graph as it is. Each round
    removes the busiest edges; it costs one all-pairs shortest-path computation, so this is for graphs whose node pairs fit
    the cluster."""
    original = settled(edges.select("src", "dst"))
    nodes = settled(degrees(original).select("id"))
    if original.isEmpty():
        return nodes.select("id", F.col("id").alias("component"), F.lit(None).cast("double").alias("q"), F.lit(0).alias("round"))
    parts = settled(components_of(nodes, original))
    best = (modularity(original, original, parts).first()["q"], parts, 0)
    now, turn = original, 0
    while not now.isEmpty() and (most_rounds is None or turn < most_rounds):
        turn += 1
        now = settled(without_busiest(now, edge_betweenness(now)))
        parts = settled(components_of(nodes, now))
        q = modularity(now, original, parts).first()["q"]
        if q > best[0]:
            best = (q, parts, turn)
    return best[1].select("id", "component", F.lit(best[0]).alias("q"), F.lit(best[2]).alias("round"))


def communities(components: DataFrame) -> DataFrame:
    """(component, members sorted)."""
    return components.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))
