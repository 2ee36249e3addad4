"""Queries of graphs. The graph: suppliers, joined if they share as many parts as the hundredth closest pair or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import graph
from loomwork.sources import sinks
from loomwork.sources.readers import parquet

CLOSEST = 100


def supplier_graph(spark: SparkSession, sf: str) -> DataFrame:
    """G1, J4, FL5."""
    return graph.heaviest(graph.co_occurrence(parquet(spark, sf, "lineitem"), "l_suppkey", "l_partkey"), CLOSEST)


def orders_in_common(spark: SparkSession, sf: str) -> DataFrame:
    """FL5 with a threshold: orders that share two parts or more."""
    return graph.overlapping(parquet(spark, sf, "lineitem"), "l_orderkey", "l_partkey", 2)


def path_credits(spark: SparkSession, sf: str) -> DataFrame:
    """What every node sends up to its parents, for every root."""
    edges = graph.settled(supplier_graph(spark, sf))
    return graph.credits(graph.settled(graph.shortest_paths(edges)), edges).select("root", "parent", "id", F.round("credit", 6).alias("credit"))


def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """G9."""
    return graph.degrees(supplier_graph(spark, sf))


def label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Five synchronous steps, least label on ties."""
    return graph.label_propagation(supplier_graph(spark, sf))


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    """G6."""
    return graph.connected_components(supplier_graph(spark, sf))


def edge_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    """G3 to G5."""
    return graph.edge_betweenness(supplier_graph(spark, sf))


def modularity(spark: SparkSession, sf: str) -> DataFrame:
    """Of the connected components, and their number."""
    edges = graph.settled(supplier_graph(spark, sf))
    parts = graph.settled(graph.connected_components(edges))
    return graph.modularity(edges, edges, parts).select(F.round("q", 6).alias("q"), F.lit(parts.select("component").distinct().count()).cast("long").alias("n"))


def first_split(spark: SparkSession, sf: str) -> DataFrame:
    """G8, one round: the edges that stay when the busiest are gone."""
    edges = graph.settled(supplier_graph(spark, sf))
    return graph.without_busiest(edges, graph.edge_betweenness(edges))


def girvan_newman(spark: SparkSession, sf: str) -> DataFrame:
    """The best split of all rounds, until no edge is left."""
    return graph.girvan_newman(supplier_graph(spark, sf))


def community_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SNK6, A7, T5: a line for each connected component."""
    parts = graph.connected_components(supplier_graph(spark, sf)).withColumn("id", F.col("id").cast("string"))
    return sinks.community_lines(graph.communities(parts)).select(F.col("size").cast("long").alias("size"), "first", "line")


QUERIES = {f.__name__: f for f in (supplier_graph, orders_in_common, path_credits, node_degrees, label_propagation, connected_components, edge_betweenness, modularity, first_split, girvan_newman, community_lines)}

EDGES = f"""
s AS (SELECT DISTINCT l_suppkey AS node, l_partkey AS item FROM lineitem),
w AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM s a JOIN s b ON a.item = b.item AND a.node < b.node GROUP BY 1, 2),
e AS (SELECT src, dst FROM w WHERE weight >= (SELECT min(weight) FROM (SELECT weight FROM w ORDER BY weight DESC LIMIT {CLOSEST}))),
g AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"""


def _propagated(steps: int) -> str:
    out = "l0 AS (SELECT DISTINCT src AS id, src AS label FROM g)"
    for i in range(steps):
        out += f""",
v{i} AS (SELECT g.src AS id, label, count(*) AS n FROM g JOIN l{i} ON g.dst = l{i}.id GROUP BY 1, 2),
l{i + 1} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v{i}) WHERE r = 1)"""
    return out


COMPONENTS = "c AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)"
REACH = "reach(id, root) AS (SELECT DISTINCT src, src FROM g UNION SELECT g.dst, reach.root FROM reach JOIN g ON reach.id = g.src)"
#: Shortest paths level by level; far more levels than the graph's longest shortest path.
LEVELS = 14


def _betweenness() -> str:
    out = "p0 AS MATERIALIZED (SELECT DISTINCT src AS s, src AS u, 0 AS d, 1::BIGINT AS n FROM g), a0 AS MATERIALIZED (SELECT * FROM p0)"
    for i in range(1, LEVELS + 1):
        out += f""",
p{i} AS MATERIALIZED (SELECT p.s, g.dst AS u, {i} AS d, CAST(sum(p.n) AS BIGINT) AS n FROM p{i - 1} p JOIN g ON p.u = g.src WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.s = p.s AND a.u = g.dst) GROUP BY 1, 2),
a{i} AS MATERIALIZED (SELECT * FROM a{i - 1} UNION ALL SELECT * FROM p{i})"""
    return (
        out
        + f""",
b AS (SELECT least(g.src, g.dst) AS src, greatest(g.src, g.dst) AS dst, round(sum(x.n * y.n / z.n::DOUBLE) / 2, 5) AS betweenness
  FROM g JOIN a{LEVELS} x ON x.u = g.src JOIN a{LEVELS} y ON y.s = g.dst JOIN a{LEVELS} z ON z.s = x.s AND z.u = y.u WHERE x.d + 1 + y.d = z.d GROUP BY 1, 2)"""
    )


ORACLES = {
    "supplier_graph": f"WITH {EDGES} SELECT src, dst FROM e",
    "orders_in_common": """
WITH s AS (SELECT DISTINCT l_orderkey AS node, l_partkey AS item FROM lineitem)
SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM s a JOIN s b ON a.item = b.item AND a.node < b.node GROUP BY 1, 2 HAVING count(*) >= 2""",
    "path_credits": f"""WITH {EDGES}, {_betweenness()}
SELECT x.s AS root, g.src AS parent, g.dst AS id, round(sum(x.n * y.n / z.n::DOUBLE), 6) AS credit
  FROM g JOIN a{LEVELS} x ON x.u = g.src JOIN a{LEVELS} y ON y.s = g.dst JOIN a{LEVELS} z ON z.s = x.s AND z.u = y.u WHERE x.d + 1 + y.d = z.d GROUP BY 1, 2, 3""",
    "node_degrees": f"WITH {EDGES} SELECT src AS id, count(*) AS degree FROM g GROUP BY 1",
    "label_propagation": f"WITH {EDGES}, {_propagated(5)} SELECT id, label FROM l5",
    "connected_components": f"WITH RECURSIVE {EDGES}, {REACH}, {COMPONENTS} SELECT id, component FROM c",
    "edge_betweenness": f"WITH {EDGES}, {_betweenness()} SELECT src, dst, betweenness FROM b",
    "modularity": f"""
WITH RECURSIVE {EDGES}, {REACH}, {COMPONENTS}, m AS (SELECT count(*) AS m FROM e),
k AS (SELECT component, count(*) AS k FROM g JOIN c ON g.src = c.id GROUP BY 1),
i AS (SELECT c.component, count(*) AS e FROM e JOIN c ON e.src = c.id JOIN c c2 ON e.dst = c2.id WHERE c.component = c2.component GROUP BY 1)
SELECT round(sum(coalesce(e, 0) / m::DOUBLE - pow(k / (2.0::DOUBLE * m), 2)), 6) AS q, count(*) AS n FROM k LEFT JOIN i USING (component), m""",
    "first_split": f"WITH {EDGES}, {_betweenness()} SELECT src, dst FROM b WHERE betweenness < (SELECT max(betweenness) FROM b)",
    "community_lines": f"""
WITH RECURSIVE {EDGES}, {REACH}, {COMPONENTS}, n AS (SELECT component, list_sort(list(CAST(id AS VARCHAR))) AS ids FROM c GROUP BY 1)
SELECT len(ids)::BIGINT AS size, ids[1] AS first, '''' || array_to_string(ids, ''', ''') || '''' AS line FROM n""",
}
