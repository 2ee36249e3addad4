"""Operator 9, exact top-k by inner product: branch and bound in a ball tree per shard.

Vectors are dealt to shards, and each shard's ball tree (median splits along the direction from the centre to its
farthest point) is built once and stored as the order of its points. Stated queries are dealt to blocks; a task holds one
shard and one block. A node bounds the inner product of a query with all its points by q.c + |q| r. Queries go down level
by level, dropping nodes whose bound is below the query's current kth score, and then take their leaves in the order of
their bounds, in waves that double, so that each wave's scores prune the next. The kth score is shared beyond the shard:
shards are searched in rounds that double, and every round starts from the kth scores of all rounds before it.

Bounds are rounded up and kth scores down, and nodes that can tie are searched, so ties go to the smaller id as they
should. Components are whole numbers, multiplied as doubles where every score is exact in one, else as 64-bit integers,
else as integers of any size; vectors with a component of ``WIDE`` or more have shards and blocks of their own, so that
they slow down no others.

Defined results: vectors that are null or hold a null or non-finite component take no part; ranks go by the exact score
whatever its size, and a score that a long cannot hold is shown as the nearest long; only vectors of equal length are
compared, however long; a query with fewer candidates than k gets them all; rows of equal id are rows of their own (a
query is compared with all rows but itself); null ids are never queries and come last among ties; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import stored, table

K, SCALE, QUERY_EVERY, SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 5, 256, 50, 8192, 8192, 64
#: Queries of a block that are searched at a time.
ASKED_ROWS = 2048
#: Scaled components from here on make a vector wide.
WIDE = 1 << 26
LONG = (1 << 63) - 1
TREE = "dim int, shard int, place long, row long, vec_id long, v array<double>"
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("vec_row", pa.int64()), ("score", pa.int64()), ("exact", pa.binary()), ("low", pa.float64())])
FOUND_DDL = "query_row long, query_id long, vec_id long, vec_row long, score long, exact binary, low double"


class BallTree:
    """Leaves are consecutive runs of reordered points; each level halves the nodes of the level above.
    ordered: the points are in the tree's order already."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS, ordered: bool = False):
        self.order = np.arange(len(points))
        self.levels: list[list[tuple[int, int]]] = [[(0, len(points))]]
        while max(b - a for a, b in self.levels[-1]) > leaf_rows:
            below = []
            for a, b in self.levels[-1]:
                half = (b - a) // 2
                if not ordered:
                    own = points[self.order[a:b]]
                    centre = own.mean(axis=0)
                    away = own[((own - centre) ** 2).sum(axis=1).argmax()] - centre
                    self.order[a:b] = self.order[a:b][np.argpartition(own @ away, half)]
                below += [(a, a + half), (a + half, b)]
            self.levels.append(below)
        points = points[self.order]
        self.centres, self.radii = [], []
        for level in self.levels:
            centres = np.array([points[a:b].mean(axis=0) if b > a else np.zeros(points.shape[1]) for a, b in level])
            self.centres.append(centres)
            self.radii.append(np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) if b > a else -np.inf for (a, b), c in zip(level, centres)]))

    def bounds(self, level: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Upper bounds (queries x nodes), rounded up; infinite where doubles do not reach."""
        radius = self.radii[level]
        size = np.abs(queries) @ np.abs(self.centres[level]).T
        reach = norms[:, None] * np.maximum(radius, 0)
        out = queries @ self.centres[level].T + reach + 1e-9 * (size + reach) + 1e-6
        out = np.where(np.isfinite(out), out, np.inf)
        out[:, radius < 0] = -np.inf
        return out


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    size = (score.bit_length() + 7) // 8
    if score >= 0:
        return (0x8000 + size).to_bytes(2, "big") + score.to_bytes(size, "big")
    return (0x7FFF - size).to_bytes(2, "big") + ((1 << 8 * size) - 1 + score).to_bytes(size, "big")


def floats(scores: np.ndarray) -> np.ndarray:
    """Nearest doubles, finite ones."""
    if scores.dtype != object:
        return scores.astype(np.float64)
    most = 1 << 1023
    return np.array([float(max(-most, min(most, s))) for s in scores.ravel()], np.float64).reshape(scores.shape)


def rounded_down(scores: np.ndarray) -> np.ndarray:
    near = floats(scores)
    return np.where(np.abs(near) < 2.0**53, near, np.nextafter(near, -np.inf))


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where these hold it, else integers of any size."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if np.isfinite(scaled).all():
        return scaled
    return np.array([int(s) if np.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist())], object).reshape(x.shape)


def exact_kind(points: np.ndarray, queries: np.ndarray):
    """The type in which every inner product is exact."""
    reach = [int(max(abs(x.min(initial=0)), abs(x.max(initial=0)))) for x in (points, queries)]
    most = reach[0] * reach[1] * max(points.shape[1], 1)
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 and max(reach) < 1 << 62 else object


def as_kind(x: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    out = np.empty(x.shape, object)
    out.reshape(-1)[:] = [int(v) for v in x.ravel().tolist()]
    return out


def search(tree: BallTree, whole: np.ndarray, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, score) of each query's k best points that can beat or tie its floor, ties to smaller ids.
    whole and asked are exact, whole in the tree's order."""
    real, kth = floats(asked), floor.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((real**2).sum(axis=1))
        alive = np.ones((len(asked), 1), bool)
        for level in range(len(tree.levels)):
            bound = tree.bounds(level, real, norms)
            alive = (np.repeat(alive, 2, axis=1) if level else alive) & (bound >= kth[:, None])
    q, node = np.nonzero(alive)
    bound = bound[q, node]
    order = np.lexsort((-bound, q))
    q, node, bound = q[order], node[order], bound[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, whole.dtype)]
    begin, end = 0, 1
    while begin <= nth.max(initial=-1):
        at = np.flatnonzero((nth >= begin) & (nth < end))
        at = at[bound[at] >= kth[q[at]]]
        begin, end = end, 2 * end
        if not len(at):
            continue
        found = [best]
        at = at[np.argsort(node[at], kind="stable")]
        for leaf in np.split(at, np.flatnonzero(np.diff(node[at])) + 1):
            own = q[leaf]
            a, b = tree.levels[-1][node[leaf[0]]]
            scores = asked[own] @ whole[a:b].T
            i, j = np.nonzero((floats(scores) >= kth[own][:, None]) & (rows[a:b] != query_rows[own][:, None]))
            found.append([own[i], a + j, scores[i, j]])
        best = [np.concatenate(x) for x in zip(*found)]
        if whole.dtype == object:
            order = np.array(sorted(range(len(best[0])), key=lambda i: (best[0][i], -best[2][i], ids[best[1][i]])), np.int64)
        else:
            order = np.lexsort((ids[best[1]], -best[2], best[0]))
        best = [x[order] for x in best]
        rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [x[rank < k] for x in best]
        last = rank[rank < k] == k - 1
        kth[best[0][last]] = np.maximum(kth[best[0][last]], rounded_down(best[2][last]))
    return best[0], best[1], best[2]


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1 if len(t) and t.column("dim")[0].as_py() else 0)


def _builder(scale: int):
    """The rows of a shard in the order of its tree."""

    def run(shard: pa.Table) -> pa.Table:
        with np.errstate(over="ignore", invalid="ignore"):
            points = floats(whole_numbers(_matrix(shard, "v"), scale))
            order = BallTree(points).order
        return shard.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order)))).select([c.split()[0] for c in TREE.split(", ")])

    return run


def _searcher(k: int, scale: int):
    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not len(shard) or not len(block):
            return FOUND.empty_table()
        shard = shard.sort_by("place")
        points, queries = whole_numbers(_matrix(shard, "v"), scale), whole_numbers(_matrix(block, "asked"), scale)
        kind = exact_kind(points, queries)
        whole, asked = as_kind(points, kind), as_kind(queries, kind)
        with np.errstate(over="ignore", invalid="ignore"):
            tree = BallTree(floats(whole), ordered=True)
        ids = shard.column("vec_id").combine_chunks()
        known = ids.fill_null(LONG).to_numpy(zero_copy_only=False)
        rows, query_rows = shard.column("row").to_numpy(), block.column("query_row").to_numpy()
        floor, parts = block.column("floor").to_numpy(), []
        for first in range(0, len(block), ASKED_ROWS):
            at = slice(first, first + ASKED_ROWS)
            q, p, score = search(tree, whole, known, rows, asked[at], query_rows[at], floor[at], k)
            exact = [int(s) for s in score.tolist()]
            shown = pa.array([max(-LONG - 1, min(LONG, s)) for s in exact], pa.int64())
            keys = pa.array([sortable(s) for s in exact], pa.binary())
            parts.append(pa.table([pa.array(query_rows[at][q]), block.column("query_id").combine_chunks().take(pa.array(q + first)), ids.take(pa.array(p)), pa.array(rows[p]), shown, keys, pa.array(rounded_down(score))], schema=FOUND))
        return pa.concat_tables(parts)

    return run


def exact_top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product, for each row that is a query."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    read = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    read = read.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    wide = F.exists("v", lambda c: F.abs(c) >= WIDE / scale)
    rows = stored(read.select("*", F.monotonically_increasing_id().alias("row"), F.size("v").alias("dim"), wide.alias("wide")), "vectors")
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in (("n", ~F.col("wide")), ("wide_n", F.col("wide")), ("m", F.col("asks") & ~F.col("wide")), ("wide_m", F.col("asks") & F.col("wide")))]).first()
    parts = lambda rows, most: -(-rows // most)
    shards, blocks = [parts(counts["n"], SHARD_ROWS), parts(counts["wide_n"], SHARD_ROWS)], [parts(counts["m"], BLOCK_ROWS), parts(counts["wide_m"], BLOCK_ROWS)]

    def spread(plain: int, wide: int) -> Column:
        return F.when(F.col("wide"), plain + F.pmod(F.xxhash64("row"), F.lit(max(1, wide)))).otherwise(F.pmod(F.xxhash64("row"), F.lit(max(1, plain)))).cast("int")

    points = rows.select("dim", spread(*shards).alias("shard"), "row", "vec_id", "v")
    trees = stored(points.groupBy("dim", "shard").applyInArrow(_builder(scale), TREE), "trees")
    queries = rows.where("asks").select("dim", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("asked"), spread(*blocks).alias("query_block"))
    lowest, n_shards, n_blocks = F.lit(float("-inf")), sum(shards), sum(blocks)
    order = Window.partitionBy("query_row").orderBy(F.col("exact").desc(), F.col("vec_id").asc_nulls_last(), "vec_row")
    best = df.sparkSession.createDataFrame([], FOUND_DDL + ", rank int")
    # The first round takes as many shards as keep the cluster busy, a quarter of all at most.
    first, width = 0, max(1, min(df.sparkSession.sparkContext.defaultParallelism // max(1, n_blocks), n_shards // 4))
    while first < n_shards and n_blocks:
        end = min(first + width, n_shards)
        told = queries.withColumn("floor", lowest)
        if first:
            floors = best.where(F.col("rank") == k).select("query_row", F.col("low").alias("floor"))
            told = queries.join(floors, "query_row", "left").withColumn("floor", F.coalesce("floor", lowest))
        left = trees.where(F.col("shard").between(first, end - 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        right = told.withColumn("query_shard", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
        found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "query_shard", "query_block")).applyInArrow(_searcher(k, scale), FOUND_DDL)
        best = found if not first else best.drop("rank").unionByName(found)
        best = stored(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found")
        first, width = end, 2 * width
    return best.select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0)


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
