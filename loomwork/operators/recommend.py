"""Item-based collaborative filtering over (user, item, stars), as joins; and its blend with a model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomwork.functions.scalars import BANDS, band_of_difference
from loomwork.sources.storage import stored
from loomwork.sources.workers import shipped


def ratings(df: DataFrame, user: str, item: str, stars: str | Column) -> DataFrame:
    """One row for each pair: repeated ratings are averaged."""
    value = F.col(stars) if isinstance(stars, str) else stars
    return df.groupBy(F.col(user).alias("user"), F.col(item).alias("item")).agg(F.avg(value.cast("double")).alias("stars"))


def averages(rated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(user, user_mean), (item, item_mean), (global_mean: one row)."""
    return rated.groupBy("user").agg(F.avg("stars").alias("user_mean")), rated.groupBy("item").agg(F.avg("stars").alias("item_mean")), rated.agg(F.avg("stars").alias("global_mean"))


#: A correlation of less than this is rounding of the sums, and 0.
ROUNDING = 1e-12


#: Items, and ratings, that a block of items holds about; cells, and meetings of ratings, that one numpy pass holds.
BLOCK_ITEMS, BLOCK_RATINGS, CELLS, MEETINGS = 1024, 100_000, 1 << 18, 1 << 19


def item_weights(pairs: DataFrame | None, rated: DataFrame) -> DataFrame:
    """(item, other, weight, common) of item pairs, of all with item < other if pairs is None: the correlation over common
    raters, centred by the items' means over all their raters (0 without spread); without common raters a step function of
    the difference of the means."""
    if pairs is None:
        return all_weights(rated)
    means = rated.groupBy("item").agg(F.avg("stars").alias("mean"))
    centred = rated.join(means, "item").select("user", "item", (F.col("stars") - F.col("mean")).alias("x"))
    left, right = centred.toDF("user", "item", "x"), centred.toDF("user", "other", "y")
    met = pairs.join(left, "item").join(right, ["user", "other"])
    sums = met.groupBy("item", "other").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("common"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    both = pairs.join(sums, ["item", "other"], "left").join(means.toDF("item", "m1"), "item").join(means.toDF("other", "m2"), "other")
    ladder = band_of_difference(F.col("m1") - F.col("m2"))
    weight = F.when(F.col("common").isNull(), ladder).when((spread > 1e-12) & (F.abs("xy") > ROUNDING * spread), F.col("xy") / F.when(spread > 1e-12, spread)).otherwise(0.0)
    return both.select("item", "other", weight.alias("weight"), F.coalesce("common", F.lit(0)).alias("common"))


def all_weights(rated: DataFrame) -> DataFrame:
    """The weights of all item pairs. Items are dealt into blocks, which are stored once; every two blocks meet in a product
    that reads them from there, and a task sums over the common raters of its pairs in arrays. So no meeting of two ratings
    and no pair is shuffled: on disk are the ratings, whatever the number of pairs."""
    spark = rated.sparkSession
    shipped(spark)
    rated = rated.where("item is not null").select("user", "item", F.col("stars").cast("double").alias("stars"))
    items = rated.groupBy("item").agg(F.avg("stars").alias("mean"), F.collect_list(F.when(F.col("user").isNotNull(), F.struct("user", "stars"))).alias("held"))
    size = rated.groupBy("item").agg(F.count("*").alias("n")).agg(F.count("*").alias("items"), F.sum("n").alias("ratings")).first()
    n = max(size["items"] // BLOCK_ITEMS, (size["ratings"] or 0) // BLOCK_RATINGS) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n)))
    blocks = stored(dealt.groupBy("block").agg(F.collect_list(F.struct("item", "mean", "held")).alias("rows")).repartition(n, "block"), "blocks")
    # Of two blocks either may stand left: by the parity of their sum both do equally often, and tasks are even.
    left, right = blocks.toDF("b1", "rows_1"), blocks.toDF("b2", "rows_2").hint("shuffle_replicate_nl")
    once = F.expr("b1 = b2 or (b1 < b2) = ((b1 + b2) % 2 = 0)")
    kind = rated.schema["item"].dataType
    schema = StructType([StructField("item", kind), StructField("other", kind), StructField("weight", DoubleType()), StructField("common", LongType())])
    met = left.join(right, once).mapInArrow(_weighed, schema)
    return met.select(F.least("item", "other").alias("item"), F.greatest("item", "other").alias("other"), "weight", "common")


def _block(rows: pa.StructArray) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(items, their means; users, item numbers and centred stars of the ratings) of a block; a rating without stars is 0."""
    item, mean, held = rows.flatten()
    user, stars = held.flatten().flatten()
    mean = mean.to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(item)), pc.list_value_length(held).to_numpy())
    x = stars.to_numpy(zero_copy_only=False) - mean[at]
    return item, mean, user, at, np.where(stars.is_null().to_numpy(zero_copy_only=False), 0.0, x)


def _weighed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of all pairs of an item of the left block and one of the right; within one block, of each pair once."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield from _block_weights(_block(batch.column(1)[k].values), _block(batch.column(3)[k].values), batch.column(0)[k] == batch.column(2)[k])


def _block_weights(left: tuple, right: tuple, same: bool) -> Iterator[pa.RecordBatch]:
    (item, m1, users, at, x), (other, m2, other_users, other_at, y) = left, right
    codes = pa.concat_arrays([users, other_users]).dictionary_encode().indices.to_numpy()
    code, theirs = codes[: len(users)], codes[len(users) :]
    order = np.argsort(theirs, kind="stable")
    other_at, y = other_at[order], y[order]
    raters = np.bincount(theirs, minlength=int(codes.max(initial=-1)) + 1)
    first, reach = (np.cumsum(raters) - raters)[code], raters[code]  # of each left rating: the right ones of its user
    edges, bands = np.array([e for e, _ in BANDS]), np.array([w for _, w in BANDS] + [0.0])
    width = len(other)
    step = max(1, CELLS // width)
    for start in range(0, len(item), step):
        end = min(len(item), start + step)
        size = (end - start) * width
        xy, xx, yy, common = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        low, high = np.searchsorted(at, (start, end))
        so_far = np.cumsum(reach[low:high])
        while low < high:
            done = so_far[-(high - low)] - reach[low]
            to = max(low + 1, high - len(so_far) + int(np.searchsorted(so_far, done + MEETINGS, "right")))
            n = reach[low:to]
            mine = np.repeat(np.arange(low, to), n)
            met = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n - first[low:to], n)
            cell, a, b = (at[mine] - start) * width + other_at[met], x[mine], y[met]
            xy += np.bincount(cell, a * b, size)
            xx += np.bincount(cell, a * a, size)
            yy += np.bincount(cell, b * b, size)
            common += np.bincount(cell, minlength=size)
            low = to
        spread = np.sqrt(xx) * np.sqrt(yy)
        told = (spread > 1e-12) & (np.abs(xy) > ROUNDING * spread)
        ladder = bands[np.searchsorted(edges, np.abs(m1[start:end, None] - m2[None, :]).ravel())]
        weight = np.where(common == 0, ladder, np.where(told, xy / np.where(told, spread, 1.0), 0.0))
        i, j = np.repeat(np.arange(start, end), width), np.tile(np.arange(width), end - start)
        if same:
            kept = np.flatnonzero(i < j)
            i, j, weight, common = i[kept], j[kept], weight[kept], common[kept]
        yield pa.RecordBatch.from_arrays([item.take(pa.array(i)), other.take(pa.array(j)), pa.array(weight), pa.array(common)], names=["item", "other", "weight", "common"])


def predicted(targets: DataFrame, rated: DataFrame, exclude_self: bool = False) -> DataFrame:
    """(user, item, prediction, neighbours) for target pairs: the weighted mean of the user's ratings over items of positive
    weight; without any, the mean of item and user mean; unknown users, items, or both get the other's mean or the global one."""
    targets = targets.select("user", "item").distinct()
    user_mean, item_mean, global_mean = averages(rated)
    known = targets.join(item_mean.select("item"), "item", "left_semi")
    near = known.join(rated.select("user", F.col("item").alias("other"), "stars"), "user")
    if exclude_self:
        near = near.where("item != other")
    weights = item_weights(near.select("item", "other").distinct(), rated).where("weight > 0")
    scored = near.join(weights, ["item", "other"]).groupBy("user", "item").agg((F.sum(F.col("weight") * F.col("stars")) / F.sum("weight")).alias("score"), F.count("*").alias("neighbours"))
    means = targets.join(user_mean, "user", "left").join(item_mean, "item", "left").crossJoin(F.broadcast(global_mean))  # one row
    value = F.coalesce("score", (F.col("item_mean") + F.col("user_mean")) / 2, "item_mean", "user_mean", "global_mean")
    return means.join(scored, ["user", "item"], "left").select("user", "item", value.alias("prediction"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def blended(model: Column, collaborative: Column, alpha: float = 1.0) -> Column:
    return alpha * model + (1 - alpha) * collaborative
