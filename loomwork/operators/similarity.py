"""Set-similarity joins: MinHash signatures, LSH banding, and exact verification; exact joins by prefix filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomwork.functions.scalars import affine
from loomwork.sources.storage import stored
from loomwork.sources.workers import shipped

PRIME, HASHES, ROWS = 2_147_483_647, 100, 2
#: Members up to which a bucket's pairs are all formed; larger ones go through rare members instead.
BUCKET_MEMBERS = 64
#: Rows of a table up to which it is broadcast; members that one numpy pass holds about.
MOST_BROADCAST, MEMBERS = 500_000, 1 << 15


def coefficient_lists(n: int) -> tuple[list[int], list[int]]:
    """(a, b) of n hash functions, by rule: powers of two primitive roots of PRIME, never 0 and below 2^31."""
    return [pow(48_271, i + 1, PRIME) for i in range(n)], [pow(16_807, i + 1, PRIME) for i in range(n)]


def coefficients(i: Column, n: int) -> tuple[Column, Column]:
    """(a, b) of the i-th of n hash functions, for a column of numbers from 0."""
    a, b = (F.array(*[F.lit(v).cast("long") for v in x]) for x in coefficient_lists(n))
    return a[i], b[i]


def signatures(sets: DataFrame, item: str, member: str, hashes: int = HASHES) -> DataFrame:
    """(item, signature): the least hash of each item's members, for each hash function; member is a long below 2^31.

    Minima are an array of partial aggregates: no row per hash is shuffled."""
    a, b = coefficient_lists(hashes)
    least = [F.min(affine(F.col(member).cast("long"), a[i], b[i], PRIME)) for i in range(hashes)]
    return sets.groupBy(item).agg(F.array(*least).alias("signature"))


def minhash(sets: DataFrame, item: str, member: str, hashes: int = HASHES) -> DataFrame:
    """(item, i, value): signatures in long form."""
    return signatures(sets, item, member, hashes).select(item, F.posexplode("signature").alias("i", "value"))


def bucketed(sets: DataFrame, rows: int = ROWS, hashes: int = HASHES) -> DataFrame:
    """(item, size, mask, bucket) of (item, members): the buckets of a signature's bands, each once. A band is told by the
    members that gave its least values, in any order, not by its number: values go back to members, since the hashes are
    one-to-one below PRIME. So bands that chose the same members are one bucket, and a small set is in few. Signatures are
    made in arrays, and never leave the task. mask has a bit of 64 for each member."""
    shipped(sets.sparkSession)
    a, b = (np.array(x) for x in coefficient_lists(hashes))
    back = np.array([pow(int(x), -1, PRIME) for x in a])

    def made(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Masks, buckets of all sets one after the other, and how many each has."""
        chosen = np.stack([(np.minimum.reduceat((x * flat + y) % PRIME, starts) - y) % PRIME * z % PRIME for x, y, z in zip(a, b, back)], axis=1)
        ordered = np.sort(chosen[:, : hashes // rows * rows].reshape(len(starts), -1, rows), axis=2)
        keys = ordered[:, :, 0]
        for k in range(1, rows):  # two members fit a long, more are hashed
            keys = (keys << 31 if rows == 2 else keys * 6_364_136_223_846_793_005) + ordered[:, :, k]
        keys = np.sort(keys, axis=1)
        once = np.diff(keys, axis=1, prepend=0) != 0
        once[:, 0] = True
        bits = np.uint64(1) << ((flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        return np.bitwise_or.reduceat(bits, starts).view(np.int64), keys[once], once.sum(axis=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(1)
            sizes, flat = pc.list_value_length(members).to_numpy().astype(np.int64), members.flatten().to_numpy()
            ends = np.cumsum(sizes)
            first = done = 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(ends, done + MEMBERS, "right")))
                masks, keys, n = made(flat[done : ends[last - 1]], ends[first:last] - sizes[first:last] - done)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sizes[first:last]), pa.array(masks), lists], names=["item", "size", "mask", "buckets"])
                first, done = last, int(ends[last - 1])

    kinds = {"item": sets.schema["item"].dataType, "size": LongType(), "mask": LongType(), "buckets": ArrayType(LongType(), False)}
    # Nothing is null: a filter that one user of the buckets has and another not would shuffle them twice.
    held = sets.select("item", F.col("members").cast("array<long>")).mapInArrow(run, StructType([StructField(k, v, False) for k, v in kinds.items()]))
    return held.select("item", "size", "mask", F.explode("buckets").alias("bucket"))


def verified(pairs: DataFrame, sets: DataFrame, item: str, member: str, least: float) -> DataFrame:
    """(id_1, id_2, similarity) of the pairs whose exact Jaccard similarity is ``least`` or more."""
    held = sets.groupBy(item).agg(F.collect_set(member).alias("own"))
    both = pairs.join(held.toDF("id_1", "own_1"), "id_1").join(held.toDF("id_2", "own_2"), "id_2")
    common = F.size(F.array_intersect("own_1", "own_2"))
    similarity = common / (F.size("own_1") + F.size("own_2") - common)
    return both.select("id_1", "id_2", similarity.alias("similarity")).where(F.col("similarity") >= least)


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(id_1, id_2) of distinct (item, member) rows, among them every pair at ``least``: two such sets share a member among
    the rarest |x| - ceil(least |x|) + 1 of each, so only those are joined, and only sets whose sizes allow it."""
    frequency = sets.groupBy("member").agg(F.count("*").alias("df"))
    own = Window.partitionBy("item")
    ranked = sets.join(frequency, "member").withColumn("rank", F.row_number().over(own.orderBy("df", "member"))).withColumn("size", F.count("*").over(own))
    prefix = ranked.where(F.col("rank") <= F.col("size") - F.ceil(least * F.col("size")) + 1).select("item", "member", "size")
    pairs = prefix.toDF("id_1", "member", "size_1").join(prefix.toDF("id_2", "member", "size_2"), "member").where("id_1 < id_2")
    return pairs.where(F.least("size_1", "size_2") >= least * F.greatest("size_1", "size_2")).select("id_1", "id_2").distinct()


def distinct_sets(sets: DataFrame, item: str, member: str) -> DataFrame:
    return sets.select(F.col(item).alias("item"), F.col(member).alias("member")).where("item is not null and member is not null").distinct()


def few(rows: DataFrame) -> DataFrame:
    """rows of a stored table, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def jaccard_lsh(sets: DataFrame, item: str, member: str, least: float = 0.5, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """Pairs by MinHash and banding, verified exactly. At 0.5 a pair is missed with (1 - 0.25)^50 at most. Equal sets meet as
    one and are told apart at the end. A bucket pairs its sets if they are few and ``may_reach`` says so; the sets of
    larger buckets meet by rare members instead, which misses none of their pairs and keeps hot buckets from being squared.
    Rows are shuffled once by item for the copies and once for the signatures, and these never leave their task: what goes
    on from there are buckets. sets is read up to four times."""
    own = sets.select(F.col(item).alias("item"), F.col(member).alias("member")).where("item is not null and member is not null")
    dealt = own.repartition("item").distinct()
    # Equal sets have equal 128-bit sums of their members' hashes.
    sums = F.struct(F.bit_xor(F.xxhash64("member")), F.bit_xor(F.xxhash64("member", F.lit(1))))
    alike = Window.partitionBy("sums", "size")
    told = dealt.groupBy("item").agg(F.count("*").alias("size"), sums.alias("sums")).withColumn("first", F.min("item").over(alike)).withColumn("n", F.count("*").over(alike))
    same = stored(told.where("n > 1").select("item", "first"), "same")
    copies = same.where("item != first").select("item")
    alone = copies.isEmpty()
    once = dealt if alone else dealt.join(few(copies), "item", "left_anti")
    held = bucketed(once.groupBy("item").agg(F.collect_list("member").alias("members")), rows, hashes)
    held = held.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    paired = held.where(F.col("n") <= BUCKET_MEMBERS).select("bucket", "item", "size", "mask")
    pairs = paired.toDF("bucket", "id_1", "size_1", "mask_1").join(paired.toDF("bucket", "id_2", "size_2", "mask_2"), "bucket").where((F.col("id_1") < F.col("id_2")) & may_reach(least))
    # The crowd comes from the same shuffle, which is made once only if all its columns are asked for.
    crowd = held.where(F.col("n") > BUCKET_MEMBERS).groupBy("item").agg(F.max(F.struct("size", "mask")).alias("told"))
    met = pairs.select("id_1", "id_2", F.lit(None).cast(crowd.schema["told"].dataType).alias("told")).dropDuplicates(["id_1", "id_2"])
    met = stored(met.unionByName(crowd.select(F.col("item").alias("id_1"), F.lit(None).cast(crowd.schema["item"].dataType).alias("id_2"), "told")), "met")
    pairs, crowd = met.where("id_2 is not null").select("id_1", "id_2"), met.where("id_2 is null").select(F.col("id_1").alias("item"))
    if not crowd.isEmpty():
        pairs = stored(pairs.unionByName(prefix_pairs(own.join(few(crowd), "item", "left_semi").distinct(), least)).distinct(), "pairs")
    ids = pairs.select(F.col("id_1").alias("item")).union(pairs.select("id_2"))
    found = verified(pairs, own.join(F.broadcast(ids.distinct()), "item", "left_semi") if pairs.count() <= MOST_BROADCAST else own, "item", "member", least)
    if alone:
        return found
    x, y = same.select(F.col("first").alias("id_1"), F.col("item").alias("x")), same.select(F.col("first").alias("id_2"), F.col("item").alias("y"))
    across = found.join(x, "id_1", "left").join(y, "id_2", "left").select(F.coalesce("x", "id_1").alias("x"), F.coalesce("y", "id_2").alias("y"), "similarity")
    within = x.join(y, F.col("id_1") == F.col("id_2")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"), "similarity")


def may_reach(least: float) -> Column:
    """Whether two sets can be similar enough, by their sizes and masks (a bit of 64 a member): they share at most as many
    members as the masks share bits, and one more for every member whose bit another of its set has too."""
    hidden = F.least(F.col("size_1") - F.bit_count("mask_1"), F.col("size_2") - F.bit_count("mask_2"))
    common = F.bit_count(F.col("mask_1").bitwiseAND(F.col("mask_2"))) + hidden
    return common / (F.col("size_1") + F.col("size_2") - common) >= least


def jaccard_exact(sets: DataFrame, item: str, member: str, least: float = 0.5) -> DataFrame:
    """All pairs, exactly, by prefix filtering."""
    sets = distinct_sets(sets, item, member)
    return verified(prefix_pairs(sets, least), sets, "item", "member", least)
