"""Stream sketches in set form: what a loop over elements keeps in mutable state is here a function of sequence numbers.

Inputs are rows of (seq, batch, key): seq from 1 without ties, key a long below 2^31; ``numbered`` makes one of a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scalars import affine, trailing_zeros, utf8_mod
from loomwork.operators.similarity import PRIME, coefficients

BLOOM_BITS, BLOOM_HASHES = 69_997, 5
FM_HASHES, FM_GROUP = 200, 8
RESERVOIR, SNAPSHOT_EVERY, SNAPSHOT_SLOTS = 100, 100, (0, 20, 40, 60, 80)


def numbered(stream: DataFrame, key: str = "key") -> DataFrame:
    """stream with its string keys as numbers: their bytes as one integer, mod the hash functions' prime."""
    return stream.withColumn(key, utf8_mod(F.col(key), PRIME))


def bloom_flags(stream: DataFrame, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> DataFrame:
    """(seq, batch, key, seen_any, seen_all, is_new): whether any (all) of the element's bits were set before it. A bit is set
    from the first element that hashes to it; an element's own hashes do not count against it."""
    i = F.explode(F.array(*[F.lit(k).cast("long") for k in range(hashes)]))
    cells = stream.select("seq", "batch", "key", i.alias("i"))
    a, b = coefficients(F.col("i"), hashes)
    cells = cells.withColumn("cell", F.pmod(affine(F.col("key"), a, b, PRIME), F.lit(bits))).select("seq", "batch", "key", "cell")
    first = cells.groupBy("cell").agg(F.min("seq").alias("first"))
    known = cells.join(first, "cell").groupBy("seq", "batch", "key").agg(F.bool_or(F.col("first") < F.col("seq")).alias("seen_any"), F.bool_and(F.col("first") < F.col("seq")).alias("seen_all"))
    new = stream.groupBy("key").agg(F.min("seq").alias("new_at"))
    return known.join(new, "key").select("seq", "batch", "key", "seen_any", "seen_all", (F.col("seq") == F.col("new_at")).alias("is_new"))


def false_positive_rates(flags: DataFrame) -> DataFrame:
    """(batch, any_rate, all_rate): false positives so far, by elements so far, at the end of each batch."""
    own = flags.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("seen_any") & F.col("is_new")).alias("any"), F.count_if(F.col("seen_all") & F.col("is_new")).alias("all"))
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # one row a batch
    return own.select("batch", (F.sum("any").over(upto) / F.sum("n").over(upto)).alias("any_rate"), (F.sum("all").over(upto) / F.sum("n").over(upto)).alias("all_rate"))


def distinct_estimates(stream: DataFrame, hashes: int = FM_HASHES, group: int = FM_GROUP, used: int | None = None) -> DataFrame:
    """(batch, n_elements, n_distinct, estimate) by Flajolet and Martin: per batch and hash the most trailing zeros R, means of
    2^R over groups of hashes, and the median of the means. ``used``: only so many of a group are summed, still divided by
    its size."""
    sizes = stream.groupBy("batch").agg(F.count("*").alias("n_elements"), F.countDistinct("key").alias("n_distinct"))
    once = stream.select("batch", "key").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long"))))
    a, b = coefficients(F.col("i"), hashes)
    most = once.groupBy("batch", "i").agg(F.max(trailing_zeros(affine(F.col("key"), a, b, PRIME))).alias("r"))
    value = F.pow(F.lit(2.0), F.col("r"))
    counted = value if used is None else F.when(F.pmod("i", F.lit(group)) < used, value).otherwise(0.0)
    means = most.groupBy("batch", F.floor(F.col("i") / group).alias("g")).agg((F.sum(counted) / group).alias("mean"))
    return sizes.join(means.groupBy("batch").agg(F.floor(F.median("mean")).cast("long").alias("estimate")), "batch")


def reservoir_snapshots(stream: DataFrame, size: int = RESERVOIR, every: int = SNAPSHOT_EVERY, slots: tuple[int, ...] = SNAPSHOT_SLOTS) -> DataFrame:
    """(seqnum, slot, key): what a reservoir's slots hold after each ``every`` elements. Element n is taken with probability
    size / n, drawn by a hash of n, into a slot drawn by another; only the few taken elements are windowed."""
    n = F.col("seq")
    draw, place = affine(n, 1_664_525, 1_013_904_223, PRIME), affine(n, 69_069, 362_437, PRIME)
    taken = stream.withColumn("slot", F.when(n <= size, n - 1).when(draw * n < F.lit(size).cast("long") * PRIME, F.floor(place * size / PRIME))).where("slot is not null")
    taken = taken.where(F.col("slot").isin(*slots))
    until = F.lead("seq").over(Window.partitionBy("slot").orderBy("seq"))
    last = stream.agg(F.max("seq").alias("last"))
    held = taken.withColumn("until", until).crossJoin(F.broadcast(last))  # one row
    first_mark = F.ceil(n / every) * every
    last_mark = F.floor(F.coalesce(F.col("until") - 1, "last") / every) * every
    return held.where(first_mark <= last_mark).select(F.explode(F.sequence(first_mark, last_mark, F.lit(every).cast("long"))).alias("seqnum"), "slot", "key")


def reservoir_table(snapshots: DataFrame, slots: tuple[int, ...] = SNAPSHOT_SLOTS) -> DataFrame:
    """seqnum, 0_id, 20_id, ..."""
    return snapshots.groupBy("seqnum").pivot("slot", list(slots)).agg(F.first("key")).select("seqnum", *[F.col(str(s)).alias(f"{s}_id") for s in slots])
