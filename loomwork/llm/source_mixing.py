"""Operator 6, mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

Sources by code point (null last) weigh 1, 2, 3, 1, ...; together they are to give as many words as all documents have,
but none more than ``MOST_EPOCHS`` times its own words, the excess going to the others by weight (water-filling: capped
sources are those with the least words per weight). Documents of a source stand in the order of a hash of their id and
form a line of words that repeats; blocks cut it every ``block`` words. Slot n of the schedule goes to the source in
whose share of [0, 1) the n-th golden-ratio point falls; a slot's rank within its source says which block it takes, in
which epoch. A source's last slot is cut at its target; slots past that are void, and the few that a source lacks at
the end of the schedule (its discrepancy, a logarithm of the slots) are appended. A document takes what its words
overlap with the blocks taken, and stands in the mixture where the slots of its blocks stand: ``first_slot`` is the
first of them, and ``mixed_documents`` gives the mixture in the order of the slots. So the schedule decides the order,
every stretch of which holds the sources near their shares; how many words a source gives is its target.

Positions and ranks are prefix sums in two levels, buckets and then rows, so no window holds a whole source; a bucket
that rows of equal ids fill is split further by row.

Defined results: null and empty texts have no words and take none; a null source is a source, the last; equal ids go by
size, then by row; repeated rows count each; very long texts are counted whole and may span many blocks; an empty table
gives an empty result; other columns are not read by the query and passed on by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import shipped, slices, stored, table, unused

MOST_EPOCHS, LEAST_SLOTS, DOCS_PER_SLOT, SLOTS_PER_CHUNK, ROWS_PER_BUCKET, CELLS = 3, 4096, 64, 512, 2048, 1024
GOLDEN = 0.6180339887498949
#: A bucket of more rows than this is split by row; words of the mixture in one output partition.
CROWDED_ROWS, WORDS_PER_PART = 8 * ROWS_PER_BUCKET, 20_000_000


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, row: Column) -> DataFrame:
    """row, doc_id, source, size, place: place is the shuffled order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(t.encode().split()) for _, _, texts in slices(b, 3) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int64())], names=["row", "doc_id", "source", "size"])

    shipped(df.sparkSession)
    read = df.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "row long, doc_id long, source string, size long").withColumn("place", F.xxhash64("doc_id"))


def targets(sources: DataFrame) -> DataFrame:
    """src, source, source_size, target from source, source_size. One row a source: windows over all of them are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("src", F.row_number().over(by_name) - 1).withColumn("weight", F.pmod("src", F.lit(3)) + 1)
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before, onward = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = MOST_EPOCHS * F.col("source_size")
    # If every source before this one is capped, each unit of weight gets this much from here on.
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(onward)
    leveled = weighed.withColumn("level", F.when(level * F.col("weight") <= cap, level))
    first = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("source_size") / F.col("weight"))).over(all_rows)
    return leveled.withColumn("level", first).select("src", "source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")).alias("target"))


def prefix(df: DataFrame, keys: list[str], coarse: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """df with the exclusive prefix sum of amount within keys, by (coarse, order): sums of coarse buckets, then of rows."""
    sums = df.groupBy(*keys, *coarse).agg(F.sum(amount).alias("__sum"))
    over = Window.partitionBy(*keys).orderBy(*coarse).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(over), F.lit(0))).drop("__sum")
    within = Window.partitionBy(*keys, *coarse).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__within", F.coalesce(F.sum(amount).over(within), F.lit(0))).join(sums, [*keys, *coarse]).withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within")


def schedule(sources: DataFrame, n_slots: int, n_cells: int = CELLS) -> DataFrame:
    """src, rank, n of each slot; sources has src, needed (slots) and lo, hi (its share of [0, 1))."""
    spark = sources.sparkSession
    cells = sources.where("needed > 0").select("src", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("n"), F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0)).alias("u")).withColumn("cell", F.floor(F.col("u") * n_cells))
    drawn = slots.join(cells, "cell").where("u >= lo and u < hi").select("src", "n", F.floor(F.col("n") / SLOTS_PER_CHUNK).alias("chunk"))
    ranked = prefix(drawn, ["src"], ["chunk"], ["n"], F.lit(1), "rank").select("src", "rank", "n")
    given = drawn.groupBy("src").agg(F.count("*").alias("given"))
    lacking = sources.where("needed > 0").join(given, "src", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < needed")
    tail = lacking.select("src", F.explode(F.sequence("given", F.col("needed") - 1)).alias("rank")).withColumn("n", F.lit(n_slots) + F.col("rank"))
    return ranked.unionByName(tail)


def bucketed(rows: DataFrame, bits: int) -> DataFrame:
    """rows with bucket, the first bits of place, and part: 0, or by row in a bucket that too many rows (equal ids) fill."""
    rows = rows.withColumn("bucket", F.shiftright("place", 64 - bits))
    crowds = rows.groupBy("source", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED_ROWS)
    crowds = crowds.select(F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), F.ceil(F.col("n") / ROWS_PER_BUCKET).alias("__parts"))
    if crowds.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    held = rows.join(crowds, rows.source.eqNullSafe(crowds["__source"]) & (rows.bucket == crowds["__bucket"]), "left")
    return held.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("__parts")), F.lit(0))).drop("__source", "__bucket", "__parts")


def mixture(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """row, doc_id, size, source_size, target, taken, first_slot, slots (of each epoch), begin from stored rows of ``sized``;
    the number of slots, appended ones among them; and how many words all documents have."""
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    n, words = total["n"], total["words"] or 0
    block = max(1, -(-words // max(LEAST_SLOTS, n // DOCS_PER_SLOT)))
    bits = max(8, (n // ROWS_PER_BUCKET).bit_length())
    goal = F.round("target").cast("long")
    needed = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size")) * F.col("blocks") + F.ceil(F.pmod(goal, F.col("source_size")) / F.lit(block))).otherwise(0)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("goal", goal).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block))).withColumn("needed", needed)
    through = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto, every = F.sum("needed").over(through), F.sum("needed").over(everything)
    sources = stored(sources.withColumn("hi", F.try_divide(upto, every)).withColumn("lo", F.try_divide(upto - F.col("needed"), every)), "sources")
    held = sources.agg(F.sum("needed").alias("slots"), F.count("*").alias("sources"), F.max("needed").alias("most")).first()
    n_slots = held["slots"] or 0
    epoch, at = F.floor(F.col("rank") / F.col("blocks")), F.pmod("rank", "blocks")
    slots = schedule(sources, n_slots, max(CELLS, 2 * held["sources"])).join(sources.select("src", "blocks", "goal", "source_size"), "src").where("blocks > 0")
    slots = slots.select("src", "n", at.alias("block"), F.least(F.lit(block), F.col("source_size") - at * block).alias("full"), (F.col("goal") - epoch * F.col("source_size") - at * block).alias("left")).where("left > 0")
    # A block has a slot for each epoch, the cut one the last: MOST_EPOCHS at most.
    takes = slots.groupBy("src", "block").agg(F.count_if(F.col("left") >= F.col("full")).alias("times"), F.max(F.when(F.col("left") < F.col("full"), F.col("left"))).alias("cut"), F.sort_array(F.collect_list("n")).alias("slots"))
    docs = bucketed(rows, bits).join(sources.select("src", "source", "source_size", "target"), rows.source.eqNullSafe(sources.source)).drop("source")
    docs = prefix(docs, ["src"], ["bucket", "part"], ["place", "size", "row"], F.col("size"), "begin")
    docs = docs.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)))))
    edge = F.col("block") * block
    low = F.greatest("begin", edge)
    overlap = lambda end: F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), edge + end) - low)
    in_cut = overlap(F.coalesce("cut", F.lit(0)))
    taken = F.col("times") * overlap(F.lit(block)) + in_cut
    own = F.slice("slots", F.lit(1), F.col("times").cast("int") + F.when(in_cut > 0, 1).otherwise(0))
    parts = docs.join(takes, ["src", "block"], "left").withColumn("own", F.when(taken > 0, own)).withColumn("took", taken)
    most = F.max(F.struct(F.size("own").alias("n"), (-F.col("block")).alias("first"), "own")).alias("most")
    out = parts.groupBy("row", "doc_id", "size", "source_size", "target", "begin").agg(F.coalesce(F.sum("took"), F.lit(0)).cast("long").alias("taken"), F.min(F.array_min("own")).alias("first_slot"), most)
    return out.withColumn("slots", F.col("most.own")).drop("most"), n_slots + (held["most"] or 0), words


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for each row of df."""
    rows, _, _ = mixture(stored(sized(df, id_col, text_col, source_col, F.monotonically_increasing_id()), "sizes"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: each document as often as its taken words come to its size, rounded; its own columns only. Rows
    stand in the order of the schedule: partitions are equal ranges of slots, sorted within, so they hold like numbers of
    words whatever the sources are. A copy stands at its epoch's slot."""
    row, mix = unused("__row", docs), unused("__mix", docs)
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    shares, n_slots, words = mixture(stored(sized(keyed, id_col, text_col, source_col, F.col(row)), "sizes"))
    copies = F.round(F.try_divide("taken", "size")).cast("int")
    shares = shares.where("taken > 0").withColumn("copies", copies).where("copies > 0")
    slot = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), "copies")), lambda k: F.struct(F.get("slots", F.least(k, F.size("slots")) - 1).alias("slot"), F.col("begin").alias("begin"), k.alias("copy")))
    out = keyed.join(shares.select(F.col("row").alias(row), slot.alias(mix)), row).withColumn(mix, F.explode(mix))
    n = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-words // WORDS_PER_PART))
    part = F.floor(F.col(mix)["slot"] * n / max(1, n_slots))
    dealt = out.repartitionById(n, F.least(part, F.lit(n - 1)).cast("int")).sortWithinPartitions(mix)
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
