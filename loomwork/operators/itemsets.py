"""Frequent itemsets: exact level-wise counting, and the two-pass partitioned form."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.graph import settled

#: Baskets of one task in the first pass of the partitioned form, which holds them in memory.
BASKETS_PER_TASK = 100_000


def baskets(df: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """Distinct (basket, item) rows of baskets with more than so many items."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    if more_than:
        rows = rows.join(rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("basket"), "basket", "left_semi")
    return rows


def supported(counts: DataFrame, support: int, strict: bool) -> DataFrame:
    return counts.where(F.col("support") > support if strict else F.col("support") >= support)


def frequent_itemsets(rows: DataFrame, support: int, strict: bool = False, most: int | None = None) -> DataFrame:
    """(items, support) of every itemset, of up to ``most`` items if given; rows are distinct (basket, item).

    A level extends what each basket holds of the level before by a larger frequent item, and keeps only candidates all of
    whose subsets are frequent, before anything is counted."""
    single = supported(rows.groupBy("item").agg(F.count("*").alias("support")), support, strict)
    found = single.select(F.array("item").alias("items"), "support")
    useful = rows.join(single.select("item"), "item", "left_semi").select("basket", F.col("item").alias("next"))
    held, level = useful.select("basket", F.array("next").alias("items")), found
    for size in count(2):
        if most is not None and size > most:
            break
        longer = held.join(useful, "basket").where(F.col("next") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("next")).alias("items"))
        if size > 2:
            subset = F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.lit(size)))))
            known = level.select(F.col("items").alias("subset"))
            candidates = longer.select("items").distinct().withColumn("subset", subset).join(known, "subset", "left_semi").groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") == size).select("items")
            longer = longer.join(candidates, "items", "left_semi")
        level = settled(supported(longer.groupBy("items").agg(F.count("*").alias("support")), support, strict))
        if level.isEmpty():
            break
        held = settled(longer.join(level.select("items"), "items", "left_semi").select("basket", "items"))
        found = found.unionByName(level)
    return found


def local_candidates(frames: Iterable[pd.DataFrame], support: float, total: int, most: int | None) -> Iterator[pd.DataFrame]:
    """The itemsets that are frequent within this task's baskets at its share of the support: no itemset that is frequent
    overall is missed, since it reaches its share in one task at least."""
    held: dict = {}
    for frame in frames:
        for basket, item in zip(frame["basket"], frame["item"]):
            held.setdefault(basket, []).append(item)
    own = [(sorted(x), [()]) for x in held.values()]
    least = support * len(own) / max(total, 1)
    good: set = {()}
    for size in count(1):
        if most is not None and size > most:
            return
        # what each basket holds of the level before, with a larger item
        longer = [(b, [c + (i,) for c in sets for i in b if (not c or i > c[-1]) and all(s in good for s in combinations(c + (i,), size - 1))]) for b, sets in own]
        counts = Counter(c for _, sets in longer for c in sets)
        good = {c for c, n in counts.items() if n >= least - 1e-9}
        if not good:
            return
        yield pd.DataFrame({"items": [list(c) for c in good]})
        own = [(b, kept) for b, sets in longer if (kept := [c for c in sets if c in good])]


def son_itemsets(rows: DataFrame, support: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, frequent): pass 1 finds candidates within partitions of whole baskets, pass 2 counts them all."""
    total = rows.select("basket").distinct().count()
    # A task holds a bounded number of baskets, and its share of the support is 4 at least, since at a share of 1 every
    # subset of a basket is a candidate.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BASKETS_PER_TASK))
    dealt = rows.repartition(max(1, min(parts, support // 4)), "basket")
    kind = rows.schema["item"].dataType.simpleString()
    candidates = dealt.mapInPandas(lambda frames: local_candidates(frames, support, total, most), f"items array<{kind}>").distinct()
    candidates = settled(candidates.withColumn("size", F.size("items")))
    single = rows.select("basket", F.col("item").alias("next"), F.array("item").alias("items"))
    of_size = lambda k: candidates.where(F.col("size") == k).select("items")
    held = single.join(of_size(1), "items", "left_semi")
    useful, counts = held.select("basket", "next"), held.groupBy("items").agg(F.count("*").alias("support"))
    held = held.select("basket", "items")
    longest = candidates.agg(F.max("size")).first()[0] or 0
    for size in range(2, longest + 1):  # what a basket holds of the candidates, each from its shorter beginning
        longer = held.join(useful, "basket").where(F.col("next") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("next")).alias("items"))
        held = longer.join(of_size(size), "items", "left_semi")
        counts = counts.unionByName(held.groupBy("items").agg(F.count("*").alias("support")))
    return candidates.select("items"), supported(counts, support, False)
