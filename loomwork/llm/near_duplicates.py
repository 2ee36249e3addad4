"""Operator 8, near duplicates by DartMinHash.

A text is the weighted set of its five-word shingles (weight: how often it occurs; a text of one to four words is one
shingle). Element x of weight w owns the region [0, w) x [0, inf) of weight and rank; darts fall on it as a Poisson
process of unit density whose places are hashes of the shingle, so two texts that share a part of a region share its
darts. Only darts up to a rank of ``t / total weight`` are generated, about t = k (ln k + 3) a text whatever its length;
each belongs to one of k coordinates, and the signature keeps the earliest of each (a text with an empty coordinate
throws up to twice the rank, and so on). Two signatures agree in a coordinate with the probability of the weighted
Jaccard similarity. ``BANDS`` bands of ``ROWS`` coordinates make buckets; a pair at 0.8 meets in one with 0.99995.

Equal texts are one node from the start. In the first round every bucket pairs its members with the one that meets most
others over all buckets: of copies of one text, that is the text itself. Later rounds take buckets that still hold
several classes; each class sends a member drawn by a hash of round and bucket, and one of them is paired with the
others. So pairs are linear in members however large a bucket is. They pass a check of sizes, one of a byte per coordinate
(below 0.65 of agreement nothing at 0.8 is to be expected), and an exact one: the weighted Jaccard similarity of all
shingles, by 32-bit hashes. Links make classes by connected components. Rounds end when one links few more. The texts of
buckets that are still split then go through an exact join by prefixes of rare shingles, so that every two of different
classes are either compared or excluded by a bound, whatever a leader was compared with.

Defined results: null texts are classes of their own, named by their id; texts without words equal only each other if
they are the same string; repeated rows give repeated rows of one class; ties (equal least ids) are the same class id;
very long texts are shingled whole; an empty table gives an empty result; other columns are not read by the query and
passed on by ``first_of_each``. A class is named by its least id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import dropped, shipped, slices, stored, table, unused
from loomwork.llm.components import connected
from loomwork.llm.quality_rules import BASE, mixed

SHINGLE, SIMILARITY, BANDS, ROWS, PLAUSIBLE = 5, 0.8, 25, 5, 0.65
#: Counted rows of a few numbers each (tens of MB) up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
#: The exact join follows the first round that links less than one part in so many of all links.
FEW_LINKS = 50
#: Cells that one batch of the exact join holds, but for a longer text.
CELLS = 500_000
K = BANDS * ROWS
SLOT_SHIFT = np.uint64(44)
MOST_TEXTS = (1 << 20) // K


_white = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_byte_codes = mixed(np.arange(256))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i below n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many each text has: polynomials over the bytes, as differences of one
    running sum over the whole slice."""
    encoded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    white = _white[data]
    edge = np.flatnonzero(np.diff(np.r_[True, white].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.r_[np.uint64(0), np.cumsum(_byte_codes[data] * up)]
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    bounds = np.cumsum([len(e) + 1 for e in encoded])
    return hashes, np.diff(np.r_[0, np.searchsorted(starts, bounds)])


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each unit of weight: the j-th time that a text has a shingle counts as another unit."""
    codes, size = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), size)
    begin = np.cumsum(size) - size
    at = np.arange(len(codes))
    at = at[at - begin[owner] <= np.maximum(size[owner] - SHINGLE, 0)]
    h, text = np.zeros(len(at), np.uint64), owner[at]
    for k in range(SHINGLE):
        inside = k < size[text]
        h = np.where(inside, h * BASE + codes[np.minimum(at + k, len(codes) - 1)] + np.uint64(1), h)
    h = mixed(h)
    order = np.argsort(h ^ mixed(text.astype(np.uint64)), kind="stable")
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])]
    if same.any():
        places = np.arange(len(order))
        nth = np.zeros(len(order), np.uint64)
        nth[order] = places - np.maximum.accumulate(np.where(same, 0, places))
        h = np.where(nth > 0, mixed(h + nth * BASE), h)
    return text, h


def uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(text: np.ndarray, h: np.ndarray, n: int, weight: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """n x k earliest ranks (as ordered bits). text, h: the text and the hash of each cell of weight, at most 1 wide;
    weight: its width where it is not 1. Rows of texts without cells are zero."""
    total = np.bincount(text, weight, n)
    out = np.zeros((n, k), np.uint64)
    open_texts, reach = total > 0, np.zeros(n)
    reach[open_texts] = k * (math.log(k) + 3) / total[open_texts]
    while open_texts.any():
        cell = np.flatnonzero(open_texts[text])
        rank, keys, step = np.zeros(len(cell)), [], 1
        while len(cell):  # the next dart of each cell that still has one within reach
            seed = mixed(h[cell] + np.uint64(step * int(BASE) % (1 << 64)))
            rank = rank - np.log(uniform(seed))
            near = rank <= reach[text[cell]]
            cell, rank, seed = cell[near], rank[near], mixed(seed[near])
            hit = slice(None) if weight is None else uniform(mixed(seed)) <= weight[cell]
            slot = text[cell].astype(np.uint64) * np.uint64(k) + seed % np.uint64(k)
            keys.append(((slot << SLOT_SHIFT) | (rank.view(np.uint64) >> np.uint64(20)))[hit])
            step += 1
        found = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        slot = (found >> SLOT_SHIFT).astype(np.int64)
        first = np.r_[True, slot[1:] != slot[:-1]] if len(slot) else np.zeros(0, bool)
        out.reshape(-1)[slot[first]] = found[first] & np.uint64((1 << 44) - 1)
        open_texts = open_texts & (out == 0).any(axis=1)
        reach[open_texts] *= 2
    return out


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, texts in slices(b, 2):
            for k in range(0, len(texts), MOST_TEXTS):
                part = texts[k : k + MOST_TEXTS]
                text, h = shingles(part)
                signature = dart_signatures(text, h, len(part))
                bands = np.zeros((len(part), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mixed(bands * BASE + signature[:, r::ROWS]) + np.arange(1, BANDS + 1, dtype=np.uint64)
                units = np.bincount(text, minlength=len(part))
                has = units > 0
                ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                small = mixed(signature).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first + k, len(part)), b.column(1).slice(first + k, len(part)), pa.array(units), pa.array([x.tobytes() for x in small], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[has].reshape(-1).view(np.int64)))],
                    names=["key", "doc_id", "units", "small", "bands"],
                )


def _plausible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            x, y = (np.frombuffer(b"".join(b.column(n).to_pylist()), np.uint8).reshape(len(b), K) for n in ("small_a", "small_b"))
            m, n = (b.column(c).to_numpy() for c in ("units_a", "units_b"))
            keep = ((x == y).sum(axis=1) >= PLAUSIBLE * K) & (np.minimum(m, n) >= SIMILARITY * np.maximum(m, n))
            yield b.select(["a", "b"]).filter(pa.array(keep))


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, end, texts in slices(b):
            text, h = shingles(texts)
            small = h.astype(np.uint32)
            order = np.lexsort((small, text))
            edges = np.searchsorted(text, np.arange(len(texts) + 1))
            small = small[order]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array([small[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary())], names=["node", "own"])


def _similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("own_a"), b.column("own_b")):
            x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
            both = np.sort(np.concatenate([x, y]))  # of each value, pairs of equal neighbours across the sorted multisets
            values, counts = np.unique(both, return_counts=True)
            twice = values[counts > 1]
            common = int(np.minimum(np.searchsorted(x, twice, "right") - np.searchsorted(x, twice), np.searchsorted(y, twice, "right") - np.searchsorted(y, twice)).sum())
            keep.append(common >= SIMILARITY * (len(x) + len(y) - common))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, root = (b.column(c).to_numpy() for c in (0, 1))
        own = b.column(2).to_pylist()
        size = np.array([len(x) // 4 for x in own], np.int64)
        part = np.cumsum(size) // CELLS
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            cell = np.frombuffer(b"".join(own[k] for k in at), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x[at], size[at])) for x in (node, root)] + [pa.array(cell)], names=["node", "root", "cell"])


def text_key(text: Column) -> Column:
    """128 bits of a text, computed in the JVM; null for null."""
    return F.unhex(F.md5(text))


def counted(df: DataFrame, n: int) -> DataFrame:
    """df, for a broadcast if its counted rows (a few numbers each) are few enough; else Spark chooses another join."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def linked(pairs: DataFrame, n: int, held: DataFrame, check, columns: list[str]) -> DataFrame:
    """The pairs (a, b) that pass check, which sees held's columns of both. Only what pairs name is moved."""
    sides = [counted(pairs, n).join(held.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns]), x) for x in "ab"]
    both = sides[0].join(sides[1], ["a", "b"])
    return both.mapInArrow(check, "a long, b long")


def rare_prefixes(texts: DataFrame, scratch: list[str]) -> DataFrame:
    """(cell, node, root, n, at) of the cells that may be the first common one, in an order from rare to common, of a text
    (node, root, own) and a similar one of another root; n: the text's cells, at: the cell's place among them, from 1."""
    cells = texts.select("node", "root", "own").mapInArrow(_cells, "node long, root long, cell int")
    common = cells.groupBy("cell").agg(F.count("*").alias("often"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("often > 1")
    common = stored(common.select("cell", "often", (F.col("r0") != F.col("r1")).alias("across")), "common", scratch)
    ranked = cells.join(counted(common, common.count()), "cell", "left")
    cell = F.struct(F.coalesce("often", F.lit(1)).alias("often"), "cell", F.coalesce("across", F.lit(False)).alias("across"))
    sizes = ranked.groupBy("node", "root").agg(F.array_sort(F.collect_list(cell)).alias("cells")).withColumn("n", F.size("cells"))
    prefix = F.slice("cells", F.lit(1), (F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-6) + 1).cast("int"))
    placed = sizes.select("node", "root", "n", F.posexplode(prefix).alias("at", "c")).where("c.across")
    return stored(placed.groupBy(F.col("c.cell").alias("cell"), "node", "root", "n").agg((F.min("at") + 1).alias("at")), "prefixes", scratch)


def left_pairs(texts: DataFrame, scratch: list[str]) -> DataFrame:
    """(a, b) of different roots, among them every similar one. Of a similar pair, the first common cell is early in both,
    earlier yet in the smaller text, and leaves as many cells after it as the two need in common."""
    prefixes = rare_prefixes(texts, scratch)
    least = F.ceil(F.col("n") * (2 * SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    small = prefixes.where(F.col("at") <= F.col("n") - least + 1)
    small = small.select("cell", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "at")])
    needed = F.ceil((F.col("n_a") + F.col("n")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6)
    first = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("node_a") < F.col("node")))
    room = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at")) >= needed
    met = prefixes.join(counted(small, small.count()), "cell").where(first & (F.col("root_a") != F.col("root")) & room)
    return met.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, doc_id) of each row with a text, and (key, class_key, class_id) of each different text."""
    shipped(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").withColumn("key", text_key(F.col("text")))
    rows = stored(docs.select("key", "doc_id", "text").mapInArrow(_signed, "key binary, doc_id long, units long, small binary, bands array<long>"), "signed")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("units").alias("units"), F.first("small").alias("small"), F.first("bands").alias("bands"))
    scratch: list[str] = []
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes", scratch)
    cells = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(cells.join(shared, "bucket"), "members", scratch)
    n_members = members.count()
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    about = stored(nodes.drop("bands").join(central, "node"), "about", scratch)
    members = members.select("bucket", "node").join(counted(about.select("node", "met"), about.count()), "node")
    wanted = counted(about.select("key", "least", "node"), about.count())
    # By key and id, so that the rows of a text that very many documents hold do not meet in one task.
    named_by = wanted.withColumnRenamed("key", "its_key")
    texts = docs.join(named_by, (F.col("key") == F.col("its_key")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "text")
    owned = stored(texts.mapInArrow(_units, "node long, own binary").dropDuplicates(["node"]), "units", scratch)
    links: DataFrame | None = None
    tried: DataFrame | None = None
    roots: DataFrame | None = None
    n_links = 0
    for turn in count():
        now = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn:  # each class of a bucket sends one member, another each round
            drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "bucket", "node").alias("draw"), "node")).alias("sent")
            now = now.groupBy("bucket", "root").agg(drawn).select("bucket", "root", "sent.draw", "sent.node")
        order = F.struct(F.col("draw") if turn else -F.col("met"), F.col("node"), F.col("root"))
        split = now.groupBy("bucket").agg(F.min(order).alias("lead"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1")
        split = split.select("bucket", F.col("lead.node").alias("lead"), F.col("lead.root").alias("lead_root"))
        pairs = now.join(split, "bucket").where("root != lead_root").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs", scratch, n_members)
        n_pairs = pairs.count()
        if not n_pairs:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        likely = stored(linked(pairs, n_pairs, about, _plausible, ["units", "small"]), "likely", scratch, n_pairs)
        n_likely = likely.count()
        new = stored(linked(likely, n_likely, owned, _similar, ["own"]), "links", scratch, n_likely)
        n_new = new.count()
        if n_new:
            links, n_links = new if links is None else links.unionByName(new), n_links + n_new
            roots = stored(connected(links.toDF("u", "v"), scratch, n_links), "roots", scratch, 2 * n_links)
        if n_new * FEW_LINKS <= n_links:
            break
    now = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = now.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    open_texts = stored(now.join(split, "bucket", "left_semi").select("node", "root").distinct(), "open", scratch, n_members)
    n_open = open_texts.count()
    if n_open:
        pairs = stored(left_pairs(owned.join(counted(open_texts, n_open), "node"), scratch), "pairs", scratch)
        n_pairs = pairs.count()
        new = stored(linked(pairs, n_pairs, owned, _similar, ["own"]), "links", scratch, n_pairs)
        n_new = new.count()
        if n_new:
            links, n_links = new if links is None else links.unionByName(new), n_links + n_new
            roots = stored(connected(links.toDF("u", "v"), scratch, n_links), "roots", scratch, 2 * n_links)
    named = nodes.select("key", "least", "node")
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("best"))
    named = stored(named.join(best, "root").select("key", F.col("best.key").alias("class_key"), F.col("best.least").alias("class_id")), "classes")
    dropped(df.sparkSession, scratch)
    return rows.select("key", "doc_id"), named


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id of every row."""
    rows, named = classes(df, id_col, text_col)
    alone = df.where(F.col(text_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(id_col).cast("long").alias("class_id"))
    return rows.join(named, "key").select("doc_id", "class_id").unionByName(alone)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each class one row with the class's least id; rows with null texts all stay."""
    _, named = classes(docs, id_col, text_col)
    key, winner, least = (unused(name, docs) for name in ("__key", "__winner", "__least"))
    winners = named.where("key = class_key").select(F.col("key").alias(winner), F.col("class_id").alias(least))
    keyed = docs.withColumn(key, text_key(F.col(f"`{text_col}`").cast("string")))
    own = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(least))
    texts = keyed.where(F.col(key).isNotNull()).join(winners, (F.col(key) == F.col(winner)) & own, "left_semi")
    return texts.dropDuplicates([key, id_col]).unionByName(keyed.where(F.col(key).isNull())).drop(key)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
