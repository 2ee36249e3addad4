"""Operator 10, best-fit packing: documents into sequences of a fixed number of tokens, by linear grouping.

One pass tokenizes the texts and stores a row for each piece with its length and its running number among the task's
pieces of that length. Only the histogram of lengths (at most ``capacity`` rows) goes to the driver, which plans on
counts: large lengths are split into groups of equal cardinality and rounded up to the longest of the group; the few
sizes that remain make a cutting-stock problem, solved by column generation (a knapsack prices each new
configuration); actual lengths replace the rounded ones in each configuration's slots; what is left over and all small
lengths then go, longest first, where they fit best. Rounding leaves sequences loose, so several plans are made, which
differ in the number of groups and in the share of each configuration's sequences that is used before best fit takes the
rest (none at all in the last), and the one with the fewest sequences is kept. A plan says for an interval of ranks of
one length which sequences take it, and at which offset. Its size depends on the capacity and the number of groups only,
not on the number of documents, so it travels with the function that applies it.

Defined results: null is the empty text, which is a document of one token (the end); a special string inside a text is
the library's special token; equal rows each get places of their own; an empty table gives an empty result; other
columns are not read. Texts are tokenized whole; a document of more than ``capacity`` tokens is cut into pieces of
``capacity``, of which the first may be shorter.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm.common import by_text, slices, stored, table
from loomwork.llm.token_counts import byte_alphabet

CAPACITY, END_ID = 1024, 2
#: (groups, the part of the capacity above which a length is large) of each linear grouping, and the shares tried.
GROUPINGS, SHARES = ((512, 2.5), (128, 3.5)), (1.0, 0.5, 0.2)
PIECE = pa.schema([(c, pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")])
PIECE_DDL = ", ".join(f"{f.name} long" for f in PIECE)


class Encoder:
    """Token ids of a byte-level BPE file. If its ids follow its merge ranks, the same vocabulary runs in the faster of the
    two public libraries; a text whose white-space run is too long for that one's regex goes through the file's own, as
    does every text of another file."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.load(open(public_tokenizers.path(name)))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        shown = byte_alphabet()
        ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = (pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"])
        merged = [spec["model"]["vocab"][a + b] for a, b in pairs]
        singles = [ranks[bytes((k,))] for k in range(256) if bytes((k,)) in ranks]
        self.fast = None
        if all(x < y for x, y in zip([max(singles), *merged], merged)) and len(singles) == 256 and len(ranks) == 256 + len(merged):
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_file(public_tokenizers.path(name))

    def ids(self, text: str) -> np.ndarray:
        try:
            if self.fast:
                return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def tokenized(df: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece; nth counts the task's pieces of the same length."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        part, nth = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, _, texts in slices(batch):
                rows = []
                for doc, text in zip(ids[first:], texts):
                    encoded = np.append(_encoders[tokenizer].ids(text), np.uint32(end_id))
                    n = len(encoded)
                    edges = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc, k, a, b - a, zlib.crc32(encoded[a:b]), part, nth[b - a]))
                        nth[b - a] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=PIECE)

    return by_text(df, id_col, text_col).mapInArrow(run, PIECE_DDL)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[float, list[int]]]:
    """(how often, slots of each size): the optimum of the cutting-stock relaxation, by column generation."""
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    s = np.array(sizes)
    # Demands differ by a hair, so that no step is idle; a few thousand steps bound the work whatever the lengths are.
    need = np.array(demand, float) * (1 + 1e-6 * np.modf(np.arange(1, k + 1) * 0.6180339887498949)[0])
    inverse = np.diag(1 / np.diag(basis))
    rest = np.arange(capacity + 1) - s[:, None]
    fits, rest = rest >= 0, np.maximum(rest, 0)
    for _ in range(12 * k):
        worth = inverse.sum(axis=0)
        value, choices = np.zeros(capacity + 1), []
        for _ in range(capacity // int(s.min())):  # the best configuration of one more slot at most
            gains = np.where(fits, value[rest] + worth[:, None], -1)
            best = gains.argmax(axis=0)
            gain = np.take_along_axis(gains, best[None], axis=0)[0]
            choices.append(np.where(gain > value, best, -1))
            value = np.maximum(gain, value)
        if value[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for choice in reversed(choices):
            if choice[c] >= 0:
                column[choice[c]] += 1
                c -= sizes[choice[c]]
        direction, amounts = (inverse * column).sum(axis=1), (inverse * need).sum(axis=1)
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= direction[:, None] * pivot
        inverse[out] = pivot
    return [(float(x), basis[:, j].astype(int).tolist()) for j, x in enumerate((inverse * need).sum(axis=1)) if x > 0]


class Grouping:
    """Large lengths rounded up within groups of equal cardinality, and the configurations of the rounded sizes."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int, small_share: float):
        large = sorted((n for n, c in counts.items() if c and int(capacity / small_share) < n < capacity), reverse=True)
        total = sum(counts[n] for n in large)
        # From the longest on: members are [length, number].
        most, members = -(-total // groups), [[]]
        room = most
        for n in large:
            c = counts[n]
            while c:
                if not room:
                    members.append([])
                    room = most
                x = min(c, room)
                members[-1].append([n, x])
                c, room = c - x, room - x
        self.members: dict[int, list[list[int]]] = defaultdict(list)
        for group in members if total else []:
            self.members[group[0][0]] += group
        self.sizes = sorted(self.members, reverse=True)
        self.solution = configurations(self.sizes, [sum(x for _, x in self.members[s]) for s in self.sizes], capacity) if total else []


class Plan:
    """Which sequences take which ranks of each length. A group of like sequences is [first, number, filled]."""

    def __init__(self, counts: dict[int, int], capacity: int, grouping: Grouping | None = None, share: float = 1.0):
        self.capacity, self.bins = capacity, 0
        #: (length, first rank, first sequence, pieces in each sequence, offset of the first piece)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.left = {n: c for n, c in counts.items() if c and n < capacity}
        self.rank: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [(first, number)]
        self.rooms: list[int] = []
        if grouping:
            members = {s: [list(m) for m in group] for s, group in grouping.members.items()}
            for often, slots in grouping.solution:
                self.substitute(int(share * often + 1e-6), [members[s] for s, k in zip(grouping.sizes, slots) for _ in range(k)])
        self.pack_rest()

    def take(self, length: int, number: int, first: int, each: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], first, each, offset))
        self.rank[length] += number
        self.left[length] -= number

    def offer(self, room: int, first: int, number: int) -> None:
        if number and room:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((first, number))

    def substitute(self, number: int, slots: list[list[list[int]]]) -> None:
        """Sequences of one configuration, with actual lengths in their slots."""
        while number > 0 and slots:
            heads, wanted = [], defaultdict(int)
            for slot in slots:
                if not slot:
                    return  # rounding in the solution asked for more than there is
                heads.append(slot[0])
                wanted[id(slot[0])] += 1
            run = min(number, *(h[1] // wanted[id(h)] for h in heads))
            if not run:  # one member is too few for all slots of its group: fill one sequence piece by piece
                run, heads = 1, []
                for slot in slots:
                    if not slot:
                        for h, s in heads:
                            h[1] += 1
                            if h[1] == 1:
                                s.insert(0, h)
                        return
                    h = slot[0]
                    h[1] -= 1
                    if not h[1]:
                        slot.pop(0)
                    heads.append((h, slot))
                heads = [h for h, _ in heads]
            else:
                for h in heads:
                    h[1] -= run
                for slot in slots:
                    while slot and not slot[0][1]:
                        slot.pop(0)
            offset = 0
            for h in heads:
                self.take(h[0], run, self.bins, 1, offset)
                offset += h[0]
            self.offer(self.capacity - offset, self.bins, run)
            self.bins += run
            number -= run

    def pack_rest(self) -> None:
        """Longest first into the least room that holds it; a new sequence where nothing does."""
        for n in sorted(self.left, reverse=True):
            while self.left[n]:
                at = bisect_left(self.rooms, n)
                if at == len(self.rooms):
                    self.open[self.capacity].append((self.bins, max(1, self.left[n] // (self.capacity // n))))
                    self.bins += self.open[self.capacity][-1][1]
                    insort(self.rooms, self.capacity)
                    continue
                room = self.rooms[at]
                first, number = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
                each = min(room // n, self.left[n])
                used = min(number, self.left[n] // each)
                self.take(n, used * each, first, each, self.capacity - room)
                self.offer(room - each * n, first, used)
                self.offer(room, first + used, number - used)

    def arrays(self) -> list[np.ndarray]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return [rows[:, 0] << 48 | rows[:, 1], rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4]]


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences; of equal ones the first, which uses most of its configurations."""
    groupings = [Grouping(counts, capacity, *g) for g in GROUPINGS]
    plans = [Plan(counts, capacity, g, share) for g in groupings for share in SHARES if g.solution]
    return min([*plans, Plan(counts, capacity)], key=lambda plan: plan.bins)


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = stored(tokenized(df, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    tally = pieces.where(F.col("length") < capacity).groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = tally.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length: under capacity
    keys, ranks, firsts, each, places = best_plan({r["length"]: r["n"] for r in histogram}, capacity).arrays()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, piece, start, length, crc, rank = (b.column(k) for k in range(6))
            n, r = length.to_numpy(), rank.to_numpy()
            at = np.searchsorted(keys, n << 48 | r, side="right") - 1
            step = r - ranks[at]
            sequence, offset = firsts[at] + step // each[at], places[at] + step % each[at] * n
            yield pa.RecordBatch.from_arrays([doc, piece, start, length, crc, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    short = pieces.where(F.col("length") < capacity).join(offsets, ["part", "length"]).select(*columns, (F.col("earlier") + F.col("nth")).alias("rank"))
    short = short.mapInArrow(place, ", ".join(f"{c} long" for c in (*columns, "sequence_id", "offset")))
    # A full piece is a sequence of its own, with a negative number from its task and its place in the task.
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - (F.col("part") * F.lit(1 << 33) + F.col("nth"))).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
