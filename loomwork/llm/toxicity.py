"""Operator 4, toxicity: a factorization machine over hashed terms.

Terms are a text's lower-case words and their beginnings of 4, 5 and 6 characters, each a 64-bit hash. The model is
logistic(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) over the terms present, so a pair (an insult with the mention
of a group) can weigh more or less than its parts. It is fitted on a bounded sample of the labelled rows
(``SAMPLE_ROWS``, the first by a hash of the id). Terms get parameters only if the sample's counts tell: a likelihood
ratio beyond what chance gives among as many terms, either over the whole sample or among the texts that hold a term
which speaks for label 1; so a mention that tells nothing alone, but much beside an insult, is a term too. The counts
are made on the executors; the driver gets the terms chosen (``MOST_TERMS`` of either kind at most, the most telling)
and, of the sampled rows, the chosen terms they hold. Scoring is one narrow pass over
whole texts. The same rows give the same model: rows and terms are sorted before any sum.

Defined results: null is the empty text, which scores what the bias gives; with no labelled rows of both kinds every
score is the share of label 1 (0 without any); rows without a label are scored like others; repeated rows give repeated
rows (of labelled rows with one id, the least text and the highest label count); ties among terms go by their hash; very
long texts are read whole; an empty table gives an empty result; other columns are not read, and labels never enter a
score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import by_text, shipped, slices, stored, table

SAMPLE_ROWS, MOST_TERMS, RANK, STEPS, RATE, DECAY, THRESHOLD = 20_000, 4096, 8, 300, 0.05, 1e-4, 0.7
#: A chosen term has a likelihood ratio above this times the logarithm of the number of terms.
CHANCE = 1.4
PREFIXES = (4, 5, 6)
WORD = re.compile(r"\w+")


def word_terms(word: str) -> list[int]:
    """Hashes of a word and its beginnings; a whole word is marked by its end, so it differs from a beginning."""
    return [xxhash.xxh64_intdigest(t) - (1 << 63) for t in (word + "$", *(word[:n] for n in PREFIXES if len(word) >= n))]


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, label 1, label 0): in how many of the task's texts a term is."""
    both = (Counter(), Counter())
    for b in batches:
        labels = b.column(2).to_pylist()
        for first, _, texts in slices(b):
            for text, y in zip(texts, labels[first:]):
                both[y == 1].update({t for w in words(text) for t in word_terms(w)})
    terms = sorted(both[0].keys() | both[1].keys())
    for k in range(0, len(terms), 100_000):
        part = terms[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array([c[t] for t in part], pa.int64()) for c in (both[1], both[0]))], names=["term", "ones", "zeros"])


class SegmentSums:
    """Sums of table rows: the table's row picked[i] is added to segment at[i]; at is sorted. The rows are gathered into one
    buffer of about BUFFER_ROWS, a block of whole segments at a time."""

    BUFFER_ROWS = 1 << 15

    def __init__(self, picked: np.ndarray, at: np.ndarray, n: int, width: int):
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        filled, ends = at[starts], np.append(starts[1:], len(at))
        self.picked, self.out, self.blocks = picked, np.zeros((n, width)), []
        k = 0
        while k < len(starts):
            last = max(k + 1, int(np.searchsorted(ends, starts[k] + self.BUFFER_ROWS, "right")))
            self.blocks.append((int(starts[k]), int(ends[last - 1]), starts[k:last] - starts[k], filled[k:last]))
            k = last
        self.buffer = np.empty((max((end - first for first, end, _, _ in self.blocks), default=0), width))

    def __call__(self, table: np.ndarray) -> np.ndarray:
        for first, end, starts, filled in self.blocks:
            held = np.take(table, self.picked[first:end], axis=0, out=self.buffer[: end - first], mode="clip")
            self.out[filled] = np.add.reduceat(held, starts, axis=0)
        return self.out


class FactorizationMachine:
    """Terms, sorted, with weights and factors; a text is the set of its known terms."""

    def __init__(self, terms: np.ndarray, bias: float):
        self.terms, self.bias = np.sort(terms), bias
        self.index = {int(t): i for i, t in enumerate(self.terms)}
        self.w = np.zeros(len(terms))
        self.v = np.random.default_rng(7).normal(0, 0.01, (len(terms), RANK))
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def present(self, text: str) -> list[int]:
        out: set[int] = set()
        if len(self.known) > 300_000:
            self.known.clear()
        for w in words(text):
            if (got := self.known.get(w)) is None:
                got = self.known[w] = tuple(i for t in word_terms(w) if (i := self.index.get(t)) is not None)
            out.update(got)
        return sorted(out)

    def raw(self, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic, and the factor sums, of n texts given as (row, term) pairs sorted by row."""
        linear = np.bincount(rows, self.w[cols], n)
        sums = np.stack([np.bincount(rows, self.v[cols, f], n) for f in range(RANK)], axis=1)
        squares = np.bincount(rows, (self.v[cols] ** 2).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def fit(self, rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> None:
        """Adam on the whole sample; (row, term) pairs are sorted by row. Each step sums the factors over the terms of every
        row, then the errors over the rows of every term, all columns at once and in arrays that are made once."""
        n, n_terms = len(y), len(self.w)
        order = np.argsort(cols, kind="stable")
        over_terms, over_rows = SegmentSums(cols, rows, n, RANK + 2), SegmentSums(rows[order], cols[order], n_terms, RANK + 1)
        values, errors = np.empty((n_terms, RANK + 2)), np.empty((n, RANK + 1))
        m = [np.zeros(1), np.zeros_like(self.w), np.zeros_like(self.v)]
        s = [x.copy() for x in m]
        for step in range(1, STEPS + 1):
            values[:, 0], values[:, 1], values[:, 2:] = self.w, (self.v**2).sum(axis=1), self.v
            held = over_terms(values)
            z = self.bias + held[:, 0] + 0.5 * ((held[:, 2:] ** 2).sum(axis=1) - held[:, 1])
            errors[:, 0] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            np.multiply(held[:, 2:], errors[:, :1], out=errors[:, 1:])
            sent = over_rows(errors)
            g_w, g_v = sent[:, 0], sent[:, 1:] - self.v * sent[:, :1]
            for k, g in enumerate((np.array([errors[:, 0].sum()]), g_w + DECAY * self.w / n_terms, g_v + DECAY * self.v / n_terms)):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                move = RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
                if k == 0:
                    self.bias -= float(move[0])
                elif k == 1:
                    self.w -= move
                else:
                    self.v -= move

    def score(self, texts: list[str]) -> np.ndarray:
        held = [self.present(t) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(h) for h in held])
        cols = np.array([i for h in held for i in h], np.int64)
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, cols, len(texts))[0], -30, 30)))


def counted(sample: DataFrame) -> DataFrame:
    """term, ones, zeros over all rows of the sample."""
    return stored(sample.mapInArrow(_counts, "term long, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")), "terms")


def informative(counts: DataFrame, ones: int, zeros: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms whose likelihood ratio beats chance, the most telling MOST_TERMS, and those of them that speak for label 1."""
    n, n_terms = ones + zeros, counts.count()
    ratio = F.lit(0.0)
    for held, of in (("ones", ones), ("zeros", zeros)):
        total = F.col("ones") + F.col("zeros")
        for seen, expected in ((F.col(held), total * of / n), (F.lit(of) - F.col(held), (n - total) * of / n)):
            ratio = ratio + F.when((seen > 0) & (expected > 0), 2 * seen * F.log(seen / expected)).otherwise(0.0)
    chosen = counts.withColumn("ratio", ratio).where(F.col("ratio") > CHANCE * math.log(max(n_terms, 2)))
    found = chosen.orderBy(F.col("ratio").desc(), "term").limit(MOST_TERMS).collect()
    return tuple(np.array([r["term"] for r in rows], np.int64) for rows in (found, [r for r in found if r["ones"] * zeros > r["zeros"] * ones]))


def fitted(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A model from doc_id, text of docs and doc_id, y of labels; both are read as given, so leave held-out rows away."""
    shipped(docs.sparkSession)
    chosen = labels.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # a bounded table, so it may be broadcast
    held = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = stored(held, "labelled")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not ones or not zeros:
        share = ones / max(1, ones + zeros)
        return FactorizationMachine(np.zeros(0, np.int64), math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0)
    terms, speaking = informative(counted(sample), ones, zeros)
    first = FactorizationMachine(speaking, 0.0)

    def speaks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, texts in slices(b):
                yield b.slice(start, end - start).filter(pa.array([bool(first.present(t)) for t in texts], pa.bool_()))

    if len(speaking):
        near = stored(sample.mapInArrow(speaks, sample.schema), "speaking")
        within = {r["y"]: r["n"] for r in near.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if within.get(1) and within.get(0):
            terms = np.union1d(terms, informative(counted(near), within[1], within[0])[0])
    model = FactorizationMachine(terms, math.log(ones / zeros))

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, texts in slices(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), b.column(2).slice(first, end - first), pa.array([model.present(t) for t in texts], pa.list_(pa.int32()))], names=["doc_id", "y", "held"])

    rows = sorted((r["doc_id"], r["y"], r["held"]) for r in sample.mapInArrow(held, "doc_id long, y int, held array<int>").collect())
    cols = np.array([i for r in rows for i in r[2]], np.int64)
    model.fit(np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), cols, np.array([r[1] for r in rows], float))
    return model


def scored(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(texts) for _, _, texts in slices(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["doc_id", "score"])

    shipped(docs.sparkSession)
    return by_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = by_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("y"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = fitted(docs, labels.where(~held_out))
    return scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
