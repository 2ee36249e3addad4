"""Operator 7, quality rules: how much of a text lies inside its own repetitions.

Words (maximal runs of anything but ASCII white space) get numbers, numbers get random 64-bit codes, and a rolling
polynomial hash over the codes gives every window of n words of a whole slice of texts at once. Windows that occur
twice or more in one text are found by one sort for the shortest length; a longer repeated window begins with a
repeated shorter one, so each further length looks only at those places. Characters covered by repeated windows of
each length, and by repeated lines, are then shares of the text's characters in words.

Defined results: null is the empty text; a text under 20 words fails; ties do not arise; repeated rows give
repeated rows; an empty table gives an empty result; other columns are not read. Texts are measured whole.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import by_text, record_batches, slices, table

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: Share of the characters in words that may lie in repeated windows of so many words (the first occurrence counts).
MAX_COVERED = {5: 0.40, 6: 0.38, 8: 0.35, 10: 0.30}
#: Share that may lie in lines equal to an earlier line of the text.
MAX_LINE_CHARS = 0.30
#: Symbols of SYMBOLS for each character in words.
MAX_SYMBOLS = 0.20
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"covered_{n}" for n in MAX_COVERED))), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x.astype(np.uint64) + BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, owner: np.ndarray, n: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (all, or those of at) where a window of n words fits into its text, and the windows' hashes with their text's code."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places = np.arange(len(codes) - n + 1) if at is None else at[at <= len(codes) - n]
    places = places[owner[places] == owner[places + n - 1]]
    h = np.zeros(len(places), np.uint64)
    for k in range(n):
        h = h * BASE + codes[places + k]
    return places, mixed(h) ^ mixed(owner[places].astype(np.uint64) * BASE)


def repeated(places: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places whose hash occurs twice or more."""
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    flags = np.zeros(len(hashes), bool)
    flags[order[1:][same]] = flags[order[:-1][same]] = True
    return places[flags]


def covered(n_words: int, starts: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in windows of n words from these places."""
    edge = np.zeros(n_words + 1, np.int32)
    edge[starts] += 1
    edge[starts + n] -= 1
    return np.cumsum(edge[:-1]) > 0


def measures(texts: list[str]) -> list[np.ndarray]:
    """The columns of SCHEMA after the id."""
    numbers: defaultdict = defaultdict(count().__next__)
    per_text, line_dups, line_chars, words = [], [], [], []
    for text in texts:
        own = text.encode().split()  # bytes split at exactly the six ASCII white-space characters
        per_text.append(len(own))
        words += own
        lines = [line for line in text.split("\n") if line.strip(WHITE)] if "\n" in text else []
        seen, dups, chars = set(), 0, 0
        if len(set(lines)) < len(lines):
            for line in lines:
                if line in seen:
                    dups += 1
                    chars += len(line) - sum(line.count(c) for c in WHITE)
                seen.add(line)
        line_dups.append(dups)
        line_chars.append(chars)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    length = np.fromiter((len(w.decode()) for w in numbers), np.int64, len(numbers))[ids] if len(ids) else np.zeros(0, np.int64)
    sizes = np.array(per_text, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    total = lambda x: np.bincount(owner, x, len(texts)).astype(np.int64)
    codes, at, covers = mixed(ids), None, {}
    for n in sorted({*MAX_COVERED, BASE_WINDOW}):
        at = repeated(*windows(codes, owner, n, at))
        covers[n] = covered(len(ids), at, n)
    symbols = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)
    chars, repeats = total(length), total(covers[BASE_WINDOW])
    shares = {n: total(length * covers[n]) for n in MAX_COVERED}
    failed = (sizes < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * sizes)
    kept = ~failed & (np.array(line_chars) <= MAX_LINE_CHARS * chars) & (symbols <= MAX_SYMBOLS * chars)
    for n, most in MAX_COVERED.items():
        kept &= shares[n] <= most * chars
    return [sizes, chars, symbols, line_dups, repeats, line_chars, *shares.values(), failed, kept]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures and verdicts of every row, in one narrow pass without a shuffle."""
    kinds = ", ".join(f"{f.name} {'boolean' if f.type == pa.bool_() else 'long'}" for f in SCHEMA)
    return by_text(df, id_col, text_col).mapInArrow(record_batches(measures, SCHEMA), kinds)


def kept_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns only.

    The verdict is a narrow UDF column, so rows are neither shuffled nor joined back by an id that may repeat."""

    @F.arrow_udf("boolean")
    def verdict(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array(np.concatenate([np.zeros(0, bool), *(measures(part)[-1] for _, _, part in slices(batch, 0))]))

    return docs.where(verdict(F.col(text_col).cast("string")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_W = r"[\x20\x09-\x0D]"


def _covered_sql(n: int) -> str:
    return f"""
g{n} AS (SELECT rid, i, list_slice(ws, i, i + {n} - 1) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM w)),
d{n} AS (SELECT rid, unnest(list(i)) AS i FROM g{n} GROUP BY rid, g HAVING count(*) > 1),
p{n} AS (SELECT DISTINCT rid, unnest(range(i, i + {n})) AS p FROM d{n}),
c{n} AS (SELECT rid, count(*) AS words, sum(length(ws[p])) AS chars FROM p{n} JOIN w USING (rid) GROUP BY rid)"""


_LENGTHS = sorted({*MAX_COVERED, BASE_WINDOW})
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '{_W}+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
{",".join(_covered_sql(n) for n in _LENGTHS)},
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c{BASE_WINDOW}.words, 0)::BIGINT AS n_repeat_words,
    (coalesce(list_sum(list_transform(ls, lambda x: length(regexp_replace(x, '{_W}', '', 'g')))), 0) - coalesce(list_sum(list_transform(list_distinct(ls), lambda x: length(regexp_replace(x, '{_W}', '', 'g')))), 0))::BIGINT AS dup_line_chars,
    {", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS covered_{n}" for n in MAX_COVERED)}
  FROM d JOIN w USING (rid) JOIN l USING (rid) {" ".join(f"LEFT JOIN c{n} ON c{n}.rid = d.rid" for n in _LENGTHS)}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {MAX_LINE_CHARS}::DOUBLE * word_chars AND n_symbols <= {MAX_SYMBOLS}::DOUBLE * word_chars
  AND {" AND ".join(f"covered_{n} <= {most}::DOUBLE * word_chars" for n, most in MAX_COVERED.items())} AS kept FROM b
"""
