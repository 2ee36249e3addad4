"""Operator 1, token counts: a byte-level BPE tokenizer compiled to deterministic transducers.

Two transducers make up the tokenizer. The *segmenter* reads (character class, next class) pairs in eight states
and annotates each transition with whether a pretoken begins there. A text's stream is cut into chunks that run
as lanes of a numpy array; each chunk gives a state map (end state for every start state), the maps are composed
by a parallel prefix scan, and so each chunk learns the state it really starts in. The *merger* reads the bytes of
one pretoken; each transition carries the number of tokens it emits (negative where a longer token takes earlier
ones back), so a pretoken's count is the sum along its path. Its states are compiled when a text first needs them.

A merger state holds what decides every later step: the places where a token still to end may have begun, each
with the last token of the valid segmentation up to there and its count relative to now. A segmentation is valid iff each pair of neighbours is what BPE makes of their joined bytes, and the last token of
a prefix is the longest vocabulary suffix that makes a valid pair with the token before it.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows; an empty table
gives an empty result; other columns of the input are not read. Texts are counted whole: a pass takes about a
million characters, or one text if that is longer.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from loomwork.llm.common import by_text, record_batches, table

LETTER, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = 8, 9, 10, 11, 12, 13, 14
#: Letters that can follow an apostrophe in a contraction have classes of their own.
CONTRACTION_LETTERS = "stmdrvle"
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, JOINED, SHORT, MAYBE = range(8)
CHUNK = 512
MOST_STATES, MOST_PRETOKENS = 200_000, 300_000


def character_classes(library: Tokenizer) -> np.ndarray:
    """The class of every code point. Where two Unicode tables at hand differ, the library itself is asked."""
    names = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((names.get(unicodedata.category(chr(x))[0], OTHER) for x in range(0x110000)), np.uint8, 0x110000)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    other = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            other[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = kind
    out[other == WHITE] = WHITE
    for x in np.flatnonzero(out != other):
        if not 0xD800 <= x < 0xE000:
            joins = [len(library.pre_tokenizer.pre_tokenize_str(c + chr(x))) == 1 for c in "a1!"]
            out[x] = next((kind for kind, yes in zip((LETTER, NUMBER, OTHER), joins) if yes), WHITE)
    out[ord(" ")], out[ord("'")] = SPACE, QUOTE
    for k, c in enumerate(CONTRACTION_LETTERS):
        out[ord(c)] = k
    return out


def segmenter() -> tuple[np.ndarray, np.ndarray]:
    """Tables [state * 256 + class * 16 + next class]: next state, and whether a pretoken begins."""
    letter = lambda c: c <= LETTER
    white = lambda c: c in (SPACE, WHITE)
    s, t, m, d, r, v, l, e = range(8)  # noqa: E741

    def fresh(c: int, after: int) -> int:
        if letter(c):
            return IN_LETTERS
        if c == NUMBER:
            return IN_NUMBERS
        if white(c):
            return IN_WHITE if white(after) or after == END else JOINED if c == SPACE else START
        if c == QUOTE and after in (s, t, m, d):
            return SHORT
        return MAYBE if c == QUOTE and after in (r, v, l) else IN_OTHER

    def step(state: int, c: int, after: int) -> tuple[int, bool]:
        if c == END:
            return START, True
        if state == SHORT:
            return START, False
        if state == MAYBE and (c, after) in ((r, e), (v, e), (l, l)):
            return SHORT, False
        if state == JOINED and not white(c):
            return (IN_LETTERS if letter(c) else IN_NUMBERS if c == NUMBER else IN_OTHER), False
        if state == IN_LETTERS and letter(c) or state == IN_NUMBERS and c == NUMBER or state == IN_OTHER and c in (OTHER, QUOTE):
            return state, False
        if state == IN_WHITE and white(c) and (white(after) or after == END):
            return IN_WHITE, False
        return fresh(c, after), True

    to, begins = np.zeros(8 * 256, np.uint8), np.zeros(8 * 256, bool)
    for state in range(8):
        for c in range(END + 1):
            for after in range(END + 1):
                to[state * 256 + c * 16 + after], begins[state * 256 + c * 16 + after] = step(state, c, after)
    return to, begins


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunks x states), in log2(chunks) parallel steps."""
    maps, shift = maps.copy(), 1
    while shift < len(maps):
        maps[shift:] = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), axis=1)
        shift *= 2
    return maps


class Merger:
    """The lazily compiled transducer of the merges within a pretoken."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: What a longer token begins with.
        self.prefixes = {t[:k] for t in ranks for k in range(len(t))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A state lists, longest first, the places where a token that is yet to end may have begun: what has been
        #: read since, the token that ends there, and the count there less the count now.
        start = ((b"", b"", 0),)
        self.keys, self.ids, self.moves = [start], {start: 0}, [{}]

    def merged(self, word: bytes) -> list[bytes]:
        """Byte pair encoding itself: what a segmentation is compared with when a pair is first met."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.ranks.get
        order = [rank(word[i : i + 2], 1 << 30) for i in range(len(word) - 1)]
        while order and (least := min(order)) < 1 << 30:
            i = order.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = rank(parts[i - 1] + parts[i], 1 << 30)
            if i < len(order):
                order[i] = rank(parts[i] + parts[i + 1], 1 << 30)
        return parts

    def valid(self, before: bytes, token: bytes) -> bool:
        key = (before, token)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2 * MOST_STATES:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(before + token) == ([before, token] if before else [token])
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """Compile the transition: (next state, tokens emitted)."""
        read = [(pending + bytes((byte,)), last, count) for pending, last, count in self.keys[state]]
        token, emitted = next((r, count + 1) for r, last, count in read if r in self.ranks and self.valid(last, r))
        key = (*((r, last, count - emitted) for r, last, count in read if r in self.prefixes), (b"", token, 0))
        if (to := self.ids.get(key)) is None:
            to = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        self.moves[state][byte] = (to, emitted)
        return to, emitted

    def count(self, word: bytes) -> int:
        if len(self.keys) > MOST_STATES:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in word:
            state, emitted = moves[state].get(byte) or self.move(state, byte)
            total += emitted
        return total


class Counts(dict):
    """Tokens of each pretoken met lately."""

    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, word: str) -> int:
        self[word] = n = self.merger.count(word.encode())
        return n


class TokenCounter:
    """Token counts of texts, as the tokenizers library gives them for a byte-level BPE file with the public split pattern."""

    def __init__(self, name: str):
        spec = json.load(open(public_tokenizers.path(name)))
        self.special = [t["content"] for t in spec["added_tokens"]]
        shown = byte_alphabet()
        self.merger = Merger({bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special})
        # A vocabulary may number its tokens in another order than it merges them.
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merger.ranks[bytes(shown[c] for c in a + b)] = i + 256
        self.known = Counts(self.merger)
        self.classes = character_classes(Tokenizer.from_file(public_tokenizers.path(name)))
        self.to, self.begins = segmenter()

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """Where pretokens begin: lanes of chunks, their state maps, a prefix scan, and the flags."""
        n = len(symbols)
        lanes = -(-n // CHUNK)
        grid = np.full(lanes * CHUNK, END * 16 + END, np.uint16)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
        flags = np.zeros((CHUNK, lanes), bool)
        maps = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
        agreed = 0
        while agreed < CHUNK and (maps != maps[:, :1]).any():
            maps = self.to[maps.astype(np.uint16) * 256 + grid[agreed][:, None]]
            agreed += 1
        now = maps[:, 0]
        for k in range(agreed, CHUNK):  # from here on a lane's state no longer depends on where it started
            at = (now.astype(np.uint16) << 8) + grid[k]
            flags[k] = self.begins[at]
            now = self.to[at]
        if agreed < CHUNK:
            maps = np.repeat(now[:, None], 8, axis=1)
        now = np.concatenate([[np.uint8(START)], composed(maps)[:-1, START]])
        for k in range(agreed):
            at = (now.astype(np.uint16) << 8) + grid[k]
            flags[k] = self.begins[at]
            now = self.to[at]
        return np.flatnonzero(np.ascontiguousarray(flags.T).reshape(-1)[:n])

    def split(self, texts: list[str]) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """Pieces of texts between special strings: whose they are, all joined, where pretokens begin, where pieces end."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.special:
                parts = [p for part in parts for p in part.split(s)] if s in text else parts
            pieces += parts
            owner += [i] * len(parts)
        # Each piece ends with a character of class END.
        joined = "\n".join(pieces) + "\n"
        symbols = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint16)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        symbols[ends] = END
        symbols[:-1] = symbols[:-1] * 16 + symbols[1:]
        symbols[-1] = END * 16 + END
        return owner, joined, self.starts(symbols), ends

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; a special string counts as one token and splits the text, as the library's default has it."""
        total = np.full(len(texts), -1, np.int64)
        if not texts:
            return total
        owner, joined, at, ends = self.split(texts)
        if len(self.known) > MOST_PRETOKENS:
            self.known.clear()
        counts = np.zeros(len(at), np.int64)
        last = np.searchsorted(at, ends)
        inner = np.ones(len(at), bool)
        inner[last] = False
        inner = np.flatnonzero(inner)
        words = map(joined.__getitem__, map(slice, at[inner].tolist(), at[inner + 1].tolist()))
        counts[inner] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(inner))
        sums = np.concatenate([[0], np.cumsum(counts)])
        np.add.at(total, owner, 1 + sums[last] - sums[np.concatenate([[0], last[:-1] + 1])])
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the byte-level alphabet: printable bytes stand for themselves, others for 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_counters: dict[str, TokenCounter] = {}


def counter(name: str) -> TokenCounter:
    """One for each Python worker."""
    if name not in _counters:
        _counters[name] = TokenCounter(name)
    return _counters[name]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of df, in one narrow pass without a shuffle."""

    def make(texts: list[str]) -> list:
        n = counter(tokenizer).count(texts)
        return [[len(t.encode()) for t in texts], n, n > limit]

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return by_text(df, id_col, text_col).mapInArrow(record_batches(make, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
