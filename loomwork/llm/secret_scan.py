"""Operator 3, secret scans: fixed patterns, and random-looking tokens by a battery of tests under false-discovery control.

Base spans are the matches of three patterns (assignments of passwords and the like, access keys, long hex runs). Beyond
them every long token of base64 characters that overlaps no base span is tested. Its encoding is inferred (hex, base32,
letters and digits, base64), and three tests ask whether it is a uniform draw from that encoding's alphabet: chi-squared
over the alphabet's symbols, runs of character classes (changes between upper case, lower case, digits and the rest,
expected from the classes' shares of the alphabet), and serial correlation of neighbouring symbol numbers. Each gives a
z-score that is about 0 for a random token and high for text; their sum over the square root of three (Stouffer) is the
token's departure. A token whose departure is above ``RANDOM_MOST`` is no random one. For the others the departure is
compared with what text of that encoding and length gives (``TEXT``, measured), which yields a p-value that shrinks with
length: short tokens tell little, long ones much. Within each stratum of encoding and length the p-values are cut by
Benjamini and Hochberg's rule at ``FALSE_SHARE``. The cut comes from a histogram of z-scores (a fixed number of bins a
stratum), so it is exact up to a bin, on the safe side, and holds for any number of tokens. DataFrame and SQL functions
only; running sums are parallel prefix scans over arrays, so time grows with a text's length times the logarithm of its
matches.

Defined results: null is the empty text, without spans; spans are code points with exclusive ends; where kinds start
together they go in the order assign, access, hex, random; repeated rows give repeated rows; ties in departure fall into
the same bin and are kept or left together; an empty table gives an empty result; other columns are not read. Texts and
tokens are searched whole, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from statistics import NormalDist
from string import ascii_lowercase, ascii_uppercase, digits

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import stored, table

#: The patterns, and the least length of what counts (of group 2 for assignments).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Alphabets of the encodings, symbols in the order of their values; hex is read in lower case, - and _ as + and /.
ALPHABETS = (digits + "abcdef", ascii_uppercase + "234567", ascii_uppercase + ascii_lowercase + digits, ascii_uppercase + ascii_lowercase + digits + "+/")
CLASSES = "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"
FALSE_SHARE, BIN, MOST_BINS = 0.05, 0.05, 400
#: One random token in a thousand departs by more.
RANDOM_MOST = 4.0
#: Lengths where strata begin, after the least one of 20.
STRATA = (24, 32, 48, 64)
#: Departure (mean, standard deviation) of text of each encoding, at the least length of each stratum; measured on words
#: of the documents: runs of dates and hex words, upper case, capitalized words with numbers, words joined by _ - /.
TEXT = (
    ((5.0, 1.3), (5.5, 1.4), (6.7, 1.5), (8.9, 1.8), (10.9, 2.0)),
    ((3.5, 1.3), (4.1, 1.3), (5.4, 1.5), (7.9, 1.7), (10.3, 1.9)),
    ((3.2, 1.7), (3.8, 1.8), (5.0, 2.0), (7.2, 2.1), (9.4, 2.2)),
    ((4.9, 1.6), (5.9, 1.7), (7.5, 1.7), (11.1, 2.0), (14.4, 2.1)),
)


def let(value: str, name: str, body: str) -> str:
    """SQL for body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(lengths: str) -> str:
    """SQL for the running sums of an array of ints: in step k each place adds what stands 2^k places before it."""
    step = "IF(shiftleft(1, k) < size(x), transform(x, (v, i) -> v + IF(i >= shiftleft(1, k), x[i - shiftleft(1, k)], 0)), x)"
    return let(lengths, "d", f"aggregate(sequence(0, cast(ceil(log2(greatest(size(d), 2))) AS int)), d, (x, k) -> {step})")


def spans(text: str, pattern: str, kind: str, value: int = 0, least: int = 0, held: bool = False) -> Column:
    """Array of (start, kind number, kind, end, size) of the pattern's matches in order, with the match itself if held; of
    group ``value`` only ``least`` characters and more. Column {text}_{kind} has the pieces between matches: texts without
    a match are searched once."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = lambda group: f"regexp_extract_all({text}, '{quoted}', {group})"
    both = f"zip_with({found(0)}, {found(value)}, (m, v) -> named_struct('text', m, 'm', char_length(m), 'v', char_length(v)))"
    ends = running(f"zip_with(slice({text}_{kind}, 1, size({text}_{kind}) - 1), a, (p, w) -> char_length(p) + w.m)")
    fields = {"start": "e - w.m", "number": str(KINDS.index(kind)), "kind": f"'{kind}'", "end": "e", "size": "w.v"} | ({"text": "w.text"} if held else {})
    made = f"zip_with({ends}, a, (e, w) -> named_struct({', '.join(f'{k!r}, {v}' for k, v in fields.items())}))"
    none = f"cast(array() AS array<struct<start:int,number:int,kind:string,end:int,size:int{',text:string' * held}>>)"
    return F.expr(f"CASE WHEN size({text}_{kind}) > 1 THEN filter({let(both, 'a', made)}, x -> x.size >= {least}) ELSE {none} END")


def apart(tokens: str, others: str) -> str:
    """SQL for the tokens (in order, disjoint) that overlap none of the others: as many others begin before a token's end
    as end by its start. Both are counted along one sorted array of starts and ends."""
    event = lambda array, at, order: f"transform({array}, x -> named_struct('at', x.{at}, 'o', {order}))"
    events = f"array_sort(concat({event(others, 'end', 0)}, {event(tokens, 'start', 1)}, {event(tokens, 'end', 2)}, {event(others, 'start', 3)}))"
    flags = lambda order: running(f"transform(e, x -> IF(x.o = {order}, 1, 0))")
    count = lambda order, kept: f"transform(filter(zip_with(e, {flags(kept)}, (x, n) -> named_struct('o', x.o, 'n', n)), x -> x.o = {order}), x -> x.n)"
    clear = let(events, "e", f"zip_with({count(2, 3)}, {count(1, 0)}, (begun, ended) -> begun = ended)")
    kept = f"transform(filter(zip_with({tokens}, {clear}, (x, ok) -> named_struct('x', x, 'ok', ok)), y -> y.ok), y -> y.x)"
    return f"CASE WHEN size({tokens}) = 0 OR size({others}) = 0 THEN {tokens} ELSE {kept} END"


def class_moments(alphabet: str) -> tuple[float, float, float]:
    """Of neighbours drawn from the alphabet: the chance that their classes differ, its variance, and the covariance of
    two such changes in a row."""
    sizes = Counter(next(k for k, p in enumerate(CLASSES.split("|")) if re.match(p, c)) for c in alphabet)
    shares = [n / len(alphabet) for n in sizes.values()]
    change = 1 - sum(p * p for p in shares)
    return change, change * (1 - change), sum(p * (1 - p) ** 2 for p in shares) - change**2


def departure(token: str) -> str:
    """SQL for (encoding, u): the encoding's number, and how far a token is from a uniform draw of its alphabet."""
    encoding = "CASE WHEN s RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 0 WHEN s RLIKE '^[A-Z2-7]+$' THEN 1 WHEN s RLIKE '^[A-Za-z0-9]+$' THEN 2 ELSE 3 END"
    of = lambda values: f"array({', '.join(values)})[b.encoding]"
    moment = lambda k: of([f"{class_moments(a)[k]!r}D" for a in ALPHABETS])
    symbols = of([f"array({', '.join(repr(c) for c in a)})" for a in ALPHABETS])
    squares = f"aggregate({symbols}, 0D, (a, c) -> a + pow(b.n - char_length(replace(b.s, c, '')), 2))"
    chi = f"((b.size / b.n * {squares} - b.n - (b.size - 1)) / sqrt(2 * (b.size - 1) * (b.n - 1) / b.n))"
    changes = f"(size(regexp_extract_all(b.s, '{CLASSES}', 0)) - 1)"
    runs = f"(({changes} - (b.n - 1) * {moment(0)}) / sqrt((b.n - 1) * {moment(1)} + 2 * (b.n - 2) * {moment(2)}))"
    codes = f"transform(regexp_extract_all(b.s, '.', 0), c -> cast(instr({of([repr(a) for a in ALPHABETS])}, c) AS double))"
    sums = """aggregate(sequence(1, size(c)), named_struct('x', 0D, 'xx', 0D, 'xy', 0D),
      (a, i) -> named_struct('x', a.x + c[i - 1], 'xx', a.xx + c[i - 1] * c[i - 1], 'xy', a.xy + IF(i > 1, c[i - 1] * c[greatest(i - 2, 0)], 0D)))"""
    r = "coalesce(try_divide(q.xy / (b.n - 1) - pow(q.x / b.n, 2), q.xx / b.n - pow(q.x / b.n, 2)), 1D)"
    serial = let(let(codes, "c", sums), "q", f"(({r} + 1 / b.n) * sqrt(b.n))")
    plain = "CASE WHEN e = 0 THEN lower(s) WHEN e = 3 THEN translate(s, '-_', '+/') ELSE s END"
    held = let(f"rtrim('=', {token})", "s", let(encoding, "e", f"named_struct('s', {plain}, 'encoding', e, 'n', cast(char_length(s) AS double), 'size', cast(array({', '.join(str(len(a)) for a in ALPHABETS)})[e] AS double))"))
    return let(held, "b", f"named_struct('encoding', b.encoding, 'u', ({chi} - {runs} + {serial}) / sqrt(3D))")


def stratum(x: str) -> str:
    """SQL for the number of a tested token's stratum: by encoding, then by length."""
    length = f"({x}.span.end - {x}.span.start)"
    return f"({x}.d.encoding * {len(STRATA) + 1} + CASE " + " ".join(f"WHEN {length} < {n} THEN {i}" for i, n in enumerate(STRATA)) + f" ELSE {len(STRATA)} END)"


def bin_of(x: str) -> str:
    """SQL for the bin of a tested token's z-score against text, high where it departs from random less than text does."""
    of = lambda k: "array(" + ", ".join(f"{m[k]}D" for row in TEXT for m in row) + f")[{stratum(x)}]"
    z = f"greatest(({of(0)} - {x}.d.u) / {of(1)}, 0D)"
    return f"IF({x}.d.u <= {RANDOM_MOST}, least(cast(floor({z} / {BIN}) AS int), {MOST_BINS}), 0)"


def cuts(tokens: DataFrame, false_share: float) -> dict[int, int]:
    """Least bin that counts in each stratum, from (stratum, bin); at most MOST_BINS rows a stratum reach the driver.
    Bin 0 never counts: it holds the tokens that are no random ones."""
    tally: dict[int, dict[int, int]] = {}
    for row in tokens.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect():
        tally.setdefault(row["stratum"], {})[row["bin"]] = row["n"]
    out = {}
    for s, bins in tally.items():
        total, found = sum(bins.values()), 0
        for b in sorted((b for b in bins if b), reverse=True):
            found += bins[b]
            if 1 - NormalDist().cdf(b * BIN) <= false_share * found / total:
                out[s] = b
    return out


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, base, extra: arrays of (start, number, kind, end, size)."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", TOKEN)):
        docs = docs.withColumn(f"t_{kind}", F.split("t", pattern, -1))
    base = F.concat(spans("t", ASSIGN, "assign", 2, ASSIGN_LEAST), spans("t", ACCESS, "access"), spans("t", HEX, "hex"))
    found = docs.select("doc_id", base.alias("base"), spans("t", TOKEN, "random", held=True).alias("long"))
    found = found.withColumn("long", F.expr(apart("long", "base")))
    span = "named_struct('start', x.start, 'number', x.number, 'kind', x.kind, 'end', x.end, 'size', x.size)"
    tested = f"transform(long, x -> named_struct('span', {span}, 'd', {departure('x.text')}))"
    found = stored(found.select("doc_id", "base", F.expr(tested).alias("long")), "secrets")
    token = found.select(F.explode("long").alias("x")).select(F.expr(stratum("x")).alias("stratum"), F.expr(bin_of("x")).alias("bin"))
    least = cuts(token, false_share)
    cut = f"CASE {stratum('x')} " + " ".join(f"WHEN {s} THEN {c}" for s, c in least.items()) + f" ELSE {MOST_BINS + 1} END" if least else f"{MOST_BINS + 1}"
    return found.select("doc_id", "base", F.expr(f"transform(filter(long, x -> {bin_of('x')} >= {cut}), x -> x.span)").alias("extra"))


def joined(array: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return F.array_join(F.transform(F.array_sort(array), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "extra")).alias("spans"))
