"""Token counts, quality rules, secret scans, line dedup and toxicity: brute force, edge cases, held-out accuracy."""

import hashlib
import math
import random
import re
import string
import tracemalloc
from collections import Counter
from itertools import combinations
from statistics import NormalDist, mean, pstdev

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomwork.llm import line_dedup, quality_rules, registry, secret_scan, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id"), (6, "née <|endoftext|> x" + "'re 're"), (7, "ab " * 400_000)]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_token_counts_match_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(5)
    pieces = [*"stmdrvle'  \n\t aZ9é中!?<>|\x1c\x85ß🙂㋿²Ⅷ", "<|endoftext|>", "'re", "'ll", " 's", "  ", "THE", "ing"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 60))) for _ in range(1500)] + ["", "a" * 5000, " " * 3000, "ab" * 3000]
    got = token_counts.counter("byte_bpe_50k.json").count(texts)
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_do_not_matter(spark, monkeypatch):
    counter = token_counts.counter("byte_bpe_50k.json")
    texts = ["it's 12 o'clock,  we'll\n\n see" * 50, "   " * 99, "x"]
    want = counter.count(texts).tolist()
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(token_counts, "CHUNK", size)
        assert counter.count(texts).tolist() == want


def test_token_counts_of_odd_rows(spark, docs_of):
    got = rows(token_counts.token_counts(docs_of(*ODD)), "doc_id", "n_bytes", "n_tokens", "over_limit")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(docs_of(*ODD).limit(0)).count() == 0


def repeated_words(text, n=8):
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({j for places in seen.values() if len(places) > 1 for i in places for j in range(i, i + n)})


def test_quality_measures_by_brute_force(spark, sf_dir, docs_of):
    random.seed(2)
    made = [(10_000 + k, " ".join(random.choices(["aé", "b", "c#", "d\n"], k=random.randint(0, 60)))) for k in range(60)]
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    given = [(-1 - k, t) for k, (_, t) in enumerate(ODD)] + made + texts
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(*given)).collect()}
    for i, text in given:
        text, r = text or "", got[i]
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        repeats = repeated_words(text)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = len(words) < 20 or 100 * repeats > 30 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_kept_documents_are_those_kept(spark, docs_of):
    good = " ".join("".join(random.choices(string.ascii_lowercase, k=6)) for _ in range(60))
    docs = docs_of((1, good), (2, "spam " * 80), (3, None), (1, good), (4, "$$$ " + good.replace(" ", "$$$ ")))
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == [(1,), (1,)]
    assert quality_rules.kept_documents(docs.limit(0)).count() == 0


def test_clean_labelled_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    judged = registry.QUERIES["op7_quality_rules"](spark, sf).join(labels, "doc_id").where("not base_failed")
    assert judged.where("not kept").count() <= 0.01 * judged.count()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(found))


def test_secret_spans(spark, docs_of):
    random.seed(1)
    parts = ["é🙂 ", "token=", "secret=token: ", "Password : '", "api_key=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "x.y-z=", "\n", " ", "AKIAAKIA", "abcdefghijkl", "ſecret=aaaaaaaaaaaaaaaa"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(400)]
    given = [(k, t) for k, t in enumerate(texts)] + [(-1, None), (-2, "")]
    found = secret_scan.secrets(docs_of(*given))
    got = {r["doc_id"]: r["s"] for r in found.select("doc_id", secret_scan.joined(F.col("base")).alias("s")).collect()}
    for i, t in given:
        assert got[i] == base_spans(t or "")


def departure(token):
    """(encoding, u) of a token, from the definitions of the three tests."""
    text = token.rstrip("=")
    patterns = ["[0-9a-f]+|[0-9A-F]+", "[A-Z2-7]+", "[A-Za-z0-9]+", ".*"]
    e = next(k for k, p in enumerate(patterns) if re.fullmatch(p, text))
    text = text.lower() if e == 0 else text.translate(str.maketrans("-_", "+/"))
    alphabet = secret_scan.ALPHABETS[e]
    size, n = len(alphabet), len(text)
    kind = lambda c: "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "other"
    expected = n / size
    chi = (sum((text.count(c) - expected) ** 2 / expected for c in alphabet) - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    pairs = [(a, b) for a in alphabet for b in alphabet]
    change = sum(kind(a) != kind(b) for a, b in pairs) / len(pairs)
    share = {k: v / size for k, v in Counter(map(kind, alphabet)).items()}
    twice = sum(share[a] * share[b] * share[c] for a in share for b in share for c in share if a != b and b != c)
    changes = sum(kind(a) != kind(b) for a, b in zip(text, text[1:]))
    runs = (changes - (n - 1) * change) / math.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * (twice - change**2))
    x = np.array([alphabet.index(c) + 1 for c in text], float)
    r = (np.mean(x[1:] * x[:-1]) - x.mean() ** 2) / x.var() if x.var() > 0 else 1.0
    return e, (chi - runs + (r + 1 / n) * math.sqrt(n)) / math.sqrt(3)


def test_battery_by_definition(spark):
    rng = random.Random(12)
    tokens = ["".join(rng.choices(alphabet, k=n)) for alphabet in (*secret_scan.ALPHABETS, "ABCDEF0123456789", string.ascii_letters + "-_", "ab") for n in (20, 33, 70)]
    tokens += ["a" * 40, "some_long_snake_case_identifier", "Donaudampfschifffahrtsgesellschaft", "QUJDREVGR0hJSktMTU5PUA=="]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.expr(secret_scan.departure("t")).alias("d")).collect()
    for r in got:
        e, u = departure(r["t"])
        assert r["d"]["encoding"] == e and math.isclose(r["d"]["u"], u, rel_tol=1e-9, abs_tol=1e-9)


def text_tokens(rng, words, encoding, n):
    """A text-like token of n characters."""
    out = ""
    while len(out) < n:
        word = rng.choice(words)
        dates = f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}"
        spelled = rng.choice(["DEAD", "BEEF", "CAFE", "FACE", "BABE", "FEED", "DECADE", "ACCEDE"])
        out += (dates if rng.random() < 0.5 else spelled, word.upper(), word.capitalize() if rng.random() < 0.9 else str(rng.randint(1, 99)), word.lower() + rng.choice("_-/"))[encoding]
    return out[:n]


def test_text_constants_are_those_of_the_documents(spark):
    rng = random.Random(3)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()]
    words = [w for t in texts for w in re.findall(r"\b[A-Za-z]{2,14}\b", t)]
    for e, row in enumerate(secret_scan.TEXT):
        for n, (centre, spread) in zip((20, *secret_scan.STRATA), row):
            found = [u for k, u in (departure(text_tokens(rng, words, e, n)) for _ in range(400)) if k == e]
            assert abs(mean(found) - centre) < 0.5 and abs(pstdev(found) - spread) < 0.4, (e, n)


def test_cut_by_brute_force(spark, docs_of):
    """The rule of Benjamini and Hochberg over all tokens of a stratum, at the resolution of the bins."""
    rng = random.Random(21)
    words = ["house", "river", "stone", "winter", "garden", "letter", "under", "market"]
    tokens = [text_tokens(rng, words, rng.choice([1, 2, 3]), rng.randint(20, 90)) for _ in range(150)]
    tokens += ["".join(rng.choices(secret_scan.ALPHABETS[e], k=rng.randint(20, 90))) for e in (1, 2, 3) for _ in range(30)]
    strata, bins = [], []
    for t in tokens:
        e, u = departure(t)
        k = sum(len(t) >= n for n in secret_scan.STRATA)
        centre, spread = secret_scan.TEXT[e][k]
        strata.append((e, k))
        bins.append(min(int(max((centre - u) / spread, 0.0) / secret_scan.BIN), secret_scan.MOST_BINS) if u <= secret_scan.RANDOM_MOST else 0)
    want = set()
    for s in set(strata):
        own = sorted((b for b, x in zip(bins, strata) if x == s), reverse=True)
        passed = [b for i, b in enumerate(own) if b and 1 - NormalDist().cdf(b * secret_scan.BIN) <= secret_scan.FALSE_SHARE * sum(x >= b for x in own) / len(own)]
        want |= {k for k, (b, x) in enumerate(zip(bins, strata)) if x == s and passed and b >= min(passed)}
    found = secret_scan.secrets(docs_of(*[(k, f"see {t} there") for k, t in enumerate(tokens)])).collect()
    assert all(r["extra"] == [] or [(x["start"], x["end"]) for x in r["extra"]] == [(4, 4 + len(tokens[r["doc_id"]]))] for r in found)
    got = {r["doc_id"] for r in found if r["extra"]}
    near = {k for k in got ^ want if departure(tokens[k])[0] is not None}
    assert len(near) <= 1 and len(got) > 40 and sum(k < 150 for k in got) <= 0.1 * len(got)


def test_random_tokens_are_found_and_words_are_not(spark, docs_of):
    random.seed(4)
    secrets = ["".join(random.choices(string.ascii_letters + string.digits + "+/", k=n)) for n in (24, 40, 64)]
    words = ["Donaudampfschifffahrtsgesellschaft", "some_long_snake_case_identifier", "a" * 40, "01234567890123456789"]
    docs = docs_of(*[(k, f"see {t} there") for k, t in enumerate(secrets + words)])
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["extra"]] for r in secret_scan.secrets(docs).collect()}
    assert [found[k] for k in range(3)] == [[(4, 4 + len(t))] for t in secrets]
    assert not any(found[k] for k in range(3, 7))


def test_secrets_of_odd_rows(spark, docs_of):
    rng = random.Random(5)
    own = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=40)) for _ in range(6000)]
    long = " ".join(x if k % 3 else f"password = '{x}'" for k, x in enumerate(own))
    one = "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=300_000))
    given = [*ODD, (20, long), (21, one), (22, f"token={own[0]}")] + [(30, f"see {own[0]} twice {own[0]}")] * 3
    found = secret_scan.secrets(docs_of(*given)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in given)
    by = {r["doc_id"]: r for r in found}
    base = [(x["start"], x["end"]) for x in by[20]["base"] if x["kind"] == "assign"]
    assert base == [(m.start(), m.end()) for m in ASSIGN.finditer(long)] and len(base) == 2000
    extra = [(x["start"], x["end"]) for x in by[20]["extra"]]
    bare = {m.span() for k, m in enumerate(re.finditer(r"[A-Za-z0-9+/]{40}", long)) if k % 3}
    assert set(extra) <= bare and len(extra) > 0.95 * len(bare) and extra == sorted(extra)
    assert [(x["start"], x["end"]) for x in by[21]["extra"]] == [(0, len(one))] and by[22]["extra"] == []
    assert len({r["s"] for r in secret_scan.secrets(docs_of(*given)).where("doc_id = 30").select(secret_scan.joined(F.col("extra")).alias("s")).collect()}) == 1
    assert secret_scan.secrets(docs_of(*ODD).limit(0)).count() == 0


def test_secret_query_keeps_base_spans(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.QUERIES["op3_secret_scan"](spark, sf_dir).collect():
        base = base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_line_dedup(spark, docs_of, sf_dir, same_rows):
    menu = "Home | About"
    docs = docs_of(*[(k, f"{menu}\ntext {k}\n\n{menu}", "a") for k in range(6)], *[(10 + k, f"{menu}\nother {k}", "b") for k in range(4)], (20, None, "a"), (21, menu, "a"), (22, "", None))
    got = dict(rows(line_dedup.deduplicated(docs), "doc_id", "text"))
    assert got[0] == "text 0\n" and got[10] == f"{menu}\nother 0" and got[20] is None and got[21] == "" and got[22] == ""
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0
    same_rows(registry.QUERIES["op2_line_dedup"](spark, sf_dir), registry.ORACLES["op2_line_dedup"])


def test_line_dedup_of_odd_rows(spark, docs_of):
    """Repeated rows, blank lines of any white space, ties with the allowed share, a very long text, names in use."""
    long = "\n".join(f"line {k % 1000}" for k in range(30_000)) + "\nmenu"
    docs = docs_of(*[(1, "menu\n\t\r\n \nown", "a")] * 8, (2, long, "a"), (3, None, "a"), *[(10 + k, f"half\n\t\r\nx{k}" if k < 5 else f"y{k}", "b") for k in range(10)])
    names = ["__site", "__bad", "__kept", "__lines", "__dropped", "a.b"]
    docs = docs.withColumns({n: F.lit(n) for n in names[:3]}).withColumn("a.b", F.lit("dot"))
    limits = {"max_ratio": 0.5, "min_pages": 5}
    out = line_dedup.deduplicated(docs, counts=("n_l", "n_d"), **limits)
    assert out.columns == [*docs.columns, "n_l", "n_d"]
    got = out.collect()
    assert {r["text"] for r in got if r["doc_id"] == 1} == {"\t\r\n "} and sum(r["doc_id"] == 1 for r in got) == 8
    by = {r["doc_id"]: r for r in got}
    assert by[2]["text"] == long.removesuffix("\nmenu") and (by[2]["n_l"], by[2]["n_d"]) == (30_001, 1) and by[3]["text"] is None
    assert by[10]["text"] == "half\n\t\r\nx0"  # on five of ten pages: no more than the share
    assert by[1]["__bad"] == "__bad" and by[1]["a.b"] == "dot"


def test_line_dedup_beyond_the_broadcast_bound(spark, docs_of, monkeypatch):
    docs = docs_of(*[(k, f"menu\n{k}", "ab"[k % 2]) for k in range(20)])
    want = rows(line_dedup.deduplicated(docs), "doc_id", "text")
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert rows(line_dedup.deduplicated(docs), "doc_id", "text") == want


@pytest.fixture(scope="module")
def toxic_scores(spark):
    sf = "/root/testdata/sf0.01"
    return registry.QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()


def test_toxicity_on_held_out_rows(toxic_scores):
    held = [r for r in toxic_scores if r["held_out"]]
    hits = sum(r["predicted"] for r in held if r["toxic"] == 1)
    assert hits >= 0.7 * sum(r["toxic"] == 1 for r in held)
    assert not any(r["predicted"] for r in held if r["toxic"] == 0)


def test_interactions_are_learned(spark, docs_of):
    random.seed(6)
    filler = ["red", "blue", "green", "stone", "river"]
    data = []
    for k in range(400):
        insult, group = random.random() < 0.5, random.random() < 0.5
        data.append((k, " ".join(random.sample(filler, 3) + ["vile"] * insult + ["zorbs"] * group), int(insult and group)))
    docs = docs_of(*[(k, t) for k, t, _ in data])
    model = toxicity.fitted(docs.select("doc_id", "text"), spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, y int"))
    pair, insult, group = model.score(["red vile zorbs", "red vile", "red zorbs"])
    assert pair > 0.9 and insult < 0.3 and group < 0.3


def test_mention_that_tells_only_beside_an_insult(spark, docs_of):
    """The mention is as frequent among clean texts as among toxic ones; only within texts with the insult does it tell."""
    rng = random.Random(8)
    filler = ["red", "blue", "green", "stone", "river"]
    data = []
    for k in range(3000):
        insult = rng.random() < 0.4
        toxic = insult and rng.random() < 0.5
        mention = toxic if insult else rng.random() < 0.5
        data.append((k, " ".join(rng.sample(filler, 3) + ["vile"] * insult + ["zorbs"] * mention), int(toxic)))
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, y int")
    model = toxicity.fitted(docs_of(*[(k, t) for k, t, _ in data]).select("doc_id", "text"), labels)
    pair, insult, mention = model.score(["red vile zorbs", "red vile", "red zorbs"])
    assert pair > 0.9 and insult < 0.3 and mention < 0.3


def test_scores_are_the_sum_over_pairs(spark):
    rng = np.random.default_rng(3)
    model = toxicity.FactorizationMachine(rng.integers(0, 2**60, 30), 0.3)
    model.w, model.v = rng.normal(size=30), rng.normal(size=(30, toxicity.RANK))
    held = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 1, 2, 9, 30)]
    got, _ = model.raw(np.repeat(np.arange(5), [len(h) for h in held]), np.array([i for h in held for i in h]), 5)
    want = [0.3 + sum(model.w[i] for i in h) + sum(model.v[i] @ model.v[j] for i, j in combinations(h, 2)) for h in held]
    assert np.allclose(got, want)


def test_fit_needs_little_beside_its_pairs(monkeypatch):
    """The fit is the gradient of every pair, in one buffer: no array of (pairs, factors) is made, and empty texts and terms
    that no text holds do no harm."""
    rng = np.random.default_rng(4)
    n, n_terms = 4_000, 500
    rows = np.repeat(np.arange(n), np.where(np.arange(n) % 7 == 0, 0, 120))
    cols = np.concatenate([np.sort(rng.choice(n_terms - 1, 120, replace=False)) for k in range(n) if k % 7])
    y = (rng.random(n) < 0.3).astype(float)
    table, got = rng.normal(size=(n_terms, 3)), np.zeros((n, 3))
    np.add.at(got, rows, table[cols])
    assert np.allclose(toxicity.SegmentSums(cols, rows, n, 3)(table), got)
    model = toxicity.FactorizationMachine(np.arange(n_terms), 0.0)
    monkeypatch.setattr(toxicity, "STEPS", 3)
    tracemalloc.start()
    try:
        model.fit(rows, cols, y)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 * len(cols)
    assert model.w[n_terms - 1] == 0 and np.isfinite(model.v).all() and model.bias < 0

def test_sample_is_bounded_by_rows(spark, docs_of):
    """An id that repeats in the documents is one row of the sample."""
    docs = docs_of(*[(k % 4, f"vile {k}" if k % 2 else f"kind {k}") for k in range(400)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, y int")
    model = toxicity.fitted(docs.select("doc_id", "text"), labels, sample_rows=3)
    assert 0 <= model.score(["vile"])[0] <= 1


def test_toxicity_of_odd_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, y int")
    model = toxicity.fitted(docs_of(*ODD).select("doc_id", "text"), none)
    assert {r["score"] < 1e-9 for r in toxicity.scored(docs_of(*ODD), model).collect()} == {True}
    assert toxicity.scored(docs_of(*ODD).limit(0), model).count() == 0
