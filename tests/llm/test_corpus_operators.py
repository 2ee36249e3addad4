"""Chat formatting, mixing, near duplicates, top-k and packing, and the pipeline: brute force, round trips, edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomwork.llm import best_fit_packing, chat_formatting, exact_top_k, near_duplicates, registry, source_mixing
from loomwork.llm.components import connected

ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (4, "one two"), (None, "no id"), (7, "ab " * 200_000)]


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "<<SYS>>\\n<s>", "<\\/s>", "é🙂\n\n", "", None]
    turns = [(c, t, random.choice(["user", "assistant", "a\nb</s>", None]), said[(c + t) % len(said)]) for c in range(30) for t in range(c % 5 + 1)] + [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (7, 0, "user", "tie")]
    random.seed(3)
    df = spark.createDataFrame(random.sample(turns, len(turns)), "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    want = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want[c].append((role or "", text or ""))
    rows = chat_formatting.chat_formatted(df).collect()
    lone = [chat_formatting.read_back(r["formatted"]) for r in rows if r["conv_id"] is None]
    assert sorted(lone) == sorted([turn] for turn in want.pop(None))
    got = {r["conv_id"]: r for r in rows if r["conv_id"] is not None}
    assert got.keys() == want.keys()
    for c, r in got.items():
        assert chat_formatting.read_back(r["formatted"]) == want[c]
        loss = [chat_formatting.unescaped(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"])]
        assert loss == [t for role, t in want[c] if role == "assistant"]
        assert r["formatted"].count("</s>") == len(want[c]) == r["n_turns"]
    assert chat_formatting.chat_formatted(df.limit(0)).count() == 0


def test_chat_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = defaultdict(list)
    for r in rows:
        want[r["conv_id"]].append((r["role"], r["text"] or ""))
    want[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["conv_id"]: r for r in registry.QUERIES["op5_chat_formatting"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))


def shares(sizes):
    """Target of each source, by resharing until none is above three times its words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped = {}
    while True:
        free = [s for s in names if s not in capped]
        rest, w = sum(sizes.values()) - sum(capped.values()), sum(weight[s] for s in free)
        target = capped | {s: rest * weight[s] / w for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, docs_of):
    random.seed(8)
    given = [(k, "w " * random.randint(0, 300), random.choice(["a", "b", "c", "d", None, "é"])) for k in range(500)] + [(900, None, "zz"), (901, "x " * 5000, "a"), (902, "y y", "tiny"), (902, "y y", "tiny")]
    first, again = ([tuple(r) for r in source_mixing.mixed(docs_of(*given)).orderBy("doc_id").collect()] for _ in range(2))
    assert first == again and len(first) == len(given)
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len((t or "").split())
    target, taken = shares(sizes), Counter()
    source = {i: s for i, _, s in given}
    for i, size, source_size, goal, got, slot in first:
        assert source_size == sizes[source[i]] and abs(goal - target[source[i]]) < 1e-6 and 0 <= got <= 3 * size
        assert (slot is None) == (got == 0)
        taken[source[i]] += got
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def mixed_by_hand(given, golden):
    """(taken, first slot) of each row (id, text, source), slot by slot."""
    sizes = [len((t or "").split()) for _, t, _ in given]
    total, names = Counter(), sorted({s for _, _, s in given}, key=lambda s: (s is None, s or ""))
    for (_, _, s), n in zip(given, sizes):
        total[s] += n
    block = max(1, -(-sum(sizes) // max(source_mixing.LEAST_SLOTS, len(given) // source_mixing.DOCS_PER_SLOT)))
    goal = {s: math.floor(t + 0.5) for s, t in shares(total).items()}
    blocks = {s: -(-total[s] // block) for s in names}
    needed = {s: goal[s] // total[s] * blocks[s] + -(-(goal[s] % total[s]) // block) if total[s] else 0 for s in names}
    every, rank, slots = sum(needed.values()), Counter(), []
    edges = np.cumsum([0, *(needed[s] for s in names)]) / every
    for n in range(every):
        s = names[int(np.searchsorted(edges, (n + 0.5) * golden % 1.0, "right")) - 1]
        slots.append((s, rank[s], n))
        rank[s] += 1
    slots += [(s, r, every + r) for s in names for r in range(rank[s], needed[s])]
    takes = defaultdict(list)
    for s, r, n in slots:
        epoch, at = divmod(r, blocks[s])
        left = min(goal[s] - epoch * total[s] - at * block, block, total[s] - at * block)
        if left > 0:
            takes[s, at].append((n, left))
    place = lambda i: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)))[0]
    begin, out = Counter(), {}
    for k in sorted(range(len(given)), key=lambda k: (place(given[k][0]), sizes[k])):
        s, b = given[k][2], begin[given[k][2]]
        begin[s] += sizes[k]
        parts = [(n, max(0, min(b + sizes[k], at * block + left) - max(b, at * block))) for at in range(b // block, -(-(b + sizes[k]) // block)) for n, left in takes[s, at]]
        out[given[k][0]] = (sum(x for _, x in parts), min((n for n, x in parts if x), default=None))
    return out


def test_mixing_by_hand(spark, docs_of, monkeypatch):
    """Every document's words, and where the schedule puts it; other points put it elsewhere."""
    rng = random.Random(18)
    given = [(k, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "c", None])) for k in range(250)] + [(901, "x " * 9000, "a"), (902, "y", "tiny")]
    seen = []
    for golden in (source_mixing.GOLDEN, math.sqrt(2) - 1):
        monkeypatch.setattr(source_mixing, "GOLDEN", golden)
        got = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in source_mixing.mixed(docs_of(*given)).collect()}
        assert got == mixed_by_hand(given, golden)
        seen.append(got)
    assert sum(seen[0][k][1] != seen[1][k][1] for k in seen[0]) > 150


def test_mixture_stands_in_the_order_of_the_schedule(spark, docs_of, monkeypatch):
    given = [(k, "w " * 50, "ab"[k % 2]) for k in range(600)]
    orders = []
    for golden in (source_mixing.GOLDEN, math.sqrt(2) - 1):
        monkeypatch.setattr(source_mixing, "GOLDEN", golden)
        rows = [(r["doc_id"], r["source"]) for r in source_mixing.mixed_documents(docs_of(*given)).collect()]
        for k in range(60, len(rows), 60):  # sources a and b weigh 1 and 2
            assert abs(sum(s == "a" for _, s in rows[:k]) - k / 3) < 8
        orders.append(rows)
    assert orders[0] != orders[1] and Counter(orders[0]) == Counter(orders[1])


def test_mixing_splits_buckets_that_one_id_fills(spark, docs_of, monkeypatch):
    monkeypatch.setattr(source_mixing, "CROWDED_ROWS", 20)
    monkeypatch.setattr(source_mixing, "ROWS_PER_BUCKET", 8)
    given = [(None, "w w w", "a")] * 120 + [(k, "w " * (k % 7), "ab"[k % 2]) for k in range(200)]
    rows = source_mixing.mixed(docs_of(*given)).collect()
    sizes = Counter()
    for _, t, s in given:
        sizes[s] += len(t.split())
    assert len(rows) == len(given) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(shares(sizes).values())) <= 2


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 300, 0.0, 0.3), (1, 700, 0.3, 1.0)], "src int, needed long, lo double, hi double")
    slots = sorted((r["n"], r["src"], r["rank"]) for r in source_mixing.schedule(sources, 1000).collect())
    for k in range(100, 1000, 50):
        assert abs(sum(s == 0 for _, s, _ in slots[:k]) - 0.3 * k) < 4
    for s in (0, 1):
        ranks = [r for _, x, r in slots if x == s]
        assert ranks == list(range(len(ranks))) and len(ranks) >= (300, 700)[s]


def test_mixed_documents_and_odd_rows(spark, docs_of):
    docs = docs_of(*ODD)
    assert source_mixing.mixed(docs).count() == len(ODD) and source_mixing.mixed(docs.limit(0)).count() == 0
    mixed = source_mixing.mixed_documents(docs_of(*[(k, "w " * 50, "ab"[k % 2]) for k in range(60)]))
    assert mixed.columns == docs.columns
    count = Counter(r["source"] for r in mixed.collect())
    assert count["a"] == 20 and count["b"] == 40


def weighted(text):
    w = text.encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes_by_brute_force(texts):
    bags, root = [weighted(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if texts[i] == texts[j] or common and common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_duplicates_by_brute_force(spark, docs_of):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(5000)]
    texts = []
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(3, 200))
        for _ in range(random.randint(1, 12)):
            own = list(base)
            for _ in range(random.randint(0, max(1, len(own) // 60))):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append(" ".join(own))
    texts += ["", "", " ", "one", "one", "one two"]
    got = dict((r["doc_id"], r["class_id"]) for r in near_duplicates.near_duplicates(docs_of(*enumerate(texts))).collect())
    assert [got[k] for k in range(len(texts))] == classes_by_brute_force(texts)


def test_near_duplicates_within_hot_buckets(spark, docs_of):
    """Hundreds of texts with 78 % of their shingles in common, in pairs at a similarity just above 0.8."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(160)]
    texts = []
    for k in range(130):
        own = [f"t{k}x{i}" for i in range(44)]
        texts += [" ".join(common + own), " ".join(common + own[:22] + [f"u{k}x{i}" for i in range(22)])]
    rng.shuffle(texts)
    got = dict((r["doc_id"], r["class_id"]) for r in near_duplicates.near_duplicates(docs_of(*enumerate(texts))).collect())
    want = classes_by_brute_force(texts)
    assert len(set(want)) == 130
    assert [got[k] for k in range(len(texts))] == want


def exact_classes(texts):
    """Least index of each text's class, by an exact join on prefixes of rare shingles."""
    bags = [weighted(t) for t in texts]
    often = Counter(x for b in bags for x in b)
    cells = [sorted(((often[x], x, j) for x, n in b.items() for j in range(n)), key=lambda c: (c[0], c[1], c[2])) for b in bags]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def link(i, j):
        a, b = sorted((find(i), find(j)))
        root[b] = a

    same, holders = {}, defaultdict(list)
    for i, t in enumerate(texts):
        if t in same:
            link(same[t], i)
            continue
        same[t] = i
        n = len(cells[i])
        met = {j for cell in cells[i][: n - math.ceil(0.8 * n - 1e-9) + 1] if cell[0] > 1 for j in holders[cell[1:]]}
        for j in met:
            if find(i) != find(j) and min(n, len(cells[j])) >= 0.8 * max(n, len(cells[j])):
                common = sum((bags[i] & bags[j]).values())
                if common >= 0.8 * (n + len(cells[j]) - common):
                    link(i, j)
        for cell in cells[i][: n - math.ceil(0.8 * n - 1e-9) + 1]:
            holders[cell[1:]].append(i)
    return [find(i) for i in range(len(texts))]


def test_two_thousand_pairs_on_one_template(spark, docs_of):
    """Pairs at a similarity of 0.843 whose texts all have a template in common (0.72 between pairs): no link is lost."""
    rng = random.Random(6)
    common = [f"c{k}" for k in range(248)]
    given = []
    for k in range(2000):
        own = [f"t{k}x{i}" for i in range(23)]
        given += [(2 * k + j, " ".join(common + own + [f"{j}v{k}x{i}" for i in range(25)])) for j in (0, 1)]
    a, b, c = (weighted(given[k][1]) for k in (0, 1, 2))
    alike = lambda x, y: sum((x & y).values()) / sum((x | y).values())
    assert 0.84 < alike(a, b) < 0.845 and 0.71 < alike(a, c) < 0.725
    rng.shuffle(given)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.near_duplicates(docs_of(*given)).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(2000))


def test_classes_of_ten_thousand_documents(spark):
    """Against the exact join in Python: every class, hence a recall of 1."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text is not null").orderBy("doc_id").collect()
    want = exact_classes([r["text"] for r in rows])
    got = {r["doc_id"]: r["class_id"] for r in registry.QUERIES["op8_near_duplicates"](spark, "/root/testdata/sf0.1").collect()}
    assert [got[r["doc_id"]] for r in rows] == [rows[k]["doc_id"] for k in want]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.random(400), rng.random(400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    text = np.repeat([0, 1], 400)
    signs = near_duplicates.dart_signatures(text, np.tile(h, 2), 2, np.r_[a, b], k=2000)
    assert (signs != 0).all() and abs((signs[0] == signs[1]).mean() - want) < 0.04


def test_near_duplicates_of_odd_rows(spark, docs_of):
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_duplicates.near_duplicates(docs_of(*ODD)).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (None, None), (7, 7)], key=repr)
    assert near_duplicates.near_duplicates(docs_of(*ODD).limit(0)).count() == 0
    kept = near_duplicates.first_of_each(docs_of(*ODD))
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, None, 7], key=repr)


def test_components(spark):
    random.seed(9)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = dict(map(tuple, connected(spark.createDataFrame(pairs, "u long, v long")).collect()))
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for u, v in pairs:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root.setdefault(a, a)
            root[b] = a
    assert got == {x: find(x) for x in root}


def brute_top(ids, vectors, k=5):
    big = [[math.floor(256 * Fraction(float(c))) for c in x] for x in vectors]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    out = []
    for i, q in enumerate(ids):
        if q is not None and q % 50 == 0:
            rest = sorted((-dot(big[i], big[j]), ids[j]) for j in range(len(big)) if j != i and len(big[j]) == len(big[i]))
            out += [(q, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(rest[:k])]
    return sorted(out)


def test_top_k_by_brute_force(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute_top([r["vec_id"] for r in rows], [r["embedding"] for r in rows])
    assert sorted(map(tuple, registry.QUERIES["op9_exact_top_k"](spark, sf_dir).collect())) == want
    monkeypatch.setattr(exact_top_k, "SHARD_ROWS", 16)
    monkeypatch.setattr(exact_top_k, "BLOCK_ROWS", 1)
    assert sorted(map(tuple, registry.QUERIES["op9_exact_top_k"](spark, sf_dir).collect())) == want


def test_top_k_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, -0.5]), (3, [1.0, 3.0]), (4, [1.0, 2.0]), (5, [1.0, 9.0]), (6, [1.0, 7.0]), (7, None), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (50, [-1.0, -1.0]), (100, [5.0]), (11, [1e30, 0.0]), (150, []), (12, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("row", F.lit(2))
    found = exact_top_k.exact_top_k(df, F.pmod("vec_id", F.lit(50)) == 0)
    good = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    assert sorted(map(tuple, found.collect())) == brute_top([r[0] for r in good], [r[1] for r in good])
    assert exact_top_k.exact_top_k(df.limit(0), F.pmod("vec_id", F.lit(50)) == 0).count() == 0


def test_top_k_of_large_components(spark, monkeypatch):
    """No component is too large: scores are exact in 64 bits and beyond, and only what is shown is cut to a long."""
    big = [(k * 50, [float(k + 1) * 2**16, 3.0]) for k in range(4)] + [(1, [600000.0, 3.0]), (350, [600000.0, 3.0]), (2, [1e30, -1e30]), (400, [-1e30, 1e30]), (3, [1e308, 1e-300]), (450, [-1.7e308, 2.5]), (4, [2.0**40 + 1, 1.0]), (5, [2.0**40, 1.0])]
    for rows in (8192, 2):
        monkeypatch.setattr(exact_top_k, "SHARD_ROWS", rows)
        got = exact_top_k.exact_top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.pmod("vec_id", F.lit(50)) == 0)
        assert sorted(map(tuple, got.collect())) == brute_top(*zip(*big))


def test_bytes_sort_as_integers():
    rng = random.Random(1)
    numbers = [0, 1, -1, 255, 256, -255, -256, -257] + [rng.randint(-(2 ** (k * 9)), 2 ** (k * 9)) for k in range(1, 200)]
    assert sorted(numbers) == sorted(numbers, key=exact_top_k.sortable)


def check_packing(rows, given, capacity=1024):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in given:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], np.uint32)
        edges = [0, *range(len(ids) % capacity or min(len(ids), capacity), len(ids), capacity), len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, sf_dir, docs_of):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check_packing(registry.QUERIES["op10_best_fit_packing"](spark, sf_dir).collect(), given)
    assert used <= 1.05 * least
    odd = [*ODD, (8, "x <|endoftext|> y"), (9, " " * 200_000)]
    check_packing(best_fit_packing.packed(docs_of(*odd)).collect(), odd)
    assert best_fit_packing.packed(docs_of(*odd).limit(0)).count() == 0


@pytest.mark.parametrize("low, high, number", [(1, 1024, 50_000), (300, 1024, 3000), (1, 60, 900), (341, 342, 3001), (600, 601, 7), (1, 1024, 3)])
def test_plan_is_near_the_bound(low, high, number):
    lengths = np.sort(np.random.default_rng(5).integers(low, high, number))
    counts = Counter(lengths.tolist())
    plan = best_fit_packing.best_plan(dict(counts), 1024)
    keys, ranks, firsts, each, places = plan.arrays()
    rank = np.concatenate([np.arange(counts[n]) for n in sorted(counts)])
    at = np.searchsorted(keys, lengths << 48 | rank, side="right") - 1
    step = rank - ranks[at]
    sequence, offset = firsts[at] + step // each[at], places[at] + step % each[at] * lengths
    assert len(set(zip(sequence.tolist(), offset.tolist()))) == number and (offset + lengths <= 1024).all()
    filled = np.bincount(sequence, lengths)
    assert (filled <= 1024).all() and (filled == np.bincount(sequence, lengths)).all()
    alone = (lengths > 512).sum()
    assert len(filled) <= max(alone, lengths.sum() / 1024) * 1.12 + 2 or low > 200


@pytest.mark.parametrize("low, high, number", [(1, 1024, 60_000), (200, 600, 8000), (300, 1024, 5000), (1, 60, 900)])
def test_best_plan_is_no_worse_than_best_fit(low, high, number):
    counts = dict(Counter(np.random.default_rng(8).integers(low, high, number).tolist()))
    assert best_fit_packing.best_plan(counts, 1024).bins <= best_fit_packing.Plan(counts, 1024).bins


def test_grouping_beats_best_fit_where_three_fit():
    """Three lengths that fill a sequence exactly; best fit, longest first, takes two of the longest together."""
    counts = {420: 200, 310: 200, 294: 200}
    assert best_fit_packing.Plan(counts, 1024).bins > 200 == best_fit_packing.best_plan(counts, 1024).bins


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = [r for r in docs.collect()]
    names = docs.columns
    held = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = held.collect()
        held = stage(spark, held, sf_dir)
        if k < 4:
            assert held.columns == names
        rows = held.collect()
        if name == "near duplicates":
            texts = [r["text"] for r in rows]
            roots = classes_by_brute_force(texts)
            assert roots == list(range(len(texts)))
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in before}
        if name == "line dedup":
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) or r["n_chars"] == {x["doc_id"]: x for x in base}[r["doc_id"]]["n_chars"] for r in rows)
        if k == 3:
            mixed = [(r["doc_id"], r["text"]) for r in rows]
    check_packing(rows, mixed)


def test_stages_take_odd_rows(spark):
    """Each stage by itself: what it does with nulls, empty and very long texts, repeated rows, and columns of its own names."""
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], schema)
    names = ["__key", "__row", "__mix", "__lines", "__dropped", "__bad"]
    odd = odd.withColumns({n: F.lit(n) for n in names}).withColumn("a.b", F.lit("dot"))
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    everyone = sorted((i for i, _ in ODD), key=repr)
    want = {"quality rules": [], "line dedup": everyone, "near duplicates": sorted([1, 2, 3, 4, 7, None], key=repr), "source mixing": sorted([4, 4, 7, None], key=repr)}
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, odd, "/root/testdata/sf0.001"), stage(spark, odd.limit(0), "/root/testdata/sf0.001")
        assert empty.count() == 0
        if name in want:
            assert ids(out) == want[name] and out.columns == empty.columns == odd.columns
            assert all(r["a.b"] == "dot" and r["__key"] == "__key" for r in out.collect())
    check_packing(out.collect(), ODD)


def test_chat_of_a_very_long_text(spark):
    long = "é<s> " * 300_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    r = chat_formatting.chat_formatted(df).first()
    assert chat_formatting.read_back(r["formatted"]) == [("user", long), ("assistant", long), ("assistant", long)]
    assert [chat_formatting.unescaped(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"])] == [long, long]


def test_sizes_are_words_of_ascii_white_space():
    text = "a b \x1c c d\x0be"
    assert len(text.encode().split()) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
