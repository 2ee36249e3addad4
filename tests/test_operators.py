"""Small fixtures with values worked out by hand, round trips, and edge cases."""

import math
import random
import struct
from collections import Counter
from itertools import combinations

import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import scalars
from loomwork.operators import cluster, features, graph, itemsets, recommend, relational, similarity
from loomwork.plans import graphs, mining, registry
from loomwork.sources import readers, sinks, storage
from loomwork.streaming import sketches, structured


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


@pytest.mark.parametrize("pairs, want", [(["ab", "bc", "cd"], [3, 4, 3]), (["ab", "ac", "bd", "cd", "de"], [2.5, 2.5, 3.5, 3.5, 4]), (["ab", "ac", "bc", "cd", "de", "df", "ef"], [1, 4, 4, 9, 4, 4, 1])])
def test_betweenness(spark, pairs, want):
    rows = graph.edge_betweenness(edges(spark, *pairs)).orderBy("src", "dst").collect()
    assert [r["betweenness"] for r in rows] == want


def test_two_triangles_split(spark):
    found = graph.girvan_newman(edges(spark, "ab", "ac", "bc", "cd", "de", "df", "ef")).collect()
    assert {r["id"]: r["component"] for r in found} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")}
    assert math.isclose(found[0]["q"], 6 / 7 - 0.5, abs_tol=1e-9)


def test_girvan_newman_query_goes_beyond_three_rounds(spark, monkeypatch):
    """Five cliques on a path: a bridge falls in each of four rounds, and the best split comes after the last of them."""
    starts = [0, 3, 6, 10, 13, 17]
    pairs = [p for a, b in zip(starts, starts[1:]) for p in combinations(range(a, b), 2)] + [(a - 1, a) for a in starts[1:-1]]
    monkeypatch.setattr(graphs, "supplier_graph", lambda spark, sf: spark.createDataFrame(pairs, "src long, dst long"))
    near = {n: {m for p in pairs for m in p if n in p and m != n} for p in pairs for n in p}
    degree, now, best = {n: len(s) for n, s in near.items()}, near, (-1.0, None, 0)
    turn = 0
    while any(now.values()):
        between = Counter()
        for s in now:
            far, paths, order = {s: 0}, Counter({s: 1}), [s]
            for u in order:
                for v in now[u]:
                    if v not in far:
                        far[v] = far[u] + 1
                        order.append(v)
                    if far[v] == far[u] + 1:
                        paths[v] += paths[u]
            credit = Counter()
            for v in reversed(order):
                for u in now[v]:
                    if far[u] + 1 == far[v]:
                        share = (1 + credit[v]) * paths[u] / paths[v]
                        credit[u] += share
                        between[frozenset((u, v))] += share / 2
        top = max(round(b, 5) for b in between.values())
        now, turn = {u: {v for v in s if round(between[frozenset((u, v))], 5) < top} for u, s in now.items()}, turn + 1
        part = {n: n for n in now}
        for _ in now:
            part = {n: min([part[n], *(part[m] for m in now[n])]) for n in now}
        q = sum((part[u] == part[v] and v in now[u]) / (2 * len(pairs)) - (part[u] == part[v]) * degree[u] * degree[v] / (2 * len(pairs)) ** 2 for u in now for v in now)
        if q > best[0] + 1e-12:
            best = (q, part, turn)
    assert best[2] > 3
    found = graphs.girvan_newman(spark, "").collect()
    assert {r["id"]: r["component"] for r in found} == best[1]
    assert math.isclose(found[0]["q"], best[0], abs_tol=1e-9) and found[0]["round"] == best[2]


def test_girvan_newman_keeps_a_graph_that_no_removal_betters(spark):
    found = graph.girvan_newman(edges(spark, "ab", "ac", "bc", "de", "df", "ef")).collect()
    assert {(r["id"], r["component"], r["round"]) for r in found} == {(x, "a", 0) for x in "abc"} | {(x, "d", 0) for x in "def"}


def test_graph_without_edges(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.connected_components(none).count() == graph.edge_betweenness(none).count() == graph.girvan_newman(none).count() == 0


BASKETS = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, "b"), (4, "c"), (4, "c"), (5, None)]


def test_itemsets(spark):
    rows = itemsets.baskets(spark.createDataFrame(BASKETS, "k int, v string"), "k", "v")
    as_dict = lambda df: {"".join(r["items"]): r["support"] for r in df.collect()}
    assert as_dict(itemsets.frequent_itemsets(rows, 2)) == {"a": 3, "b": 3, "c": 2, "ab": 2}
    assert as_dict(itemsets.frequent_itemsets(rows, 2, strict=True)) == {"a": 3, "b": 3}
    candidates, found = itemsets.son_itemsets(rows, 2)
    assert as_dict(found) == {"a": 3, "b": 3, "c": 2, "ab": 2}
    lines = sinks.itemset_report(candidates, found).orderBy("section", "size").collect()
    assert [r["line"] for r in lines if r["section"] == 1] == ["Frequent Itemsets:", "('a'),('b'),('c')", "('a', 'b')"]


def test_itemsets_of_every_size(spark, sf_dir):
    groups = [["abcde"] * 3, ["abc"], ["de"]]
    rows = spark.createDataFrame([(f"{g}-{k}", i) for g, group in enumerate(groups) for k, b in enumerate(group) for i in b], "basket string, item string")
    want = {"".join(c): 3 + (set(c) <= set("abc")) + (set(c) <= set("de")) for n in range(1, 6) for c in combinations("abcde", n)}
    as_dict = lambda df: {"".join(r["items"]): r["support"] for r in df.collect()}
    assert as_dict(itemsets.frequent_itemsets(rows, 3)) == want
    assert as_dict(itemsets.son_itemsets(rows, 3)[1]) == want
    held = {}
    for r in mining.brand_baskets(spark, sf_dir).collect():
        held.setdefault(r["basket"], []).append(r["item"])

    def frequent(more_than, strict):
        own = [sorted(b) for b in held.values() if len(b) > more_than]
        least = max(2, -(-len(own) * 4 // 1000)) + strict
        counts = Counter(c for b in own for n in range(1, len(b) + 1) for c in combinations(b, n))
        return {c: n for c, n in counts.items() if n >= least}

    loose, strict = frequent(0, False), frequent(3, True)
    named = lambda f: {r["items"]: r["support"] for r in f(spark, sf_dir).collect()}
    assert named(mining.frequent_itemsets) == named(mining.son_itemsets) == {",".join(c): n for c, n in loose.items()}
    assert named(mining.frequent_itemsets_strict) == {",".join(c): n for c, n in strict.items()}
    lines = {r["size"]: r["line"].count("(") for r in mining.itemset_report(spark, sf_dir).collect() if r["size"]}
    assert lines == Counter(map(len, strict))


def test_jaccard(spark):
    sets = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 1), ("b2", 2), ("b2", 2), ("b3", 2), ("b4", None)], "b string, u int")
    want = {("b1", "b2"): 1.0, ("b1", "b3"): 0.5, ("b2", "b3"): 0.5}
    for join in (similarity.jaccard_exact, similarity.jaccard_lsh):
        assert {(r["id_1"], r["id_2"]): r["similarity"] for r in join(sets, "b", "u").collect()} == want


@pytest.mark.parametrize("bucket_members", [similarity.BUCKET_MEMBERS, 1])
def test_jaccard_with_equal_sets_and_crowded_buckets(spark, monkeypatch, bucket_members):
    """A third of all sets are one; with one member a bucket every pair goes through rare members."""
    monkeypatch.setattr(similarity, "BUCKET_MEMBERS", bucket_members)
    rng = random.Random(2)
    held = {f"s{k:03}": set(range(6)) if k % 3 == 0 else set(rng.sample(range(12), rng.randint(1, 8))) for k in range(45)}
    sets = spark.createDataFrame([(k, m) for k, own in held.items() for m in own], "k string, m int")
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in combinations(sorted(held.items()), 2) if 2 * len(x & y) >= len(x | y)}
    for join in (similarity.jaccard_lsh, similarity.jaccard_exact):
        assert {(r["id_1"], r["id_2"]): r["similarity"] for r in join(sets, "k", "m").collect()} == want


def test_bucketed_sets_meet_where_bands_do(spark):
    """Buckets are those of the signatures' bands, each once: sets that agree in a band's values share a bucket, those that
    share one have chosen the same members; a small set is in few."""
    rng = random.Random(3)
    held = {k: rng.sample(range(1, 40), rng.randint(1, 9)) for k in range(40)}
    sets = spark.createDataFrame(list(held.items()), "item long, members array<int>")
    found = {}
    for r in similarity.bucketed(sets).collect():
        found.setdefault(r["item"], set()).add(r["bucket"])
        assert r["size"] == len(held[r["item"]]) and r["mask"] != 0
    a, b = similarity.coefficient_lists(similarity.HASHES)
    least = lambda own, i: min(own, key=lambda m: (a[i] * m + b[i]) % similarity.PRIME)
    for k, own in held.items():
        chosen = {tuple(sorted((least(own, i), least(own, i + 1)))) for i in range(0, similarity.HASHES, 2)}
        assert found[k] == {(x << 31) + y for x, y in chosen} and len(found[k]) <= len(own) * (len(own) + 1) // 2
    assert {r["bucket"] < 0 for r in similarity.bucketed(sets, 3, 9).collect()} <= {True, False}


def test_only_sets_that_may_be_similar_meet(spark, monkeypatch):
    """60 sets share one member and nothing else, and each has a near copy: only the near copies are looked at."""
    kept = {}
    monkeypatch.setattr(similarity, "stored", lambda df, what="step": kept.setdefault(what, df.cache()))
    held = {2 * k + j: [9999, *range(10 * k, 10 * k + 6 + j)] for k in range(30) for j in (0, 1)}
    rows = spark.createDataFrame([(k, m) for k, own in held.items() for m in own], "s long, m int")
    assert {(r["id_1"], r["id_2"]) for r in similarity.jaccard_lsh(rows, "s", "m").collect()} == {(2 * k, 2 * k + 1) for k in range(30)}
    assert kept["met"].where("id_2 is not null").count() <= 40 < 60 * 59 // 2


def test_overlap_threshold(spark):
    rng = random.Random(4)
    held = {k: set(rng.sample(range(30), rng.randint(0, 9))) | {99} for k in range(40)}
    rows = spark.createDataFrame([(k, m) for k, own in held.items() for m in own] * 2, "n int, i int")
    for least in (1, 3, 12):
        want = {(a, b): len(held[a] & held[b]) for a, b in combinations(held, 2) if len(held[a] & held[b]) >= least}
        assert {(r["src"], r["dst"]): r["weight"] for r in graph.overlapping(rows, "n", "i", least).collect()} == want


def test_overlap_of_small_and_large_nodes(spark, monkeypatch):
    """Nodes of more items than are paired meet in rare single items; also where ids are too many to broadcast."""
    rng = random.Random(6)
    held = {k: set(rng.sample(range(25), rng.randint(0, 12))) | {99} for k in range(40)}
    rows = spark.createDataFrame([(k, m) for k, own in held.items() for m in own] + [(None, 1), (1, None)], "n int, i int")
    for paired, broadcast in ((5, 500), (0, 500), (32, -1)):
        monkeypatch.setattr(graph, "MOST_PAIRED", paired)
        monkeypatch.setattr(graph, "MOST_BROADCAST", broadcast)
        for least in (2, 4):
            want = {(a, b): len(held[a] & held[b]) for a, b in combinations(held, 2) if len(held[a] & held[b]) >= least}
            assert {(r["src"], r["dst"]): r["weight"] for r in graph.overlapping(rows, "n", "i", least).collect()} == want


def test_nodes_meet_only_if_they_share_two_items(spark, monkeypatch):
    """Of 300 nodes every two share an item that all have, and neighbours share one more: only neighbours meet."""
    kept = {}
    monkeypatch.setattr(graph, "stored", lambda df, what="step": kept.setdefault(what, df.cache()))
    rows = spark.createDataFrame([(k, m) for k in range(300) for m in (9999, 2 * (k // 2))], "n int, i int")
    assert graph.overlapping(rows, "n", "i", 2).count() == 150
    assert kept["met"].count() == 150


def test_credits_of_one_root(spark):
    """A square with a tail: d has two shortest paths from a, and passes on what it and e have in halves."""
    given = edges(spark, "ab", "ac", "bd", "cd", "de")
    found = graph.credits(graph.shortest_paths(given), given).where("root = 'a'").collect()
    assert {(r["parent"], r["id"]): r["credit"] for r in found} == {("a", "b"): 2, ("a", "c"): 2, ("b", "d"): 1, ("c", "d"): 1, ("d", "e"): 1}


def test_collaborative_filtering(spark):
    rated = spark.createDataFrame([("u1", "i1", 5.0), ("u1", "i2", 3.0), ("u2", "i1", 4.0), ("u2", "i2", 2.0), ("u2", "i3", 4.0), ("u3", "i1", 1.0), ("u3", "i3", 2.0)], "user string, item string, stars double")
    pairs = spark.createDataFrame([("i1", "i2"), ("i1", "i3"), ("i2", "i3")], "item string, other string")
    weights = {(r["item"], r["other"]): r["weight"] for r in recommend.item_weights(pairs, rated).collect()}
    assert [round(weights[k], 8) for k in (("i1", "i2"), ("i1", "i3"), ("i2", "i3"))] == [0.3939193, 0.87415728, -1.0]
    targets = spark.createDataFrame([("u1", "i3"), ("new", "i1"), ("u1", "new"), ("new", "new")], "user string, item string")
    got = {(r["user"], r["item"]): r["prediction"] for r in recommend.predicted(targets, rated).collect()}
    assert got["u1", "i3"] == 5.0 and math.isclose(got["new", "i1"], 10 / 3) and got["u1", "new"] == 4.0 and got["new", "new"] == 3.0


def test_weights_of_all_pairs_over_blocks(spark, monkeypatch):
    """Items in several blocks, slices and passes; odd rows. The only exchanges hold ratings or blocks, none holds pairs."""
    for name, value in (("BLOCK_ITEMS", 7), ("CELLS", 20), ("MEETINGS", 5)):
        monkeypatch.setattr(recommend, name, value)
    rng = random.Random(5)
    stars = {(f"u{u}", f"i{i}"): float(rng.randint(1, 5)) for i in range(24) for u in rng.sample(range(12), rng.randint(1, 6))}
    odd = [("u1", "alone", None), (None, "unrated", 3.0), ("u2", None, 1.0)]
    rated = spark.createDataFrame([(*k, v) for k, v in stars.items()] + odd, "user string, item string, stars double")
    got = {(r["item"], r["other"]): (r["weight"], r["common"]) for r in recommend.item_weights(None, rated).collect()}
    items = sorted({i for _, i in stars} | {"alone", "unrated"})
    assert sorted(got) == list(combinations(items, 2))
    pairs = spark.createDataFrame(list(combinations(items, 2)), "item string, other string")
    for r in recommend.item_weights(pairs, rated).collect():
        weight, common = got[r["item"], r["other"]]
        assert common == r["common"] and math.isclose(weight, r["weight"], abs_tol=1e-9), r
    plan = recommend.item_weights(None, rated)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert recommend.item_weights(None, rated.limit(0)).count() == 0


def test_scalars(spark):
    one = spark.createDataFrame([("hG7b0MtEbXx5QzbzE6C_VA", 0, "None"), ("é", 1, "a,b"), ("", 8, None)], "s string, n long, l string")
    rows = one.select(scalars.utf8_mod(F.col("s"), 69_997), scalars.trailing_zeros(F.col("n")), scalars.list_length(F.col("l"))).collect()
    assert [tuple(r) for r in rows] == [(29127, 1, 0), (50089, 0, 2), (0, 3, 0)]


def test_city_average_and_dense_index(spark):
    reviews = spark.createDataFrame([("x", 4.0), ("x", 2.0), ("y", 5.0), ("z", 1.0)], "b string, stars double")
    cities = spark.createDataFrame([("x", "P"), ("y", "Q"), ("w", None)], "b string, city string")
    assert {tuple(r) for r in relational.average_per_group(reviews, cities, "b", "city", "stars").collect()} == {("P", 3.0), ("Q", 5.0)}
    index = relational.dense_index(spark.createDataFrame([(7,), (7,), (-3,), (None,), (100,)], "v long"), "v").collect()
    assert sorted(map(tuple, index)) == [(-3, 0), (7, 1), (100, 2)]
    names = ["b", "a", "é", "a", None, "Z", "ab"]
    index = relational.dense_index(spark.createDataFrame([(v,) for v in names], "v string"), "v").collect()
    assert sorted(map(tuple, index), key=lambda r: r[1]) == [("Z", 0), ("a", 1), ("ab", 2), ("b", 3), ("é", 4)]
    assert relational.dense_index(spark.createDataFrame([], "v string"), "v").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=80))
def test_stream_sketches(spark, keys):
    stream = spark.createDataFrame([(i + 1, i // 10, k) for i, k in enumerate(keys)], "seq long, batch long, key long")
    flags = sketches.bloom_flags(stream).collect()
    assert len(flags) == len(keys)
    assert all(r["seen_all"] for r in flags if not r["is_new"])  # no false negatives
    held = sketches.reservoir_snapshots(stream, size=5, every=3, slots=(0, 1, 2, 3, 4)).collect()
    for mark in range(3, len(keys) + 1, 3):
        own = [r for r in held if r["seqnum"] == mark]
        assert len(own) == min(mark, 5) and all(r["key"] in keys[:mark] for r in own)


def test_bfr_places_every_point(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(10 * (i % 3), 0.3), rng.gauss(-10 * (i % 3), 0.3)]) for i in range(240)]
    found, rounds = cluster.bfr(spark.createDataFrame(rows, "id long, features array<double>"), 3, rounds=2)
    placed = {r["id"]: r["cluster"] for r in found.collect()}
    assert sorted(placed) == list(range(240)) and rounds.count() == 2
    assert sum(c >= 0 for c in placed.values()) > 200


def test_bfr_keeps_blobs_apart_and_counts_every_point(spark):
    """Two tight blobs, and five single points far from them and from each other."""
    rng = random.Random(7)
    rows = [(i, [100.0 * (i % 2) + rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(300)] + [(1000 + k, [1e4 * (k + 1), -3e4 * (k + 1) ** 2]) for k in range(5)]
    found, rounds = cluster.bfr(spark.createDataFrame(rows, "id long, features array<double>"), 2, rounds=3)
    placed = {r["id"]: r["cluster"] for r in found.collect()}
    homes = [Counter(placed[i] for i in range(k, 300, 2)).most_common(1)[0] for k in (0, 1)]
    assert homes[0][0] != homes[1][0] and all(c >= 0 and n >= 120 for c, n in homes)
    assert not {placed[1000 + k] for k in range(5)} & {homes[0][0], homes[1][0]}
    turns = Counter(r["turn"] for r in spark.createDataFrame(rows, "id long, features array<double>").select(F.pmod(F.xxhash64(F.lit(0), "id"), F.lit(3)).alias("turn")).collect())
    lines = rounds.orderBy("round").collect()
    for k, r in enumerate(lines):
        assert r["ds_points"] + r["cs_points"] + r["rs_points"] == sum(turns[t] for t in range(k + 1))
    assert lines[-1]["rs_points"] == sum(c == -1 for c in placed.values())
    report = sinks.cluster_report(rounds, found).orderBy("section", "nth").collect()
    assert [r["line"] for r in report if r["section"] == 0][1].startswith("Round 1: ") and len(report) == 2 + 3 + len(rows)


def test_merging_of_close_clusters(spark):
    """0 and 1 overlap, 2 overlaps 1, 3 is far: the first three go together, and their sums add up."""
    points = [(c, [m + d, d]) for c, m in ((0, 0.0), (1, 2.0), (2, 4.0), (3, 500.0)) for d in (-1.0, 0.0, 1.0)]
    stats = cluster.summaries(spark.createDataFrame(points, "cluster long, features array<double>"))
    into = cluster.merge_close(stats, 2 * math.sqrt(2))
    assert {r["cluster"]: r["into"] for r in into.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    all_ = cluster.merged(stats.join(into, "cluster").drop("cluster").withColumnRenamed("into", "cluster"))
    assert {r["cluster"]: (r["n"], r["total"], r["squares"]) for r in all_.collect()}[0] == (9, [18.0, 0.0], [66.0, 6.0])


def test_nearest_summary_either_way(spark, monkeypatch):
    rng = random.Random(1)
    points = spark.createDataFrame([(i, i % 4, [rng.gauss(i % 4, 0.5) for _ in range(3)]) for i in range(80)] + [(99, None, [50.0, 50.0, 50.0])], "id long, cluster long, features array<double>")
    stats = cluster.summaries(points.where("cluster is not null"))
    look = lambda: sorted((r["id"], r["cluster"], r["distance"] and round(r["distance"], 9)) for r in cluster.nearest(points.select("id", "features"), stats, 6.0).collect())
    first = look()
    monkeypatch.setattr(cluster, "MOST_BROADCAST", -1)
    assert look() == first and first[-1] == (99, None, None)
    assert cluster.nearest(points.select("id", "features"), stats.limit(0), 6.0).where("cluster is null").count() == 81


def test_rating_model_learns_and_keeps_keys(spark):
    rng = random.Random(9)
    rows = [(f"u{i}", f"b{i % 17}", float(x := rng.randint(0, 9)), float(y := rng.randint(0, 1)), 1.0 + x / 3 * y + rng.gauss(0, 0.1)) for i in range(600)]
    data = spark.createDataFrame(rows, "user_id string, business_id string, x double, y double, stars double")
    train, test = data.where("substring(user_id, -1) != '7'"), data.where("substring(user_id, -1) = '7'")
    scored = features.rating_model(train, ["x", "y"], trees=20, depth=3, rate=0.3).transform(test)
    rmse = relational.error_measures(scored, "stars", "prediction").first()
    spread = test.agg(F.stddev("stars")).first()[0]
    assert rmse["n"] == 60 == scored.select("user_id", "business_id").distinct().count() and rmse["rmse"] < 0.3 * spread


def test_rating_queries(spark, sf_dir, monkeypatch):
    from loomwork.plans import ratings

    monkeypatch.setattr(ratings, "TREES", 3)
    assert len(features.EXTENDED) == 23
    known = {(r["user_id"], r["business_id"]): r["given"] for r in ratings.pairs(spark, sf_dir).collect()}
    for query in (ratings.rating_model, ratings.extended_rating_model):
        found = query(spark, sf_dir).collect()
        assert 0.02 * len(known) < len(found) < 0.1 * len(known)
        assert all(known[r["user_id"], r["business_id"]] == r["given"] and 0 < r["prediction"] < 6 for r in found)


def test_sampled_stream_by_its_hash(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    start = xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=42)
    draw = lambda seq: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", seq), seed=start)))[0] % n
    keys = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    want = sorted((k, (k - 1) // 100, draw(k), keys[draw(k)]) for k in range(1, 3001) if draw(k) in keys)
    assert sorted((r["seq"], r["batch"], r["key"], r["c_name"]) for r in registry.QUERIES["sampled_stream"](spark, sf_dir).collect()) == want


def test_stream_in_micro_batches(spark, sf_dir, tmp_path):
    events = pq.read_table(f"{sf_dir}/events.parquet")
    for k in range(3):
        pq.write_table(events.slice(k * 100, 100), tmp_path / f"events-{k}.parquet")
    stream = structured.event_stream(spark, str(tmp_path), "events-*", files_per_batch=1)
    out = structured.in_batches(stream, lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")))
    assert {r["batch"]: r["n"] for r in out.groupBy("batch").agg(F.sum("n").alias("n")).collect()} == {0: 100, 1: 100, 2: 100}
    want = Counter(events.column("event_type").to_pylist()[:300])
    assert {r["event_type"]: r["n"] for r in out.groupBy("event_type").agg(F.sum("n").alias("n")).collect()} == want


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Conf(dict):
        def get(self, key, default=None):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, getConf = "spark://x:7077", staticmethod(Conf)

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"review_id": "a", "user_id": "u", "business_id": "b", "stars": 4.0, "date": "2018-01-01"}\n')
    assert readers.json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).first()["stars"] == 4.0
    (tmp_path / "q.csv").write_text('"D","C","A","S","T","P"\n"2000-01-01","00012","x","y","z","0099"\n')
    assert tuple(readers.quoted_csv(spark, str(tmp_path / "q.csv"), {0: ("day", "string"), 1: ("customer", "int"), 5: ("product", "long")}, 6).first()) == ("2000-01-01", 12, 99)
    (tmp_path / "three.csv").write_text("user, , business, , stars\nu1, , b1, , 3.5\nu2, , b2, , 1.0\n")
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "three.csv"), readers.RATING, separator=", , ").collect()] == [("u1", "b1", 3.5), ("u2", "b2", 1.0)]
    (tmp_path / "m.csv").write_text("0,1,0.5,1.5\n1,2,2.5,3.5\n")
    assert [r["features"] for r in readers.numeric_matrix(spark, str(tmp_path / "m.csv"), 2).orderBy("id").collect()] == [[0.5, 1.5], [2.5, 3.5]]
    (tmp_path / "t.txt").write_text("user_id,x\na,1\n")
    assert readers.text_lines(spark, str(tmp_path / "t.txt"), "user_id").count() == 1
    pairs = readers.in_memory(spark, [("u", "b", 3.0)], readers.RATING)
    sinks.csv_table(pairs, str(tmp_path / "out"))
    assert readers.csv_table(spark, str(tmp_path / "out"), readers.RATING).collect() == pairs.collect()
    sinks.json_summary(pairs, str(tmp_path / "json"))
    assert readers.json_lines(spark, str(tmp_path / "json"), readers.RATING).collect() == pairs.collect()
    sinks.text_report(spark.createDataFrame([(1, "b"), (0, "a")], "n int, line string"), str(tmp_path / "text"), ["n"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()] == ["a", "b"]


def test_flags_of_attributes(spark):
    b = spark.createDataFrame([("b", None, 1, None), ("c", {"GoodForKids": "True", "NoiseLevel": "loud"}, 2, "Bars, Restaurants")], "business_id string, attributes map<string,string>, review_count long, categories string")
    rows = {r["business_id"]: r for r in features.business_features(b).collect()}
    assert (rows["b"]["kids"], rows["b"]["restaurant"], rows["b"]["noise"], rows["b"]["price"]) == (0, 0, 0, 0)
    assert (rows["c"]["kids"], rows["c"]["restaurant"], rows["c"]["noise"], rows["c"]["caters"]) == (2, 2, 1, 0)
