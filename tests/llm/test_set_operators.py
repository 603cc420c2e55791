"""Near duplicates, leakage, ranking and packing against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import base, leakage, near_duplicates as nd, packing, ranking

T = dt.datetime(2025, 1, 1)


def edited(rng, n, pool=400):
    base_texts = [[f"w{rng.randrange(pool)}" for _ in range(rng.choice([4, 20, 60]))] for _ in range(max(1, n // 5))]
    rows = []
    for i in range(n):
        w = list(rng.choice(base_texts))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        if rng.random() < 0.2:
            k = rng.randrange(len(w))
            w = w[k:] + w[:k]
        rows.append((f"d{i:04d}", " ".join(w), T))
    return rows


def brute(rows, shingle, threshold):
    sets = {}
    for i, t, _ in rows:
        w = base.words(t)
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


ODD = [("e1", None, T), ("e2", "", T), ("e3", "one two", T), ("e4", "…", T)]


@pytest.mark.parametrize(("hot", "block"), [(200, nd.BLOCK), (2, 3)])
def test_pairs_as_brute_force(spark, hot, block):
    rows = edited(random.Random(7), 300) + ODD
    df = spark.createDataFrame(rows, "id string, text string, written_at timestamp").withColumn("set_key", F.lit(1)).withColumn("at", F.lit(2)).withColumn("h", F.lit(3))
    cfg = nd.NearDupConfig(shingle=3, threshold=0.5, hot_bucket=hot)
    got = [(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df.union(df.limit(40)), "id", "text", "written_at", cfg, block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.5)


def test_latest_delivery_counts(spark):
    t2 = T.replace(month=2)
    rows = [("a", "one two three four", T), ("a", "five six seven eight", t2), ("b", "one two three four", T), ("c", "five six seven eight", T)]
    df = spark.createDataFrame(rows, "id string, text string, written_at timestamp")
    got = [(r.id_a, r.id_b) for r in nd.near_duplicate_pairs(df, "id", "text", "written_at", nd.NearDupConfig(shingle=3, threshold=0.5)).collect()]
    assert got == [("a", "c")]
    assert nd.near_duplicate_pairs(df.limit(0), "id", "text", "written_at", nd.NearDupConfig()).count() == 0


def test_latest_delivery_without_a_set_counts(spark):
    t2 = T.replace(month=2)
    rows = [(i, "one two three four", T) for i in "abcd"] + [("a", None, t2), ("b", " ", t2), ("c", "one two", t2)]
    df = spark.createDataFrame(rows, "id string, text string, written_at timestamp")
    members, links = nd.near_duplicate_classes(df, "id", "text", "written_at", nd.NearDupConfig(shingle=3, threshold=0.5))
    assert [tuple(r) for r in members.collect()] == [("d", "d", 1)] and links.count() == 0


def test_groups(spark):
    rows = edited(random.Random(9), 200)
    df = spark.createDataFrame(rows, "id string, text string, written_at timestamp")
    got = {r.id: r for r in nd.near_duplicate_groups(df, "id", "text", "written_at", nd.NearDupConfig(shingle=3)).collect()}
    for a, b in brute(rows, 3, 0.8):
        assert got[a].group_id == got[b].group_id
        assert got[a].class_id == got[b].class_id or got[a].links and got[b].links


def test_groups_hold_every_record(spark):
    short = [("s3", "four words stand here", T), ("s1", "Four words, stand here!", T), ("s2", "here four words stand", T), ("s4", "one", T)]
    rows = edited(random.Random(9), 60) + ODD + short
    df = spark.createDataFrame(rows, "id string, text string, written_at timestamp")
    got = {r.id: r for r in nd.near_duplicate_groups(df.union(df.limit(9)), "id", "text", "written_at").collect()}
    assert nd.near_duplicate_groups(df.union(df.limit(9)), "id", "text", "written_at").count() == len(got) and set(got) == {r[0] for r in rows}
    assert got["s1"].class_id == got["s3"].class_id == got["s3"].group_id == "s1"
    for i in ("s2", "s4", "e1", "e2", "e3", "e4"):
        assert (got[i].class_id, got[i].group_id, got[i].links) == (i, i, 0)


def test_many_copies_stay_one_class(spark):
    rows = [(f"c{i}", "the same text of several words again", T) for i in range(400)]
    members, links = nd.near_duplicate_classes(spark.createDataFrame(rows, "id string, text string, written_at timestamp"), "id", "text", "written_at")
    assert members.select("class_id").distinct().count() == 1 and members.count() == 400 and links.count() == 0


def test_hot_groups_are_joined_whole(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, -1).otherwise(F.col("id") % 50).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = base.hot_join(rows, groups, "k", share=10)
    assert sorted(r.id for r in got.collect()) == list(range(1000)) and got.where("k = -1 and least = 0 and n = 400").count() == 400
    assert base.hot_join(rows.limit(0), groups.limit(0), "k").count() == 0


def test_sketches_merge_by_maximum():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(2))
    sa, sb, sab = nd.setsketch([a, b, np.union1d(a, b)], 64)
    assert (np.maximum(sa, sb) == sab).all()
    assert (nd.setsketch([np.empty(0, np.uint64)], 8) == 0).all()


def test_joint_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        n = 2000
        common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        own = lambda: rng.integers(0, 2**63, n - len(common), dtype=np.uint64)
        x, y = np.unique(np.r_[common, own()]), np.unique(np.r_[common, own()])
        regs = nd.setsketch([x, y], 2048)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        got = nd.joint_similarity(regs[:1], regs[1:], np.array([float(len(x))]), np.array([float(len(y))]))[0]
        assert abs(got - true) < 0.05


def test_connected(spark):
    links = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (102, 101), (7, 300)]
    random.Random(1).shuffle(links)
    got = {r.u: r.component for r in nd.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {0} and got[300] == 0 and {got[i] for i in (100, 101, 102)} == {100}


@pytest.mark.parametrize("most", [leakage.MAX_BYTES, 3])
def test_leaks_as_brute_force(spark, most):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["lamp", "sea", "மழை", "Door"]) + str(rng.randrange(60)) for _ in range(n))
    items = [(f"i{k}", words(rng.choice([5, 8, 20, 40]))) for k in range(20)] + [("n", None), ("i0", words(12))]
    docs = []
    for d in range(60):
        t = words(rng.choice([3, 30, 300])).split()
        if rng.random() < 0.7:
            w = rng.choice(items[:20])[1].split()
            n = rng.choice([7, 8, 12, 40])
            at = rng.randrange(len(t) + 1)
            t[at:at] = [x.upper() + "," for x in w[:n]]
        docs.append((d, " ".join(t)))
    docs += [(900, None), (901, ""), (5, docs[5][1])]
    idf = spark.createDataFrame(items, "item_id string, text string")
    ddf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("item_id", F.lit("x"))
    got = {(r.doc_id, r.item_id): (r.windows, r.item_windows) for r in leakage.contained_items(ddf, "doc_id", "text", idf, max_bytes=most).collect()}
    grams = lambda t: {tuple(w[k : k + 8]) for w in [base.words(t)] for k in range(len(w) - 7)}
    per_item = {}
    for i, t in items:
        per_item.setdefault(i, set()).update(grams(t))
    want = {(d, i): (len(grams(t) & g), len(g)) for d, t in docs for i, g in per_item.items() if grams(t) & g}
    assert got == want and want
    assert leakage.contained_items(ddf.limit(0), "doc_id", "text", idf).count() == 0 and leakage.contained_items(ddf, "doc_id", "text", idf.limit(0)).count() == 0


def votes(rng, strengths, n, names):
    rows = []
    for k in range(n):
        a, b = rng.sample(range(len(names)), 2) if rng.random() < 0.8 else rng.sample(range(3), 2)
        p = strengths[a] / (strengths[a] + strengths[b])
        w = "tie" if rng.random() < 0.1 else "a" if rng.random() < p else "b"
        rows.append((k, "compare", names[a].upper() if k % 9 == 0 else names[a], names[b] + " ", w, T))
    return rows


RATING = "rating_id long, mode string, model_a string, model_b string, winner string, received_at timestamp"


def likelihood_ranking(wins, rounds=20000):
    """Maximum likelihood by minorisation-maximisation."""
    n = len(wins)
    p, games = np.ones(n), wins + wins.T
    for _ in range(rounds):
        new = wins.sum(axis=1) / (games / (p[:, None] + p[None, :])).sum(axis=1)
        new *= n / new.sum()
        if np.abs(new - p).max() < 1e-13:
            break
        p = new
    return p


def test_ranking_is_the_likeliest(spark):
    rng = random.Random(8)
    names = [f"m{i}" for i in range(8)]
    rows = votes(rng, [2.0**-i for i in range(8)], 1500, names)
    extra = [(9001, "chat", "m0", "m1", "a", T), (9002, "compare", "m0", "m0", "a", T), (9003, "compare", "m7", "zz", "a", T), (9004, "compare", "m7", "m0", "lost", T), (9005, "compare", None, "m0", "a", T), (3, "compare", "m7", "m0", "void", T.replace(month=5))]
    df = spark.createDataFrame(rows + extra + rows[:50], RATING)
    registry = spark.createDataFrame([(n,) for n in names], "model string")
    wins = np.zeros((8, 8))
    at = {n: i for i, n in enumerate(names)}
    for k, _, a, b, w, _ in rows:
        if k != 3:
            i, j = at[a.lower()], at[b.strip()]
            wins[i, j] += {"a": 1, "b": 0}.get(w, 0.5)
            wins[j, i] += {"a": 0, "b": 1}.get(w, 0.5)
    got = {r.model: r for r in ranking.ranking(df, registry).collect()}
    want = likelihood_ranking(wins)
    assert [got[n].strength for n in names] == pytest.approx(list(want), rel=1e-5)
    assert sorted(r.rank_no for r in got.values()) == list(range(1, 9)) and sum(r.votes for r in got.values()) == wins.sum() * 2


def strengths_apart(rng):
    """Win tables: connected, two components one above the other with an item alone, and no votes at all."""
    wins = np.zeros((9, 9))
    for i in range(8):  # sparse: neighbours only
        wins[i, i + 1], wins[i + 1, i] = rng.randrange(2, 9), rng.randrange(1, 4)
    apart = wins.copy()
    apart[4, 3] = 0  # 0..3 beat 4..7, which never beat them; 8 has no votes
    apart[7:, 8] = apart[8, 7:] = 0
    return {"connected": wins, "apart": apart, "none": np.zeros((9, 9))}


@pytest.mark.parametrize("case", ["connected", "apart", "none"])
def test_distributed_strengths_are_the_dense_ones(spark, case):
    wins = strengths_apart(random.Random(3))[case]
    names = [f"m{i}" for i in range(9)]
    table = spark.createDataFrame([(names[i], names[j], float(wins[i, j])) for i in range(9) for j in range(9) if wins[i, j]], "winner string, loser string, wins double").repartition(2)
    got = ranking._spread(table, names)
    assert list(got) == pytest.approx(list(ranking.ilsr(wins)), rel=1e-6)
    if case == "connected":
        assert list(got) == pytest.approx(list(likelihood_ranking(wins)), rel=1e-5)
        with pytest.raises(RuntimeError):
            ranking._spread(table, names, rounds=1)


def test_components_keep_their_exact_strengths():
    """An item without votes, or a component apart, doesn't move the likeliest strengths inside a component."""
    wins = strengths_apart(random.Random(3))["apart"]
    assert len(set(ranking.components(wins))) == 3
    got = ranking.ilsr(wins)
    for own in (slice(0, 4), slice(4, 8)):
        want = likelihood_ranking(wins[own, own])
        assert list(got[own] / got[own].sum()) == pytest.approx(list(want / want.sum()), rel=1e-6)
    assert np.log(got[:4]).mean() > np.log(got[4:8]).mean()


def test_ranking_without_votes(spark):
    registry = spark.createDataFrame([("a",), ("b",), (None,)], "model string")
    none = spark.createDataFrame([], RATING)
    assert [(r.model, r.rank_no) for r in ranking.ranking(none, registry).orderBy("rank_no").collect()] == [("a", 1), ("b", 2)]
    one = spark.createDataFrame([(1, "compare", "b", "a", "a", T)], RATING)
    assert [r.model for r in ranking.ranking(one, registry).orderBy("rank_no").collect()] == ["b", "a"]
    assert ranking.ranking(none, registry.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_packing_keeps_all_tokens(spark, parts):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "b", None]), rng.choice([0, 1, 30, 100, 101, 250, 37])) for i in range(900)]
    df = spark.createDataFrame(rows, "item_id long, source string, n_tokens long").repartition(parts).withColumn("window_no", F.lit(9)).withColumn("h", F.lit(1))
    got = packing.pack(df, capacity=100, window=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.item_id, []).append((r.piece_no, r.start_token, r.n_tokens))
    assert set(by) == {i for i, _, n in rows if n}
    for i, _, n in rows:
        if n:
            cut = sorted(by[i])
            assert sum(c[2] for c in cut) == n and [c[1] for c in cut] == [100 * k for k in range(len(cut))]
            assert len(cut) == 1 if n <= 100 else all(c[2] == 100 for c in cut[:-1])
    boxes = {}
    for r in got:
        boxes[r.window_no, r.container_no] = boxes.get((r.window_no, r.container_no), 0) + r.n_tokens
    assert max(boxes.values()) <= 100 and sum(boxes.values()) / (100 * len(boxes)) > 0.9
    if parts == 1:
        total = sum(n for _, _, n in rows)
        share = sum(n for _, s, n in rows if s == "hot") / total
        full = [w for w in {r.window_no for r in got}][:-1]
        for w in full:
            inside = [r for r in got if r.window_no == w]
            assert abs(sum(r.n_tokens for r in inside if r.source == "hot") - share * 1000) <= 100


def test_deficits_as_round_robin(spark):
    """The closed form gives each item the round in which a deficit counter lets it go."""
    rng = random.Random(2)
    rows = [(i, "s", rng.choice([3, 40, 77, 100])) for i in range(200)]
    got = {r.item_id: r.window_no for r in packing.pack(spark.createDataFrame(rows, "item_id long, source string, n_tokens long"), capacity=100, window=3).collect()}
    hashes = {r.item_id: r.h for r in spark.createDataFrame(rows, "item_id long, source string, n long").select("item_id", F.xxhash64("item_id").alias("h")).collect()}
    queue = sorted(rows, key=lambda r: (hashes[r[0]] % 2**64, r[0]))
    deficit, turn = 0, 0
    for i, _, n in queue:
        while deficit < n:
            deficit += 300
            turn += 1
        deficit -= n
        assert got[i] == turn - 1


def test_mixture_weights(spark):
    rows = [(i, "a" if i % 3 else "b", 10) for i in range(3000)] + [(9999, "c", 10)]
    df = spark.createDataFrame(rows, "item_id long, source string, n_tokens long")
    got = packing.pack(df, capacity=100, window=10, weights={"a": 1.0, "b": 1.0})
    first = {r.source: r.t for r in got.where("window_no < 5").groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert first == {"a": 2500, "b": 2500}
    # b is empty after window 19: its share passes to a, and windows stay full.
    later = {r.window_no: r.t for r in got.where("window_no > 20").groupBy("window_no").agg(F.sum("n_tokens").alias("t")).collect()}
    assert sorted(later) == list(range(21, 30)) and set(later.values()) == {1000}
    fills = packing.fill_report(got, 100).agg(F.sum("n_tokens").alias("n"), F.sum("containers").alias("c")).first()
    assert fills.n == 30_000 and fills.n / (fills.c * 100) > 0.99
    assert packing.pack(df, weights={"none": 1.0}).count() == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_queries(spark, data):
    from lexiloom.llm import queries

    for name, f in queries.queries().items():
        df = f(spark, data)
        assert df.count() > 0, name
    assert queries.p1_found(spark, data).columns == ["id", "line_no", "lang"] and queries.p2_found(spark, data).count() == 14
    assert queries.p8_found(spark, data).columns == ["doc_id", "item_id"] and queries.p4_found(spark, data).columns == ["sft_id", "defect"]
