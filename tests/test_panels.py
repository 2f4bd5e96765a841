"""Panels and random panels without ordering or joining what lies outside them."""

from hashlib import md5

from sievework.functions.ordering import leading
from sievework.operators import enrichment as en
from sievework.operators import ranking as ra
from sievework.operators.folds import random_panels


def test_random_panels_follow_the_hash_order_of_large_and_repeated_pools(spark):
    pools = {"a": [f"f{i}" for i in range(1500)], "b": ["one"] * 1200 + ["two"], "c": ["x", "y"]}
    rows = [(d, f) for d, names in pools.items() for f in names]
    got: dict = {}
    drawn = random_panels(spark.createDataFrame(rows, "dataset string, feature string"), 4, 3, 9, ["dataset"])
    for r in sorted(drawn.collect(), key=lambda r: r.position):
        got.setdefault((r.dataset, r.draw_id), []).append(r.feature)
    assert got == {
        (d, i): sorted(names, key=lambda f: md5(f"9|{i}|{d}|{f}".encode()).hexdigest())[:4]
        for d, names in pools.items()
        for i in (1, 2, 3)
    }


def test_leading_keeps_the_first_and_few_more(spark):
    rows = [("a", f"f{i}", float(i * 7919 % 5003)) for i in range(4000)]
    rows += [("a", "n", None), ("a", "x", float("nan")), (None, "only", None), ("b", "t", 1.0), ("b", "u", 1.0)]
    near = leading(spark.createDataFrame(rows, "k string, feature string, score double"), ["k"], "score", "feature", 10)
    got = [tuple(r) for r in near.collect()]
    first = sorted((r for r in rows if r[0] == "a" and r[2] == r[2] and r[2] is not None), key=lambda r: -r[2])[:10]
    assert set(first) <= set(got) and len([r for r in got if r[0] == "a"]) < 200
    assert {r for r in got if r[0] != "a"} == {(None, "only", None), ("b", "t", 1.0), ("b", "u", 1.0)}


def test_edges_among_panels_count_like_the_edges_of_the_pool(spark):
    edge = spark.createDataFrame([(f"f{i}", f"f{(i * 3 + 1) % 40}") for i in range(40)], "src string, dst string")
    pool = spark.createDataFrame([(s, f"f{i}") for s in (1, 2) for i in range(s, 38)], "split int, feature string")
    panel = spark.createDataFrame([(s, f"f{i}") for s in (1, 2) for i in (0, 1, 2, 4, 7, 13, 39)], "split int, feature string")
    drawn = random_panels(pool, 8, 2, 3, ["split"])
    near = en.edges_among(edge, pool, ["split"], panel, drawn)
    whole = en.restrict_edges(edge, pool, ["split"])
    assert 0 < near.count() < whole.count()
    for rows, keys in ((panel, ["split"]), (drawn.select("split", "draw_id", "feature"), ["split", "draw_id"])):
        counts = [sorted(map(tuple, en.induced_edge_count(e, rows, keys, ["split"]).collect())) for e in (near, whole)]
        assert counts[0] == counts[1]


def test_first_of_a_consensus_are_those_of_the_whole(small_tasks):
    rows = [(m, s, f"f{i:03}", (i * 37 + s * m * 11) % 90 + 1) for m in (1, 2) for s in (1, 2, 3) for i in range(90)]
    ranking = small_tasks.createDataFrame(rows, "method int, split int, feature string, rank int")
    whole = ra.consensus_rank(ranking, ["method"], ["split"])
    first = ra.consensus_rank(ranking, ["method"], ["split"], first=7)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, whole.where("rank <= 7").collect()))
    panel = ra.lock_panels(ranking, ["method"], ["split"], [3, 7], ranking.select("feature"), 0.5, {"source": "x"})
    assert "Window" not in panel._jdf.queryExecution().optimizedPlan().toString()


def test_pool_targets_at_every_cutoff(spark):
    pools = spark.createDataFrame([("d", f) for f in "abcd"] + [("e", "a"), ("f", "z")], "dataset string, feature string")
    scores = spark.createDataFrame(
        [("a", 0.05), ("b", 0.5), ("c", None), ("d", 0.01), ("q", 0.9)], "feature string, score double"
    )
    found = en.pool_targets(pools, scores, ["dataset"], [0.05, 0.5])
    assert {tuple(r) for r in found.collect()} == {("d", 0.05, 2), ("d", 0.5, 1), ("e", 0.05, 1), ("e", 0.5, 0)}
    assert found.columns == ["dataset", "cutoff", "pool_targets"]


def test_edges_meet_their_splits_as_bits(spark, monkeypatch):
    """Edges are not copied for every split before both ends are known; rows are those of joins by split."""
    edges = [(f"f{i}", f"f{j}") for i in range(30) for j in (i, (i * 7 + 3) % 30, (i + 1) % 30, (i * 7 + 3) % 30)]
    edge = spark.createDataFrame([*edges, (None, "f1"), ("f1", None)], "src string, dst string")
    rows = [("d", s, f"f{i}") for s in range(130) for i in range(30) if (i * s) % 11 < 4]
    rows += [rows[0], ("d", None, "f1"), (None, 3, "f2"), ("d", 4, None)]
    pool = spark.createDataFrame(rows, "dataset string, split int, feature string")
    for dedupe in (True, False):
        found = en.restrict_edges(edge, pool, ["dataset", "split"], dedupe)
        sent = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x]
        assert sent and not any("split" in x or "dataset" in x for x in sent if "src" in x or "dst" in x)
        with monkeypatch.context() as m:
            m.setattr(en, "MOST_BITS", 0)
            joined = en.restrict_edges(edge, pool, ["dataset", "split"], dedupe)
        assert found.columns == joined.columns
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, joined.collect())) != []
    none = en.restrict_edges(edge, pool.where("false"), ["dataset", "split"])
    assert none.collect() == []


def test_edges_among_panels_without_random_ones(spark):
    edge = spark.createDataFrame([(f"f{i}", f"f{(i * 3 + 1) % 40}") for i in range(40)], "src string, dst string")
    pool = spark.createDataFrame([(s, f"f{i}") for s in (1, 2) for i in range(s, 38)], "split int, feature string")
    panel = spark.createDataFrame([(s, f"f{i}") for s in (1, 2) for i in (0, 1, 2, 4, 7, 13, 39)], "split int, feature string")
    near, whole = en.edges_among(edge, pool, ["split"], panel), en.restrict_edges(edge, pool, ["split"])
    assert 0 < near.count() < whole.count()
    counts = [sorted(map(tuple, en.induced_edge_count(e, panel, ["split"], ["split"]).collect())) for e in (near, whole)]
    assert counts[0] == counts[1]
