"""Hard negatives against all scores, and what the threshold saves."""

import math

import numpy as np
import pytest

from sievework.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, id string"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    whole = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        whole[i] = min(whole.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a]
        near = sorted(x[:2] for x in scored if x[2] == label)[:positives]
        for p, i in near:
            inside = sorted((s, j) for s, j, other in scored if other != label and low * -p <= 100 * -s <= high * -p)
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(inside[:negatives])]
    return sorted(out)


def table(n, dim, rng, ties=False):
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + 0.6 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = np.round(v * 4) / 4 if ties else v
    return [(k * 5, [float(x) for x in v[k].astype(np.float32)], int(rng.integers(0, 4)), 1, "n") for k in range(n)]


@pytest.mark.parametrize("ties,block", [(False, 1 << 13), (True, 1 << 13), (False, 60), (True, 60)])
def test_equals_all_scores(spark, monkeypatch, ties, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "CHUNK_ANCHORS", 9)
    data = table(400, 8, np.random.default_rng(5), ties)
    got = hn.hard_negatives(spark.createDataFrame(data, SCHEMA), "id % 50 = 0")
    assert sorted(map(tuple, got.collect())) == brute(data) != []


def test_odd_rows(spark):
    data = table(120, 4, np.random.default_rng(6))
    flat = [0.5, -0.5, 0.25, 0.0]
    data += [(None, flat, 1, 1, "n"), (1000, None, 1, 1, "n"), (1001, flat, None, 1, "n")]
    data += [(1050, [0.5, None, 0.1, 0.2], 1, 1, "n"), (1100, [0.5, float("nan"), 0.1, 0.2], 1, 1, "n")]
    data += [(1150, [float("inf"), 0.0, 0.0, 0.0], 1, 1, "n"), (1200, [0.0] * 4, 2, 1, "n"), (-50, flat, 3, 1, "n")]
    data += [(2000 + k, flat, k % 3, 1, "n") for k in range(60)]
    data += [(2000, flat, 2, 1, "n"), data[0], data[0], (data[10][0], flat, 9, 1, "n"), (2050, [], 1, 1, "n"), (2100, [0.5], 1, 1, "n")]
    got = hn.hard_negatives(spark.createDataFrame(data, SCHEMA), "id % 50 = 0")
    assert sorted(map(tuple, got.collect())) == brute(data)
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA), "id % 50 = 0").collect() == []
    assert hn.hard_negatives(spark.createDataFrame(data[:5], SCHEMA), "id < 0").collect() == []


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    data = [(k * 10, [float(np.float32(x)) for x in rng.integers(-(1 << 19), 1 << 19, 6)], k % 3, 1, "n") for k in range(60)]
    got = hn.hard_negatives(spark.createDataFrame(data, SCHEMA), "id % 50 = 0")
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_reading_stops_early():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-256, 256, (20_000, 2)).astype(np.float64)
    lists = hn.SortedLists(np.arange(20_000), vectors)
    anchor = np.array([200.0, -150.0])
    ((rows, scores),), scored = lists.search(anchor, [(-(1 << 62), 1 << 62)], 5, np.ones(20_000, bool))
    want = np.lexsort((np.arange(20_000), -(vectors @ anchor)))[:5]
    assert rows.tolist() == want.tolist() and scored < 4_000
