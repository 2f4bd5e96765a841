"""Block correlations against numpy, at any number of blocks and pieces."""

import numpy as np
import pandas as pd
import pytest

from sievework.operators import gramian, models


def long_table(spark, x, dataset="a"):
    n, p = x.shape
    frame = pd.DataFrame(
        {
            "dataset": dataset,
            "sample_id": np.repeat(np.arange(n), p),
            "feature": np.tile([f"f{j:05d}" for j in range(p)], n),
            "value": x.ravel(),
        }
    )
    return spark.createDataFrame(frame)


def strong_pairs(x, above):
    r = np.corrcoef(x.T)
    i, j = np.nonzero(np.triu(np.abs(r) > above, 1))
    return {(f"f{a:05d}", f"f{b:05d}"): r[a, b] for a, b in zip(i, j)}


@pytest.mark.parametrize("block,piece", [(512, 1024), (7, 13)])
def test_equals_numpy(spark, monkeypatch, block, piece):
    monkeypatch.setattr(gramian, "BLOCK", block)
    monkeypatch.setattr(gramian, "PIECE_SAMPLES", piece)
    monkeypatch.setattr(gramian, "HELD", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 30))
    x[:, 20] = x[:, 3] + 0.3 * rng.normal(size=50)
    x[:, 9] = -x[:, 28] * 1e-8  # another unit
    x[:, 11] = 1e6 + x[:, 5]  # a large mean
    x[:, 17] = 4.25  # constant
    both = long_table(spark, x).unionByName(long_table(spark, x[:, :12] * 2, "b"))
    got = gramian.correlation_edges(both, ["dataset"], 0.25).toPandas()
    for name, m in (("a", np.delete(x, 17, 1)), ("b", x[:, :12])):
        part = got[got.dataset == name]
        pairs = {(a, b): r for a, b, r in zip(part.feature_a, part.feature_b, part.r)}
        if name == "a":
            shift = {f"f{j:05d}": f"f{j + (j >= 17):05d}" for j in range(29)}
            want = {(shift[a], shift[b]): r for (a, b), r in strong_pairs(m, 0.25).items()}
        else:
            want = strong_pairs(m, 0.25)
        assert pairs.keys() == want.keys() and all(abs(pairs[k] - want[k]) < 1e-9 for k in want)


def test_more_features_than_a_block_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(24, 6000))
    x[:, 5900] = x[:, 12] + 0.05 * rng.normal(size=24)
    x[:, 3000] = x[:, 2999] * 1e-8
    x[:, 700] = 0.0
    edges = gramian.correlation_edges(long_table(spark, x), ["dataset"], 0.95).toPandas()
    pairs = set(zip(edges.feature_a, edges.feature_b))
    with np.errstate(invalid="ignore", divide="ignore"):
        assert pairs == set(strong_pairs(x, 0.95)) and ("f00012", "f05900") in pairs and ("f02999", "f03000") in pairs
    modules = gramian.data_modules(long_table(spark, x), ["dataset"], 0.95, 2, 5).toPandas()
    assert {"f00012", "f05900"} <= set(modules.feature)


def test_missing_cells_stop(spark):
    x = long_table(spark, np.arange(12.0).reshape(4, 3) ** 2)
    with pytest.raises(Exception, match="does not have every feature"):
        gramian.correlation_edges(x.where("sample_id != 2 or feature != 'f00001'"), ["dataset"], 0.5).collect()


def test_mrmr_of_every_split(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 9))
    y = (x[:, 4] + 0.5 * x[:, 7] > 0).astype(int)
    x[:, 2] = x[:, 4] + 0.1 * rng.normal(size=60)
    x[:, 8] = 1.0
    labels = spark.createDataFrame([("a", i, int(v)) for i, v in enumerate(y)], "dataset string, sample_id long, label int")
    got = models.mrmr_rank(long_table(spark, x), labels, ["dataset"], 3).orderBy("rank").collect()
    info = lambda a, b: -0.5 * np.log(1 - min(abs(np.corrcoef(a, b)[0, 1]), 1 - 1e-12) ** 2)
    picked = []
    for _ in range(3):
        score = [
            -9 if j in picked else info(x[:, j], y) - (np.mean([info(x[:, j], x[:, q]) for q in picked]) if picked else 0)
            for j in range(8)
        ]
        picked.append(int(np.argmax(score)))
    assert [r.feature for r in got][:3] == [f"f{j:05d}" for j in picked]
    assert [r.selected for r in got] == [True] * 3 + [False] * 6 and got[-1].score is None
