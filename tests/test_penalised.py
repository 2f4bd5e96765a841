"""Penalised models keyed by split, against single solves and the operators they feed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import evidence, penalised
from sievework.operators.folds import permute_labels, subsamples
from sievework.operators.models import decoy_features
from sievework.operators.scores import auc_score
from sievework.plans.decoy_study import decoy_frequencies, decoy_study
from sievework.plans.null_study import null_study


def planted(n=90, p=14, splits=("a", "b"), seed=4):
    rng = np.random.default_rng(seed)
    samples, features = [], []
    for d in splits:
        y = np.arange(n) % 2
        x = rng.normal(size=(n, p))
        x[:, 2] += 1.4 * y
        x[:, 5] -= 1.0 * y
        x[:, 6] = x[:, 5] + 0.4 * rng.normal(size=n)
        samples += [(d, i, int(y[i])) for i in range(n)]
        features += [(d, i, f"f{j:02d}", float(x[i, j])) for i in range(n) for j in range(p)]
    return samples, features


@pytest.fixture(scope="module")
def data(spark):
    samples, features = planted()
    return (
        spark.createDataFrame(samples, "dataset string, sample_id int, label int"),
        spark.createDataFrame(features, "dataset string, sample_id int, feature string, value double"),
    )


def test_paths_meet_the_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 30))
    x[:, 1] = x[:, 0] + 0.2 * rng.normal(size=80)
    y = np.column_stack([(x[:, 0] + rng.normal(size=80) > 0), rng.random(80) < 0.5]).astype(float)
    w = (rng.random((80, 2)) < 0.8).astype(float)
    mix = np.array([0.5, 1.0])
    grid = np.geomspace(0.3, 0.01, 9)[:, None] * np.ones(2)
    share = w / w.sum(0)
    for now, beta in zip(grid, penalised.penalty_paths(x, y, w, mix, grid, 1e-9, 20_000)):
        error = (1 / (1 + np.exp(-(beta[0] + x @ beta[1:]))) - y) * share
        slope = x.T @ error + now * (1 - mix) * beta[1:]
        chosen = beta[1:] != 0
        assert np.abs(error.sum(0)).max() < 1e-6
        assert np.abs(slope + now * mix * np.sign(beta[1:]))[chosen].max(initial=0) < 1e-5
        assert (np.abs(slope) - now * mix)[~chosen].max(initial=-1) < 1e-5


def test_penalty_has_the_least_inner_deviance(data):
    samples, features = data
    drawn = subsamples(samples, 3, 3, 7)
    members = penalised.resample_members(drawn, ["dataset"], ["resample_id"], 4, 42)
    _, fits = penalised.resample_fits(features, drawn, ["dataset"], alphas=[0.5], k=4)
    rows = {(r.sample_id, r.feature): r.value for r in features.where("dataset = 'a'").collect()}
    x = np.array([[rows[i, f"f{j:02d}"] for j in range(14)] for i in range(90)])
    for b in (1, 2, 3):
        part = members.where(f"dataset = 'a' and resample_id = {b}").orderBy("sample_id").toPandas()
        y, fold = part.label.to_numpy(float)[:, None], part.fold.to_numpy()
        train = (fold > 0).astype(float)[:, None]
        top = np.abs(x.T @ (train * (y - (train * y).sum() / train.sum()))).max() / train.sum() / 0.5
        grid = top * np.geomspace(1, 0.02, 12)[:, None]
        loss = np.zeros(12)
        for f in range(1, 5):
            inside = ((fold > 0) & (fold != f)).astype(float)[:, None]
            for k, beta in enumerate(penalised.penalty_paths(x, y, inside, np.array([0.5]), grid)):
                eta = beta[0] + x @ beta[1:]
                loss[k] += (2 * (np.logaddexp(0, eta) - y * eta))[fold == f].sum()
        got = fits.where(f"dataset = 'a' and resample_id = {b}").first()
        at = int(np.argmin(np.round(loss / train.sum(), 6)))
        assert got.penalty == pytest.approx(grid[at, 0]) and got.deviance == pytest.approx(loss[at] / train.sum(), abs=1e-4)


@pytest.mark.parametrize("per_block,cells", [(32, 1 << 21), (2, 1)])
def test_fits_feed_the_evidence_operators(data, monkeypatch, per_block, cells):
    monkeypatch.setattr(penalised, "UNITS_PER_BLOCK", per_block)
    monkeypatch.setattr(penalised, "CELLS", cells)
    samples, features = data
    drawn = subsamples(samples, 5, 5, 7)
    coefs, fits = penalised.resample_fits(features, drawn, ["dataset"], alphas=[1.0])
    assert fits.count() == 10 and fits.where("intercept is null or penalty is null").isEmpty()
    held = drawn.where("role = 'oob'").select("dataset", "resample_id", "sample_id", "label")
    want = evidence.deviance_utility(features, coefs, fits, held, ["dataset"])
    got = evidence.utility_of_rises(coefs, fits, ["dataset"], ["dataset", "resample_id"])
    both = want.join(got.withColumnRenamed("utility", "u2"), ["dataset", "feature"], "full").collect()
    assert len(both) > 4 and all(abs(r.utility - r.u2) < 1e-9 for r in both)
    eta = evidence.linear_predictor(features, coefs, fits, held, ["dataset"])
    auc = auc_score(eta.withColumn("eta", F.round("eta", 12)), ["dataset", "resample_id"], score="eta")
    pairs = auc.join(fits, ["dataset", "resample_id"]).select("auc", "oob_auc").collect()
    assert len(pairs) == 10 and all(abs(a - b) < 1e-9 for a, b in pairs)


def test_odd_units(spark):
    samples, features = planted(40, 8, ("a",))
    x = spark.createDataFrame(features, "dataset string, sample_id int, feature string, value double")
    rows = [("a", i, lab if u else 1, u, "train" if i < 30 else "oob") for u in (0, 1) for _, i, lab in samples]
    drawn = spark.createDataFrame([*rows, ("a", 99, 1, 1, "train")], "dataset string, sample_id int, label int, resample_id int, role string")
    coefs, fits = penalised.resample_fits(x, drawn, ["dataset"], alphas=[0.5])
    got = {r.resample_id: r for r in fits.collect()}
    assert got[0].intercept is None and got[0].oob_auc is None and got[1].intercept is not None
    assert {r.resample_id for r in coefs.collect()} == {1}
    none = penalised.resample_fits(x.where("false"), drawn.where("false"), ["dataset"])
    assert none[0].collect() == none[1].collect() == []


def test_elastic_net_rank_of_every_split(data):
    samples, features = data
    ranked = penalised.elastic_net_rank(features, samples, ["dataset"], [0.5, 1.0], length=8).toPandas()
    for d in ("a", "b"):
        one = ranked[ranked.dataset == d].sort_values("rank")
        assert one["rank"].tolist() == list(range(1, 15)) and one.feature.iloc[0] == "f02"
        assert {"f02"} <= set(one[one.selected].feature) and one.alpha.nunique() == 1
        assert one.score.is_monotonic_decreasing


def test_null_study_finds_planted_features(data):
    samples, features = data
    folds = samples.select("dataset", "sample_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("fold_idx"))
    folds = folds.withColumn("role", F.when((F.col("sample_id") / 2).cast("int") % 4 == F.col("fold_idx"), "test").otherwise("train"))
    out = null_study(
        samples, features, folds, ["dataset", "fold_idx"], resamples=10, permutations=24, null_resamples=5
    ).toPandas()
    assert len(out) == 2 * 2 * 14 and (out.n_null == 24).all()
    for _, one in out.groupby(["dataset", "fold_idx"]):
        best = one.sort_values("rank")
        assert {"f02", "f05"} <= set(best.feature.tolist()[:6]) and best.p.min() <= 2 / 25
        assert best.sort_values("u").feature.iloc[-1] in ("f02", "f05")
    noise = out[~out.feature.isin(["f02", "f05", "f06"])]
    assert noise.p.mean() > 0.3 and (noise.p > 0.05).mean() > 0.8


def test_decoy_study_keeps_planted_features(data):
    samples, features = data
    out = decoy_study(features, samples, ["dataset"], resamples=12, length=10).toPandas()
    assert len(out) == 2 * 14 and not out.feature.str.startswith("~").any()
    for _, one in out.groupby("dataset"):
        assert {"f02", "f05"} <= set(one[one.score >= 0.9].feature)
        assert (one.selected == (one.score > one.threshold)).all()
    frequencies = decoy_frequencies(features, samples, ["dataset"], resamples=12, length=10)
    assert frequencies.count() == 2 * 28 * 10
    largest = frequencies.groupBy("dataset", "feature").agg(F.max("frequency").alias("m")).where("feature = 'f02'")
    assert {round(r.m, 9) for r in largest.collect()} == {1.0}


def test_decoys_keep_the_values_of_their_split(data):
    _, features = data
    decoys = decoy_features(features, 1.0, 3, ["dataset"])
    a = features.groupBy("dataset", "feature").agg(F.round(F.sum("value"), 9).alias("s"), F.count("*").alias("n"))
    b = decoys.groupBy("dataset", F.substring("feature", 2, 9).alias("feature")).agg(
        F.round(F.sum("value"), 9).alias("s"), F.count("*").alias("n")
    )
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_features_without_nulls_stop(spark):
    observed = spark.createDataFrame([("a", "f1", 0.5, 0.1), ("a", "f2", 0.5, 0.1)], "dataset string, feature string, pi double, u double")
    nulls = spark.createDataFrame([("a", 1, "f1", 0.5, 0.0)], "dataset string, perm_id int, feature string, pi double, u double")
    whole = evidence.exceedance(observed.where("feature = 'f1'"), nulls, ["dataset"]).collect()
    assert [(r.n_null, r.e_pi, r.e_u) for r in whole] == [(1, 1.0, 0.5)]
    with pytest.raises(Exception, match="no null values for feature f2"):
        evidence.exceedance(observed, nulls, ["dataset"]).collect()


def test_permuted_members_and_fits_equal_those_of_shuffled_rows(data):
    samples, features = data
    per = ["dataset", "perm_id"]
    drawn = subsamples(permute_labels(samples, 2, 9, ["dataset"]), 4, 3, 9, by=per)
    want = penalised.resample_members(drawn, per, ["resample_id"], 3, 9)
    made = penalised.permuted_members(samples, ["dataset"], 2, 4, 3, 9)
    names = [*per, "resample_id", "sample_id", "label", "fold"]
    rows = made.withColumn("sample_id", F.explode("sample_ids")).select(*names)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.select(*names).collect()))
    # No row a sample, permutation and resample crosses a shuffle.
    assert "resample_id" not in "".join(
        line for line in made._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line
    )
    alpha = samples.select("dataset").distinct().withColumn("alpha", F.lit(0.5))
    slow = penalised.resample_fits(features, drawn, ["dataset"], ["perm_id", "resample_id"], alpha, 3, 9)
    quick = penalised.permuted_fits(features, samples, ["dataset"], alpha, 2, 4, 3, 9)
    on = [*per, "resample_id", "alpha"]
    for a, b, by in ((slow[0], quick[0], [*on, "feature"]), (slow[1], quick[1], on)):
        a, b = (d.toPandas().sort_values(by).reset_index(drop=True)[sorted(d.columns)] for d in (a, b))
        assert a[by].equals(b[by].astype(a[by].dtypes.to_dict()))
        numbers = [c for c in a.columns if c not in by]
        assert np.allclose(a[numbers].astype(float), b[numbers].astype(float), atol=1e-4)


def test_vectors_are_sent_once_a_task_and_not_once_a_block(data, monkeypatch):
    """How often a split's vectors are sent does not grow with its units; what is solved together stays the same."""
    samples, features = data
    monkeypatch.setattr(penalised, "UNITS_PER_BLOCK", 1)
    sent, spread = [], penalised.spread
    monkeypatch.setattr(penalised, "spread", lambda df, *by, **more: sent.append(df) or spread(df, *by, **more))
    drawn = subsamples(samples, 10, 5, 7)
    fits = []
    for a_core in (0.25, 2):
        monkeypatch.setattr(penalised, "TASKS_PER_CORE", a_core, raising=False)
        fits.append(penalised.resample_fits(features, drawn, ["dataset"], alphas=[1.0])[1].toPandas())
    rows = [df.where("x is not null").count() for df in sent if "x" in df.columns]
    cores = features.sparkSession.sparkContext.defaultParallelism
    assert rows == [180 * max(1, -(-int(0.25 * cores) // 2)), 180 * min(10, cores)]
    a, b = (d.sort_values(["dataset", "resample_id"]).reset_index(drop=True) for d in fits)
    assert len(a) == 20 and a.equals(b)


def test_decoys_are_shuffled_once(data, small_tasks):
    """The values of a feature meet in one task; in slices, where they are too many for it, the result is the same."""
    _, features = data
    sliced = decoy_features(features, 0.7, 3, ["dataset"])
    small_tasks.conf.unset("sievework.rowsPerTask")
    whole = decoy_features(features, 0.7, 3, ["dataset"])
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, sliced.collect())) != []
