"""Hand-computed values, edge cases and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import special
from sievework.operators import (
    enrichment,
    evidence,
    folds,
    gramian,
    metrics,
    models,
    preparation,
    quality,
    ranking,
    scores,
    stability,
)
from sievework.sources import matrices, tables


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_auc_perfect_reversed_constant(spark):
    data = [("up", y, float(y)) for y in (0, 0, 1, 1)]
    data += [("down", y, -float(y)) for y in (0, 0, 1, 1)]
    data += [("flat", y, 1.0) for y in (0, 0, 1, 1)] + [("one", 1, 1.0)]
    df = spark.createDataFrame(data, "g string, label int, score double")
    assert by(scores.auc_score(df, ["g"]), "g", "auc") == {"up": 1.0, "down": 0.0, "flat": 0.5, "one": None}


def test_exceedance_and_leave_one_out(spark):
    obs = spark.createDataFrame([("d", "a", 3.0, 0.0)], "dataset string, feature string, pi double, u double")
    null = spark.createDataFrame(
        [("d", i, "a", v, 0.0) for i, v in enumerate([1.0, 3.0, 4.0, 2.0])],
        "dataset string, perm_id int, feature string, pi double, u double",
    )
    r = evidence.exceedance(obs, null, ["dataset"]).first()
    assert (r.e_pi, r.e_u) == (3 / 5, 5 / 5)
    three = null.where("perm_id != 2").withColumn("pi", F.col("pi"))
    got = by(evidence.loo_exceedance(three, ["dataset"]), "pi", "e_pi")
    assert got == {1.0: 1.0, 2.0: pytest.approx(2 / 3), 3.0: pytest.approx(1 / 3)}
    p = evidence.joint_null(obs, null, ["dataset"]).first().p
    assert 0 < p <= 1


def test_deviance_utility_by_hand(spark):
    x = {("s1", "a"): 1.0, ("s2", "a"): -1.0, ("s1", "b"): 2.0, ("s2", "b"): 0.5}
    features = spark.createDataFrame(
        [("d", s, f, v) for (s, f), v in x.items()], "dataset string, sample_id string, feature string, value double"
    )
    coefs = spark.createDataFrame(
        [("d", 1, "a", 0.7), ("d", 1, "b", 0.0), ("d", 2, "a", -0.4), ("d", 2, "b", 0.3)],
        "dataset string, resample_id int, feature string, beta double",
    )
    fits = spark.createDataFrame(
        [("d", 1, 0.2, 0.9), ("d", 2, -0.1, 0.4)],
        "dataset string, resample_id int, intercept double, oob_auc double",
    )
    members = spark.createDataFrame(
        [("d", r, s, y) for r in (1, 2) for s, y in (("s1", 1), ("s2", 0))],
        "dataset string, resample_id int, sample_id string, label int",
    )
    got = by(evidence.deviance_utility(features, coefs, fits, members, ["dataset"]), "feature", "utility")

    def dev(eta):
        return -2 * sum(y * e - math.log1p(math.exp(e)) for y, e in zip((1, 0), eta, strict=True))

    eta = [0.2 + 0.7 * 1.0, 0.2 - 0.7]
    # the second resample predicts nothing: weight 0, so b is useless and a counts once
    assert got["a"] == pytest.approx(dev([0.2, 0.2]) - dev(eta), abs=1e-12)
    assert got["b"] == 0.0


def test_sign_consistency_never_selected(spark):
    coefs = spark.createDataFrame(
        [("d", 1, "a", 1.0), ("d", 2, "a", -1.0), ("d", 3, "a", 2.0), ("d", 1, "b", 0.0)],
        "dataset string, resample_id int, feature string, beta double",
    )
    got = by(evidence.sign_consistency(coefs, ["dataset"]), "feature", "sign_consistency")
    assert got["a"] == pytest.approx(2 / 3) and got["b"] is None


def samples(spark, n=80, groups=40):
    return spark.createDataFrame(
        [("d", i, int(i % 3 == 0), i % groups) for i in range(n)],
        "dataset string, sample_id int, label int, group_id int",
    )


@pytest.mark.parametrize("scheme", ["paired", "grouped"])
def test_no_group_straddles_folds(spark, scheme):
    s = samples(spark)
    assigned = folds.repeated_cv(s, 5, 2, 42, scheme)
    assert assigned.count() == 160
    assert assigned.groupBy("repeat_idx", "group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    roles = folds.fold_roles(assigned, 5).drop("fold")
    leak = folds.check_fold_leakage(roles, s, ["dataset", "repeat_idx", "fold_idx"]).collect()
    assert all(r.samples_in_both == r.groups_in_both == r.uncovered == 0 for r in leak)


def test_stratified_folds_balance_classes(spark):
    f = folds.stratified_folds(samples(spark), 5, 1)
    sizes = [r["count"] for r in f.where("label = 1").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_permutations_keep_class_sizes(spark):
    p = folds.permute_labels(samples(spark), 5, 9)
    assert {r["sum(label)"] for r in p.groupBy("perm_id").sum("label").collect()} == {27}


def test_redundancy_filter_equals_walk(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 4))
    x = np.hstack([base[:, [i % 4]] + 0.6 * rng.normal(size=(60, 1)) for i in range(16)])
    x = np.hstack([x, np.ones((60, 1))])
    names = [f"f{i:02d}" for i in range(17)]
    features = spark.createDataFrame(
        [("d", i, f, float(x[i, j])) for i in range(60) for j, f in enumerate(names)],
        "dataset string, sample_id int, feature string, value double",
    )
    order = list(rng.permutation(names))
    ranked = spark.createDataFrame(
        [("d", str(f), r + 1) for r, f in enumerate(order)], "dataset string, feature string, rank int"
    )
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.abs(np.corrcoef(x.T)))
    picked, skipped = [], []
    for f in order:
        i = names.index(f)
        ok = all(c[i, names.index(g)] <= 0.5 for g in picked)
        (picked if ok else skipped).append(f)
    out = gramian.redundancy_filter(ranked, features, ["dataset"], 0.5).orderBy("rank").collect()
    assert [r.feature for r in out] == picked + skipped
    assert skipped


def test_soft_prior_ties_and_negative_z(spark):
    r = spark.createDataFrame(
        [("d", "a", 1.0, 1), ("d", "b", 1.0, 2), ("d", "c", 0.9, 3), ("d", "e", 0.5, 4)],
        "dataset string, feature string, score double, rank int",
    )
    sets = spark.createDataFrame([("s1", "c"), ("s2", "e"), ("s2", "a")], "set_id string, feature string")
    z = spark.createDataFrame([("s1", 2.0), ("s2", -3.0)], "set_id string, z double")
    out = ranking.soft_prior(r, sets, z, 0.5, ["dataset"]).orderBy("rank").collect()
    assert [x.feature for x in out] == ["c", "a", "b", "e"]
    assert out[0].boosted == pytest.approx(1.8)


def test_rank_average_short_list(spark):
    lists = {"x": ["a", "b", "c", "d", "e", "f"], "y": ["c", "a"]}
    r = spark.createDataFrame(
        [("d", m, f, i + 1) for m, fs in lists.items() for i, f in enumerate(fs)],
        "dataset string, method string, feature string, rank int",
    )
    pool = spark.createDataFrame([("d", f) for f in "abcdef"], "dataset string, feature string")
    got = by(ranking.rank_average(r, pool, ["dataset"]), "feature", "mean_rank")
    assert got["a"] == 1.5 and got["c"] == 2.0
    assert got["b"] == pytest.approx((2 + 2 + 2 / 7) / 2)


def test_strict_top_k_fails_when_short(spark):
    r = spark.createDataFrame([("d", "a", 1)], "dataset string, feature string, rank int")
    with pytest.raises(Exception, match="fewer than"):
        ranking.top_k(r, ["dataset"], [3], strict=True).collect()


def test_gate_falls_back(spark):
    r = spark.createDataFrame(
        [("d", f"f{i}", i + 1) for i in range(20)], "dataset string, feature string, rank int"
    )
    few = r.where("rank in (3, 7)")
    out = ranking.gated_ranking(r, few, ["dataset"], 10)
    assert out.count() == 20 and out.where("gate_fallback").count() == 20
    out = ranking.gated_ranking(r, few, ["dataset"], 2).orderBy("rank").collect()
    assert [(x.feature, x.rank, x.gate_fallback) for x in out] == [("f2", 1, False), ("f6", 2, False)]


def test_scale_and_counts(spark):
    data = [("counts", 5.0), ("counts", 500.0), ("log", 1.5), ("log", -2.0), ("linear", 0.5),
            ("linear", 300.0), ("bg", -20.5), ("bg", 900.0)]
    df = spark.createDataFrame(data, "dataset string, value double")
    assert by(quality.detect_scale(df), "dataset", "scale") == {
        "counts": "counts", "log": "log_normalized", "linear": "linear_normalized",
        "bg": "linear_background_corrected",
    }
    bad = spark.createDataFrame(
        [("d", -1.0), ("d", 1.5), ("d", float("nan")), ("d", 3.0)], "dataset string, value double"
    )
    assert quality.assert_counts(bad).first()[1:] == (1, 1, 1)
    with pytest.raises(Exception, match="not a count"):
        quality.strict_counts(bad).collect()


def test_threshold_metrics_empty_denominator(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 1, 0.2)], "g string, label int, score double")
    zero = metrics.threshold_metrics(df, ["g"], empty="zero").first()
    null = metrics.threshold_metrics(df, ["g"], empty="null").first()
    assert (zero.specificity, zero.mcc) == (0.0, 0.0) and zero.balanced_accuracy == 0.25
    assert null.specificity is None and null.mcc is None


def test_nogueira_bounds(spark):
    same = [("d", s, f) for s in range(4) for f in ("a", "b")]
    df = spark.createDataFrame(same, "dataset string, split int, feature string")
    pool = spark.createDataFrame([("d", f) for f in "abcdefgh"], "dataset string, feature string")
    assert stability.nogueira(df, pool, ["dataset"], ["split"]).first().nogueira == pytest.approx(1.0)
    o = stability.pairwise_overlap(
        spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "dataset string, split int, feature string"),
        ["dataset"], ["split"],
    ).first()
    assert (o.n_pairs, o.mean_jaccard) == (1, 0.0)


def test_tmm_of_scaled_copies_is_one(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(20, 200, size=30)
    rows = [("d", s, f"f{j}", float(v * k)) for s, k in (("a", 1), ("b", 2), ("c", 3)) for j, v in enumerate(base)]
    x = spark.createDataFrame(rows, "dataset string, sample_id string, feature string, value double")
    f = spark.createDataFrame(
        [("d", 1, "a", "train"), ("d", 1, "b", "train"), ("d", 1, "c", "test")],
        "dataset string, fold_idx int, sample_id string, role string",
    )
    split = ["dataset", "fold_idx"]
    ref = preparation.reference_sample(x, f, split).drop("mean_q")
    got = by(preparation.tmm_factors(x, f, ref, split), "sample_id", "factor")
    assert got == {"a": pytest.approx(1), "b": pytest.approx(1), "c": pytest.approx(1)}


def test_standardise_fits_on_train_only(spark):
    x = spark.createDataFrame(
        [("d", s, "f", v) for s, v in ((1, 1.0), (2, 3.0), (3, 100.0))],
        "dataset string, sample_id int, feature string, value double",
    )
    f = spark.createDataFrame(
        [("d", 1, 1, "train"), ("d", 1, 2, "train"), ("d", 1, 3, "test")],
        "dataset string, fold_idx int, sample_id int, role string",
    )
    got = by(preparation.standardise(x, f, ["dataset", "fold_idx"]), "sample_id", "value")
    assert got[1] == pytest.approx(-math.sqrt(0.5)) and got[3] == pytest.approx(98 / math.sqrt(2))


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 2, 40)
    y = rng.normal(size=40) + a
    x = spark.createDataFrame(
        [("d", i, "f", float(y[i])) for i in range(40)], "dataset string, sample_id int, feature string, value double"
    )
    s = spark.createDataFrame(
        [("d", i, f"a{a[i]}", f"b{b[i]}") for i in range(40)], "dataset string, sample_id int, a string, b string"
    )
    f = spark.createDataFrame(
        [("d", 1, i, "test" if i >= 30 else "train") for i in range(40)],
        "dataset string, fold_idx int, sample_id int, role string",
    )
    got = by(preparation.residualise(x, s, f, ["dataset", "fold_idx"], ["a", "b"]), "sample_id", "value")
    design = np.column_stack([np.ones(40), a == 1, a == 2, b == 1]).astype(float)
    coef = np.linalg.lstsq(design[:30], y[:30], rcond=None)[0]
    want = y - design @ coef
    assert np.allclose([got[i] for i in range(40)], want)


def test_special_functions():
    assert special.t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803, abs=1e-8)
    assert special.t_quantile(0.975, 6) == pytest.approx(2.4469118511449786)
    assert special.incomplete_beta(2, 3, np.array([0.4]))[0] == pytest.approx(0.5248)


def test_batched_fits_match_spark_ml(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 5))
    y = (x[:, 0] - 0.8 * x[:, 1] + rng.normal(size=120) > 0).astype(int)
    rows = spark.createDataFrame(
        [(int(y[i]), x[i].tolist(), [1], [1 + i % 3]) for i in range(120)],
        "label int, x array<double>, train array<int>, inner array<int>",
    ).repartition(5).persist()
    m = [models.Model(0, None, 0.5, 0.05), models.Model(0, 2, 1.0, 0.1)]
    beta = models.fit_many(rows, 5, m, steps=400, tol=1e-9)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    for j, (keep, alpha, lam) in enumerate([("true", 0.5, 0.05), ("inner[0] != 2", 1.0, 0.1)]):
        data = rows.where(keep).withColumn("v", array_to_vector("x"))
        ml = LogisticRegression(
            featuresCol="v", elasticNetParam=alpha, regParam=lam, standardization=False, tol=1e-10, maxIter=500
        ).fit(data)
        assert np.allclose(beta[1:, j], ml.coefficients.toArray(), atol=1e-4)
        assert beta[0, j] == pytest.approx(ml.intercept, abs=1e-4)


def test_planted_set_is_certified_and_noise_is_not(spark):
    rng = np.random.default_rng(8)
    y = np.array([0, 1] * 30)
    x = rng.normal(size=(60, 40))
    x[:, :10] += 1.2 * y[:, None]
    features = spark.createDataFrame(
        [("d", i, f"f{j:02d}", float(x[i, j])) for i in range(60) for j in range(40)],
        "dataset string, sample_id int, feature string, value double",
    )
    labels = spark.createDataFrame(
        [("d", i, int(y[i])) for i in range(60)], "dataset string, sample_id int, label int"
    )
    sets = spark.createDataFrame(
        [(f"s{j // 10}", f"f{j:02d}") for j in range(40)], "set_id string, feature string"
    )
    t = evidence.permutation_t(features, labels, ["dataset"], 60, 3)
    gate = by(evidence.set_gate(t, sets, ["dataset"], 60), "set_id", "q")
    assert gate["s0"] <= 0.1 and min(gate["s1"], gate["s2"], gate["s3"]) > 0.1
    z = by(evidence.set_scores(t, sets, ["dataset"]), "set_id", "z")
    assert z["s0"] > 5


def test_edge_counts_of_small_panels(spark):
    e = spark.createDataFrame(
        [("d", "a", "b"), ("d", "b", "c"), ("d", "c", "x")], "dataset string, src string, dst string"
    )
    p = spark.createDataFrame(
        [("d", 1, f) for f in "abc"] + [("d", 2, "a")], "dataset string, panel int, feature string"
    )
    got = by(enrichment.induced_edge_count(e, p, ["dataset", "panel"], ["dataset"]), "panel", "n_edges")
    assert got == {1: 2, 2: None}
    got = by(enrichment.induced_edge_count(e, p, ["dataset", "panel"], ["dataset"], "zero"), "panel", "n_edges")
    assert got == {1: 2, 2: 0}


def test_matrix_reader_and_resume(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text('gene\t"s1"\ts2\ng1\t1.5\tNA\ng2\t2\t3\n')
    got = {(r.sample_id, r.feature): r.value for r in matrices.read_matrix(spark, str(path)).collect()}
    assert got == {("s1", "g1"): 1.5, ("s2", "g1"): None, ("s1", "g2"): 2.0, ("s2", "g2"): 3.0}
    out = str(tmp_path / "t")
    tables.write_table(spark.createDataFrame([(1, "a")], "k int, v string"), out)
    tables.append_missing(spark, out, spark.createDataFrame([(1, "z"), (2, "b")], "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b")]
    bad = tmp_path / "s_A.tsv"
    bad.write_text("Gene\tTPM\ng\t-1\n")
    with pytest.raises(Exception, match="bad value"):
        matrices.read_per_sample_files(spark, str(bad), r"s_(\w)\.tsv").collect()


def test_append_missing_first_run_repeats_and_null_keys(spark, tmp_path):
    out = str(tmp_path / "resumed")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k int, v string")
    tables.append_missing(spark, out, rows, ["k"])
    tables.append_missing(spark, out, rows.union(spark.createDataFrame([(2, "b")], "k int, v string")), ["k"])
    got = sorted(map(str, (tuple(r) for r in spark.read.parquet(out).collect())))
    assert got == ["(1, 'a')", "(2, 'b')", "(None, 'n')"]
