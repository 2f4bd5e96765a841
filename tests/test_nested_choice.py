"""Choices inside the training half, and the adjustment for several confounders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators.preparation import normal_solver, residualise
from sievework.plans.nested_choice import inner_roles, nested_size, nested_weight
from test_penalised import planted


@pytest.fixture(scope="module")
def data(spark):
    samples, features = planted(n=72, p=12)
    s = spark.createDataFrame(samples, "dataset string, sample_id int, label int")
    x = spark.createDataFrame(features, "dataset string, sample_id int, feature string, value double")
    folds = s.select("dataset", "sample_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold_idx"))
    folds = folds.withColumn("role", F.when((F.col("sample_id") / 2).cast("int") % 3 == F.col("fold_idx"), "test").otherwise("train"))
    return s, x, folds


SPLIT = ["dataset", "fold_idx"]


def test_inner_folds_stay_in_the_training_half(data):
    samples, _, folds = data
    inner = inner_roles(samples, folds, SPLIT, 3, 7)
    test = folds.where("role = 'test'")
    assert inner.join(test, [*SPLIT, "sample_id"], "left_semi").isEmpty()
    held = inner.where("role = 'test'").groupBy(*SPLIT, "sample_id").count()
    assert held.count() == 2 * 2 * 48 and held.where("count != 1").isEmpty()


def test_size_from_inner_folds(data):
    samples, features, folds = data
    out = nested_size(samples, features, folds, SPLIT, ks=(2, 6), draws=2, rounds=10, trees=30).toPandas()
    assert len(out) == 2 * 2 * 2 and set(out.chosen_k) <= {2, 6} and (out.best_inner_mean > 0.6).all()
    assert np.allclose(out.outer_delta, out.outer_auc - out.random_auc) and out.outer_delta.mean() > 0


def test_weight_from_inner_folds(data):
    samples, features, folds = data
    sets = features.sparkSession.createDataFrame(
        [("good", f) for f in ("f02", "f05", "f06")] + [("noise", f) for f in ("f08", "f09", "f10")], "set_id string, feature string"
    )
    out = nested_weight(
        samples, features, folds, sets, SPLIT, weights=(0.0, 4.0), k=4, inner_k=3, permutations=30, minimum=2, rounds=5, trees=20
    ).toPandas()
    assert len(out) == 4 and set(out.weight) <= {0.0, 4.0} and out.outer_auc.between(0, 1).all()
    assert (out[out.weight == 0].n_changed == 0).all() and (out.mean_value > 0.6).all()


def test_solver_gives_aliased_columns_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x[:, 2] = x[:, 0] - 2 * x[:, 1]
    y = rng.normal(size=40)
    beta = normal_solver(x.T @ x) @ (x.T @ y)
    want = np.linalg.lstsq(x[:, [0, 1, 3]], y, rcond=None)[0]
    assert beta[2] == 0 and np.allclose(beta[[0, 1, 3]], want)


def test_two_confounders_equal_least_squares(data):
    samples, features, folds = data
    s = samples.withColumn("conf", F.concat(F.lit("c"), F.col("sample_id") % 3)).withColumn("wing", (F.col("sample_id") % 5).cast("string"))
    got = residualise(features, s, folds, SPLIT, ["conf", "wing"]).where("dataset = 'a' and fold_idx = 1").toPandas()
    values = features.where("dataset = 'a'").toPandas().pivot(index="sample_id", columns="feature", values="value")
    ids = values.index.to_numpy()
    design = np.column_stack([np.ones(72)] + [(ids % 3 == c) for c in (1, 2)] + [(ids % 5 == c) for c in (1, 2, 3, 4)]).astype(float)
    train = (ids // 2) % 3 != 1
    beta = np.linalg.lstsq(design[train], values.to_numpy()[train], rcond=None)[0]
    rest = values - design @ beta
    wide = got.pivot(index="sample_id", columns="feature", values="value")
    assert np.allclose(wide.to_numpy(), rest.to_numpy(), atol=1e-8)
