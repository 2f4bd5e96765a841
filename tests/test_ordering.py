"""The sliced path gives what a plain sort of the whole group gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import ordering as od
from sievework.operators import metrics, scores
from sievework.operators.stability import correlations


def rows(n=600, seed=3):
    """One group holds a third of all rows, one value a third of that group."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{i % 7}"
        value = 1.5 if key == "hot" and i % 9 == 0 else round(rnd.gauss(0, 1), 3)
        out.append((key, f"id{i:04d}", value, int(rnd.random() < 0.4)))
    return out


@pytest.fixture
def frame(spark):
    data = rows()
    return data, spark.createDataFrame(data, "g string, id string, value double, label int")


@pytest.mark.parametrize("descending", [True, False])
def test_numbered_in_slices(small_tasks, frame, descending):
    data, df = frame
    assert len(od.order_cuts(df, "value", "id")) > 5
    got = od.numbered(df, ["g"], "value", "id", "r", descending, cumulate="label").collect()
    sign = -1 if descending else 1
    for g in {d[0] for d in data}:
        want = sorted([d for d in data if d[0] == g], key=lambda d: (sign * d[2], d[1]))
        mine = sorted([r for r in got if r.g == g], key=lambda r: r.r)
        assert [r.id for r in mine] == [d[1] for d in want]
        assert [r.r for r in mine] == list(range(1, len(want) + 1))
        assert [r.cum_label for r in mine] == list(np.cumsum([d[3] for d in want]))


def test_dealt_is_a_permutation_in_hash_order(spark, frame):
    data, df = frame
    got = od.dealt(df.withColumn("h", F.md5("id")), ["g"], "h", "pos").collect()
    for g in {d[0] for d in data}:
        mine = sorted([r for r in got if r.g == g], key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))
        assert [r.h for r in mine] == sorted(r.h for r in mine)


def test_average_ranks_in_slices(small_tasks, frame):
    data, df = frame
    got = {r.id: r.avg_rank for r in od.average_ranks(df, ["g"], "value").collect()}
    for g in {d[0] for d in data}:
        group = [d for d in data if d[0] == g]
        for d in group:
            below = sum(x[2] < d[2] for x in group)
            same = sum(x[2] == d[2] for x in group)
            assert got[d[1]] == pytest.approx(below + (same + 1) / 2)


def test_group_quantiles_in_slices(small_tasks, frame):
    data, df = frame
    got = od.group_quantiles(df, ["g"], "value", {"a": 0.25, "b": 0.9}).collect()
    for r in got:
        values = [d[2] for d in data if d[0] == r.g]
        assert r.a == pytest.approx(np.quantile(values, 0.25))
        assert r.b == pytest.approx(np.quantile(values, 0.9))


def test_operators_do_not_depend_on_slices(spark, frame):
    _, df = frame
    df = df.withColumn("p", F.round(F.abs("value") / 4, 3)).withColumnRenamed("id", "sample_id")

    def run():
        return (
            sorted(map(tuple, scores.auc_score(df, ["g"], score="value").collect())),
            sorted(map(tuple, scores.bh_adjust(df, ["g"]).select("sample_id", "q").collect())),
            sorted(map(tuple, metrics.average_precision(df, ["g"], "value").collect())),
            sorted(map(tuple, scores.percentile01(df, ["g"], "value").select("sample_id", "pct").collect())),
        )

    plain = run()
    spark.conf.set("sievework.rowsPerTask", "40")
    sliced = run()
    spark.conf.unset("sievework.rowsPerTask")
    for a, b in zip(plain, sliced, strict=True):
        assert [x[0] for x in a] == [x[0] for x in b]
        assert np.allclose(
            np.array([x[1:] for x in a], float), np.array([x[1:] for x in b], float)
        )


@pytest.mark.parametrize("n", [1, 7, 64])
def test_operators_do_not_depend_on_partitions(frame, n):
    _, df = frame
    base = sorted(map(tuple, scores.auc_score(df, ["g"], score="value").collect()))
    again = sorted(map(tuple, scores.auc_score(df.repartition(n), ["g"], score="value").collect()))
    assert base == again


def test_bh_against_definition(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.5, 0.9]
    df = spark.createDataFrame([("g", f"f{i}", x) for i, x in enumerate(p)], "g string, id string, p double")
    got = {r.id: r.q for r in scores.bh_adjust(df, ["g"]).collect()}
    n = len(p)
    for i, x in enumerate(p):
        want = min(min(1.0, y * n / sum(z <= y for z in p)) for y in p if y >= x)
        assert got[f"f{i}"] == pytest.approx(want)


@pytest.mark.parametrize("slices", [16, 300, 5000])
def test_dealt_does_not_depend_on_slices(spark, frame, slices):
    _, df = frame
    hashed = df.withColumn("h", F.md5("id"))
    plain = {(r.g, r.id): r.pos for r in od.dealt(hashed, ["g"], "h", "pos").collect()}
    got = {(r.g, r.id): r.pos for r in od.dealt(hashed, ["g"], "h", "pos", slices).collect()}
    assert got == plain


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kind", ["double", "long", "decimal(30,2)", "string"])
def test_slices_do_not_change_the_order(spark, kind, descending):
    rnd = random.Random(5)
    if kind == "double":
        values = [rnd.choice([float("nan"), None, float("inf"), -0.0, 0.0, rnd.gauss(0, 1)]) for _ in range(300)]
    elif kind == "string":
        values = [rnd.choice(["", "é", "b", None, str(rnd.random())]) for _ in range(300)]
    else:
        values = [rnd.choice([None, -(2**63), 2**63 - 1, 2**62 + rnd.randrange(40)]) for _ in range(300)]
    ids = rnd.sample(range(1000), 299)
    rows = [("a" if i % 2 else "b", None if i == 299 else f"f{ids[i]}", v) for i, v in enumerate(values)]
    schema = f"g string, id string, value {'long' if kind.startswith('decimal') else kind}"
    df = spark.createDataFrame(rows, schema).withColumn("value", F.col("value").cast(kind))

    def run(limit, **more):
        out = od.numbered(df, ["g"], "value", "id", "r", descending, limit=limit, **more).collect()
        return {(r.g, r.id): r.r for r in out}

    plain = run(10_000)
    assert plain == run(20) == run(None, bounded=True)
    assert len(plain) == 300
    if kind == "double":
        missing = {(g, i) for g, i, v in rows if v is None or v != v}
        for g in "ab":
            last = sum(k[0] == g for k in plain) - sum(k[0] == g for k in missing)
            assert all((r > last) == (k in missing) for k, r in plain.items() if k[0] == g)


def test_correlations_read_their_pairs_once(small_tasks):
    """In slices the pairs are written before they are ranked; the figures are those of one task."""
    rows = [(g, float(i % 7), float((i * 37) % 101) if i % 9 else None, i) for g in "ab" for i in range(200)]
    df = small_tasks.createDataFrame(rows, "g string, x double, y double, id int")
    seen = small_tasks.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    counting = df.withColumn("x", counted.asNondeterministic()("x"))
    out = correlations(counting, ["g"], "x", "y").orderBy("g").collect()
    assert seen.value == len(rows)
    for a, b in zip(out, correlations(df, ["g"], "x", "y", bounded=True).orderBy("g").collect()):
        assert a.n == b.n and abs(a.pearson - b.pearson) < 1e-12 and abs(a.spearman - b.spearman) < 1e-12
