"""Missing values, small units, gaps and foreign working folders."""

import math
import os
import subprocess
import sys
import textwrap

import pytest

from sievework.operators import gramian, quality, scores, stability
from sievework.sources import matrices

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nan_scores_and_pairs_are_missing(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.1), (1, 0, math.nan)]
    auc = scores.auc_score(spark.createDataFrame(rows, "k int, label int, score double"), ["k"]).first()
    assert (auc.auc, auc.n_pos, auc.n_neg) == (1.0, 1, 1)
    pairs = [(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0), (1, math.nan, 0.0)]
    r = stability.correlations(spark.createDataFrame(pairs, "k int, x double, y double"), ["k"], "x", "y").first()
    assert r.n == 3 and r.pearson == pytest.approx(1) and r.spearman == pytest.approx(1)


def test_dataset_without_finite_value_is_unknown(spark):
    rows = [("a", None), ("a", math.nan), ("b", 5.0)]
    found = quality.detect_scale(spark.createDataFrame(rows, "dataset string, value double"))
    assert {r.dataset: r.scale for r in found.collect()} == {"a": "unknown", "b": quality.LOG}
    declared = spark.createDataFrame([("a", quality.LOG), ("b", quality.LOG), ("c", quality.LOG)], "dataset string, declared string")
    checked = {r.dataset: r.passed for r in quality.verify_scale(found, declared).collect()}
    assert checked == {"a": False, "b": True, "c": False}


def test_increase_across_a_rank_gap_is_seen(spark):
    ranking = spark.createDataFrame([("f", 1, 9.0), ("g", 2, 8.0), ("h", 4, 99.0)], "feature string, rank int, score double")
    ranking = ranking.selectExpr("1 AS split", "'m' AS method", "*")
    pool = ranking.select("split", "feature")
    row = quality.validate_rankings(ranking, pool, ["split", "method"], ["split"]).first()
    assert row.increasing == 1 and not row.passed


@pytest.mark.parametrize("unit", [1e-8, 1.0, 1e6])
def test_correlation_does_not_depend_on_the_unit(spark, unit):
    a, b = [1.0, 2.0, 4.0, 3.0], [2.0, 1.0, 5.0, 3.0]
    rows = [(1, f"s{i}", f, v * unit) for f, x in (("a", a), ("b", b), ("c", [7.0] * 4)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "split int, sample_id string, feature string, value double")
    edge = gramian.correlation_edges(df, ["split"]).collect()
    assert [(r.feature_a, r.feature_b) for r in edge] == [("a", "b")]
    assert edge[0].r == pytest.approx(0.8315, abs=1e-3)


def test_file_without_an_id_stops(spark, tmp_path):
    (tmp_path / "odd.txt").write_text("feature\tvalue\ng\t1\n")
    with pytest.raises(Exception, match="no sample id"):
        matrices.read_per_sample_files(spark, str(tmp_path), r"(GSM\d+)").collect()


def test_udf_query_from_another_folder(tmp_path):
    code = f"""
        import importlib.util
        from pyspark.sql import SparkSession
        spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        print("rows", len(module.queries()["corrected_t_interval"](spark, "/root/testdata/sf0.001").collect()))
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "rows" in done.stdout, done.stderr[-2000:]


def test_per_sample_files_with_another_header_stop(spark, tmp_path):
    for name, text in (("s1", "gene\ttpm\na\t1\nb\t2\n"), ("s2", "gene\ttpm\na\t3\n")):
        (tmp_path / f"{name}.tsv").write_text(text)
    rows = matrices.read_per_sample_files(spark, str(tmp_path), r"(s\d)\.tsv")
    assert sorted(map(tuple, rows.collect())) == [("s1", "a", 1.0), ("s1", "b", 2.0), ("s2", "a", 3.0)]
    (tmp_path / "s3.tsv").write_text("tpm\tgene\n5\ta\n")
    with pytest.raises(Exception, match="header"):
        matrices.read_per_sample_files(spark, str(tmp_path), r"(s\d)\.tsv").collect()


def test_long_rankings_write_their_measures_once(small_tasks):
    """Rankings too long for a task have the rows of short ones, and ordering them reads no table again."""
    from catalog import standins
    from catalog.base import Tables

    t = Tables(small_tasks, "/root/testdata/sf0.001")
    names = [*standins.SPLIT, "method", "feature", "score", "rank"]
    small_tasks.conf.set("sievework.rowsPerTask", "5000")
    long = standins.rankings(t).select(*names)
    assert "lineitem.parquet" not in long._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lineitem.parquet" in f for f in long.inputFiles())
    got = sorted(map(tuple, long.collect()))
    small_tasks.conf.unset("sievework.rowsPerTask")
    assert got == sorted(map(tuple, standins.rankings(t).select(*names).collect())) != []


def test_leading_rankings_among_order_only_few(spark):
    """The first of the allowed features, without ordering the others."""
    from catalog import standins, stability
    from catalog.base import Tables
    from sievework.operators.ranking import top_k

    t, key = Tables(spark, "/root/testdata/sf0.001"), [*standins.SPLIT, "method"]
    allowed = stability.half_pool(t)
    near = standins.leading_rankings_among(t, 5, allowed, ["dataset", "feature"])
    a, b = (top_k(r, key, [2, 5], allowed, ["dataset", "feature"]) for r in (near, standins.rankings(t)))
    names = [*key, "k", "rank", "feature"]
    assert sorted(map(tuple, a.select(*names).collect())) == sorted(map(tuple, b.select(*names).collect())) != []
    assert near.count() < standins.rankings(t).count()
