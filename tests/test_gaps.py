"""Tables with gaps: pairs that do not occur, panels that share nothing."""

import __spark_entry__ as entry


def test_matrix_with_an_empty_cell_keeps_its_columns(spark, tmp_path):
    lines = [(1, 0), (2, 0), (2, 0), (3, 0), (1, 1), (3, 1), (3, 1), (3, 1), (5, 1)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (2,), (3,), (4,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {(r.sample_id, r.feature): r.value for r in entry.queries()["read_matrix"](spark, str(tmp_path)).collect()}
    assert got == {
        ("s1", "g00"): 1, ("s2", "g00"): 2, ("s3", "g00"): 1, ("s1", "g01"): 1, ("s3", "g01"): 3, ("s5", "g01"): 1,
    }
