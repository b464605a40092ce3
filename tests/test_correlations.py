"""Correlations of features of one value and with missing values."""

from pyspark.sql import functions as F

from kinweave.operators import statistics


def test_correlations_with_a_feature_of_one_value(spark):
    rows = [("p", i, float(i), 2.0 * i, 25, None if i else 1.0) for i in range(6)]
    panel = spark.createDataFrame(rows, "proj_name string, month int, a double, b double, c long, d double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in statistics.correlations(panel).collect()}
    assert abs(got.pop(("b", "a")) - 1) < 1e-9
    assert len(got) == 5 and set(got.values()) == {None}
    assert [r["feature_a"] for r in statistics.correlations(panel, 0.5).collect()] == ["b"]


def test_correlations_leave_out_rows_without_either_value(spark):
    rows = [("p", 0, 1.0, 5.0), ("p", 1, 2.0, 3.0), ("p", 2, 4.0, 4.0), ("p", 3, None, 90.0), ("p", 4, 70.0, None)]
    panel = spark.createDataFrame(rows, "proj_name string, month int, a double, b double")
    want = panel.agg(F.corr("b", "a")).first()[0]
    assert abs(statistics.correlations(panel).first()["corr"] - want) < 1e-12
