"""Rows that took a join to make are stored once and read again."""

import datetime

from kinweave.plans import jobs
from kinweave.queries import incremental, modelling


def logs_at(spark, folder):
    day = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=11 * i)
    spark.createDataFrame([(i, i % 5, day(i % 40), "1-URGENT") for i in range(60)],
                          "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(i % 60, i, i % 10, 1, 2.0, day(i % 50)) for i in range(300)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_shipdate timestamp").write.parquet(
        f"{folder}/lineitem.parquet")
    return str(folder)


def test_late_rows_read_the_joined_log_from_one_table(spark, tmp_path):
    sf = logs_at(spark, tmp_path)
    out = incremental.delta_late_rows(spark, sf)
    assert out.count() > 5 and not [f for f in out.inputFiles() if "lineitem" in f or "orders" in f]


def test_job_reads_its_request_once(spark, tmp_path):
    sf = logs_at(spark, tmp_path)
    logs = jobs.prepare(*incremental.incoming(spark, sf), ["files", "months", "sources", "names"])
    files = logs.tech.inputFiles() + logs.social.inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]


def test_training_rows_are_made_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "panel")
    spark.createDataFrame([(f"proj{p}", m, float(m + p), m % 2) for p in range(4) for m in range(8)],
                          "proj_name string, month int, a double, label int").write.parquet(path)
    monkeypatch.setattr(modelling, "small_panel", lambda spark, sf: spark.read.parquet(path))
    monkeypatch.setattr(modelling, "mixed_status", lambda spark, sf: None)
    monkeypatch.setattr(modelling.datasets, "label_projects", lambda rows, status: rows)
    rows, _ = modelling.trained(spark, "")
    assert rows.count() == 32 and path not in "".join(rows.inputFiles())
