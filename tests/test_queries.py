"""Registered queries against their SQL twins on the smallest data."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

from kinweave.queries import QUERIES, SQL
from kinweave.sources.views import TABLES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
from check_oracle import rows_of  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = [
    "translate_schema", "clean_strings", "rollup_status", "infer_bots", "infer_replies", "similar_pairs",
    "reference_tokens", "social_edges", "f_overlap", "f_social_clustering", "interval_lag", "balanced_split",
    "traj_ar", "class_report", "best_perfs", "perf_over_steps", "src_edges", "stream_activity", "panel",
]
NAMES = sorted(QUERIES) if os.environ.get("TEST_ALL_QUERIES") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert df.columns
        return
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)
