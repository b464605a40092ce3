"""Request-shaped logs to all products."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinweave.operators import contracts, datasets, scoring, transforms
from kinweave.plans import jobs
from kinweave.schemas import SOCIAL_FIELDS, TECH_FIELDS
from kinweave.session import settle


@pytest.fixture(scope="module")
def request_logs(spark):
    tech, social = [], []
    for k, p in enumerate(("p", "q")):
        for m in range(16):
            day = dt.datetime(2022 + m // 12, 1 + m % 12, 3)
            for i in range(1 + (m * (k + 1)) % 4):
                tech.append({**{c: "x" for c in TECH_FIELDS}, "project": p, "date": str(day), "name": f"d{i}", "filename": f"a/f{i % 2}.py"})
                social.append({**{c: "x" for c in SOCIAL_FIELDS}, "repo_name": p, "issue_url": "thread", "user_name": f"d{i}",
                               "id": f"<{p}{m}{i}>", "created_at": str(day + dt.timedelta(hours=i))})
    schema = lambda fields: ", ".join(f"{c} string" for c in fields)
    return (
        spark.createDataFrame([tuple(r[c] for c in TECH_FIELDS) for r in tech], schema(TECH_FIELDS)),
        spark.createDataFrame([tuple(r[c] for c in SOCIAL_FIELDS) for r in social], schema(SOCIAL_FIELDS)))


def test_products(spark, request_logs):
    steps = ["files", "months", "replies", "sources", "bots", "names"]
    panel = jobs.compute(*request_logs, ["net-gen"], (0, -1), steps=steps)["net-gen"].cache()
    assert panel.count() == 32 and panel.agg(F.max("s_weighted_mean_degree")).first()[0] > 0
    status = spark.createDataFrame([("p", "graduated"), ("q", "retired")], "project string, status string")
    model = scoring.fit(datasets.label_projects(transforms.normalise(panel), status))
    out = jobs.compute(*request_logs, ["net-vis", "forecast", "traj"], (2, 14), model=model, steps=steps)
    months = lambda df: [r[0] for r in df.select("month").distinct().orderBy("month").collect()]
    assert months(out["forecast"]) == list(range(2, 15)) == months(out["net-vis"])
    assert months(out["traj"]) == [12, 13, 14]          # the lag is 12, and the series reach month 15
    assert {r[0] for r in out["traj"].select("kind").distinct().collect()} == {"NEUTRAL", "NEGATIVE", "POSITIVE"}
    with pytest.raises(ValueError):
        jobs.compute(*request_logs, ["forecast"])


def test_two_requests_equal_one(spark, request_logs, rows):
    steps = ["files", "months", "replies", "sources", "bots", "names"]
    tasks = ["net-gen", "net-vis"]
    whole = jobs.compute(*request_logs, tasks, (0, -1), steps=steps)
    early = [df.where(F.col(c) < "2022-09-01") for df, c in zip(request_logs, ("date", "created_at"))]
    stored = {k: settle(v) for k, v in jobs.compute(*early, tasks, (0, -1), steps=steps).items()}
    assert 0 < stored["net-gen"].count() < whole["net-gen"].count()
    later = jobs.compute(*request_logs, tasks, (0, -1), steps=steps, stored=stored)
    for name in tasks:
        assert rows(later[name], *whole[name].columns) == rows(whole[name])


def test_simple_paths(spark, request_logs):
    steps = ["files", "months", "replies", "sources", "bots", "names"]
    panel = settle(jobs.compute(*request_logs, ["net-gen"], (0, -1), steps=steps)["net-gen"])
    status = spark.createDataFrame([("p", "graduated"), ("q", "retired")], "project string, status string")
    model = scoring.fit(datasets.label_projects(transforms.normalise(panel), status))
    out = jobs.compute(*request_logs, ["traj"], (0, -1), model=model, steps=steps, strategy="SIMPLE", k=2)["traj"]
    assert {len(r[0]) for r in out.where("kind = 'NEUTRAL'").select("path").collect()} == {3}


def test_empty_logs(spark, request_logs):
    none = spark.createDataFrame([], "x int")
    with pytest.raises(ValueError):
        contracts.translate(none, request_logs[1].limit(0))
    logs = contracts.translate(request_logs[0], none)
    assert logs.social.count() == 0 and set(logs.social.columns) == set(SOCIAL_FIELDS.values())
