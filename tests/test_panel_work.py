"""Transforms, labels, trajectories and trial reports on small hand-made panels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators import datasets, scoring, statistics, trajectories, transforms, trials


@pytest.fixture(scope="module")
def panel(spark):
    data = [(p, m, float(m * k + 1), float((m * 7 + k) % 5), m % 3) for k, (p, n) in enumerate(
        [("a", 12), ("b", 3), ("c", 1), ("d", 20)], 1) for m in range(n)]
    return spark.createDataFrame(data, "proj_name string, month int, x double, y double, st_num_dev int")


def test_intervals(panel):
    out = transforms.intervals(panel)
    found = {(r["base_project"], r["step"]): r["count"] for r in out.where("step <> 'all'").groupBy("base_project", "step").count().collect()}
    assert found == {("a", f"{e}-months"): e for e in range(1, 11)} | {("b", "1-months"): 1} | {
        ("d", f"{e}-months"): e for e in range(1, 19)}
    lengths = panel.groupBy(F.col("proj_name").alias("project")).agg((F.max("month") + 1).alias("months"))
    checks = {r["base_project"]: r for r in transforms.check_intervals(out, lengths).collect()}
    assert checks["a"]["passed"] == 1 and checks["b"]["passed"] == 1 and checks["c"]["found"] == 0


def test_shares(panel):
    steps = lambda df, p: {r["step"]: (r["lo"], r["hi"]) for r in df.where(
        f"base_project = '{p}' AND step <> 'all'").groupBy("step").agg(F.min("month").alias("lo"), F.max("month").alias("hi")).collect()}
    whole = transforms.proportion_intervals(panel)
    assert steps(whole, "d") == {f"{i}-steps": (0, min(math.ceil((i + 1) * 2.5), 19)) for i in range(7)}
    assert steps(whole, "b") == {f"{i}-steps": (0, 0) for i in range(5)} | {"5-steps": (0, 1), "6-steps": (0, 2)}
    assert steps(whole, "c") == {}
    back = steps(transforms.proportion_intervals(panel, backwards=True), "d")
    assert back["7-lag-steps"] == (18, 19) and back["1-lag-steps"] == (3, 5) and len(back) == 8


def test_diff_and_sums(panel):
    pdf = panel.toPandas().sort_values(["proj_name", "month"])
    rolled = pdf.groupby("proj_name")["x"].transform(lambda s: s - s.rolling(3, min_periods=1).mean().shift(1, fill_value=0))
    want = {(p, m): v for p, m, v in zip(pdf.proj_name, pdf.month, rolled) if m >= 3}
    got = {(r["proj_name"], r["month"]): r["x_diff"] for r in transforms.diff(panel).collect()}
    assert got == pytest.approx(want)
    sums = {(r["proj_name"], r["month"]): r["y"] for r in transforms.cumulate(panel).collect()}
    assert sums == pytest.approx(dict(zip(zip(pdf.proj_name, pdf.month), pdf.groupby("proj_name")["y"].cumsum())))
    assert "x_agg" in transforms.cumulate(panel, concat=True).columns


def test_scaling(panel):
    z = transforms.normalise(panel, "zscore")
    assert z.where("proj_name = 'c'").first()["x"] is None          # no deviation of one row
    assert transforms.drop_incomplete(z).where("proj_name = 'c'").count() == 0
    per = transforms.normalise(panel, "actdev").where("proj_name = 'a' AND month = 2").first()
    assert per["x"] == pytest.approx(1.5) and per["st_num_dev"] == 1
    with pytest.raises(ValueError):
        transforms.normalise(panel, "other")


def test_jitter_is_repeatable(panel):
    one = transforms.jitter(panel).orderBy("proj_name", "month").collect()
    two = transforms.jitter(panel.repartition(7)).orderBy("proj_name", "month").collect()
    assert one == two
    base = {(r["proj_name"], r["month"]): r["x"] for r in panel.collect()}
    made = [r for r in one if r["proj_name"].startswith("[")]
    moved = [r for r in made if r["x"] != base[r["proj_name"][1:-5], r["month"]]]
    assert len(made) == 36 and len(moved) == 4 + 1 + 0 + 8
    assert all(abs(r["x"] / base[r["proj_name"][1:-5], r["month"]] - 1) <= 0.05 for r in made)


def test_balance(spark, panel):
    status = spark.createDataFrame([("a", "graduated"), ("b", "graduated"), ("c", "graduated"), ("d", "retired")], "project string, status string")
    up = transforms.upsample(panel, status.select("project"), status)
    assert {r[0] for r in up.where("proj_name LIKE '[%'").select("proj_name").distinct().collect()} == {"[d]-jit-0", "[d]-jit-1"}
    down = transforms.downsample(panel, status)
    kept = {r[0] for r in down.select("proj_name").distinct().collect()}
    assert "d" in kept and len(kept) == 3


def test_describe(panel):
    pdf = panel.toPandas()
    got = {r["feature"]: r for r in statistics.describe(panel).collect()}
    for c in ("x", "y"):
        want = pdf[c].describe()
        assert [got[c][k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want))
    each = pdf.groupby("proj_name")[["x", "y"]].describe().mean()
    row = {r["feature"]: r for r in statistics.describe_by_project(panel).collect()}["x"]
    assert row["std"] == pytest.approx(each["x"]["std"]) and row["q75"] == pytest.approx(each["x"]["75%"])


def test_split_shares(spark):
    data = [(f"g{i}", "graduated") for i in range(13)] + [(f"r{i}", "retired") for i in range(7)] + [("i", "incubating")]
    status = spark.createDataFrame(data, "project string, status string")
    counts = lambda **kw: {(r["status"], r["part"]): r["count"] for r in datasets.stratified_split(status, 0.3, **kw).groupBy("status", "part").count().collect()}
    assert counts() == {("graduated", "test"): 4, ("graduated", "train"): 9, ("retired", "test"): 3, ("retired", "train"): 4}
    assert counts(max_diff=0.1) == {("graduated", "test"): 4, ("graduated", "train"): 5, ("retired", "test"): 3, ("retired", "train"): 4}
    with pytest.raises(ValueError):
        datasets.fixed_split(status)


def test_mix_balances_training(spark, panel):
    status = spark.createDataFrame([("a", "graduated"), ("b", "graduated"), ("d", "graduated"), ("c", "retired")], "project string, status string")
    made = lambda role, *options: {r[0] for r in datasets.dataset_mix(
        [datasets.Source(role, "x", False, options)], {"x": panel}, {"x": status}).select("proj_name").distinct().collect()}
    assert made("train", "upsample") == {"a", "b", "c", "d", "[c]-jit-0", "[c]-jit-1"}
    assert made("test", "upsample") == {"a", "b", "c", "d"}
    assert len(made("train", "downsample")) == 3
    with pytest.raises(ValueError):
        datasets.augment(panel, ["nonsense"])


def series(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "project string, month int, p double")


def simple(values, lag=3, k=3):
    out = {}
    for i in range(lag, len(values)):
        g, pos = (values[i - 1] - values[i - lag]) / (lag - 1), values[i]
        path = []
        for _ in range(k + 1):
            pos = min(1, max(0, pos))
            path.append(pos)
            pos += g
            g *= abs((0 if g < 0 else 1) - pos)
        out[i] = path
    return out


SHAPES = {
    "linear": np.linspace(0, 0.7, 10),
    "walk": np.cumsum(np.random.default_rng(3).random(10) / 10),
    "sine": np.sin(np.linspace(0, 2 * np.pi, 10)) / 2 + 0.5,
    "sigmoid": 1 / (1 + np.exp(-np.linspace(-6, 6, 10))),
    "constant": np.full(6, 0.4), "top": np.full(6, 1.0), "bottom": np.full(6, 0.0),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_paths(spark, shape):
    values = SHAPES[shape]
    df = series(spark, values)
    got = {r["month"]: r["neutral"] for r in trajectories.traj_simple(df).collect()}
    want = simple(list(map(float, values)))
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m], abs=1e-9) for m in want)
    for r in trajectories.trajectories(df, "AR").collect():
        assert len(r["path"]) == 4 and all(0 <= v <= 1 for v in r["path"])
        assert r["path"][0] == pytest.approx(min(1, max(0, values[r["month"]])))


def test_known_path(spark):
    df = series(spark, [0.3, 0.4, 0.5, 0.5])
    assert trajectories.traj_simple(df).first()["neutral"] == pytest.approx([0.5, 0.6, 0.64, 0.6544])
    kinds = {r["kind"]: r["path"] for r in trajectories.trajectories(df, "SIMPLE").collect()}
    assert kinds["NEGATIVE"] is None and kinds["POSITIVE"] is None


def test_path_errors(spark):
    with pytest.raises(ValueError):
        trajectories.check_series(series(spark, [0.1, 0.2]), 3)
    for fn in (trajectories.traj_simple, trajectories.traj_ar, trajectories.traj_ar_lags):
        with pytest.raises(ValueError):
            fn(series(spark, [0.1] * 5), lag=1)
    assert trajectories.traj_simple(series(spark, [0.1, 0.2])).count() == 0


def lagged_path(values, lag, k):
    """The equations solved as a matrix, and the band from the weights of past shocks."""
    import numpy as np
    d = np.diff(values)
    m, mean = len(d), np.mean(d)
    z = d - mean
    c = np.array([z[h:] @ z[: m - h] / m if h < m else 0.0 for h in range(lag + 1)])
    phi = np.linalg.solve([[c[abs(i - j)] for j in range(lag)] for i in range(lag)], c[1:])
    rest, past, at = c[0] - phi @ c[1:], list(z[::-1][:lag]), values[-1]
    shocks, mid, half = [], [values[-1]], [0.0]
    for i in range(k):
        past = [phi @ past[:lag], *past]
        at += mean + past[0]
        shocks.append(1.0 if i == 0 else sum(phi[j - 1] * shocks[i - j] for j in range(1, min(lag, i) + 1)))
        mid.append(min(max(at, 0.0), 1.0))
        half.append(half[0] + 1.959963984540054 * np.sqrt(rest * np.sum(np.cumsum(shocks) ** 2)))
    return mid, half


@pytest.mark.parametrize("lag", [2, 3, 6])
def test_path_of_several_lags(spark, lag):
    import random
    draw = random.Random(lag)
    values = [0.5]
    for _ in range(19):
        values.append(min(max(values[-1] + draw.uniform(-0.1, 0.1), 0.05), 0.95))
    got = {r["month"]: r for r in trajectories.traj_ar_lags(series(spark, values), lag, 5).collect()}
    assert sorted(got) == list(range(lag, 20))
    for month in (lag, 10, 19):
        mid, half = lagged_path(values[: month + 1], lag, 5)
        assert got[month]["neutral"] == pytest.approx(mid, abs=1e-8)
        assert [b - a for a, b in zip(got[month]["negative"], got[month]["positive"])] == pytest.approx([2 * h for h in half], abs=1e-7)


def test_flat_and_short_series_of_several_lags(spark):
    flat = trajectories.traj_ar_lags(series(spark, [0.4] * 8), 3, 2).collect()
    assert len(flat) == 5 and all(r["neutral"] == r["negative"] == r["positive"] == [0.4] * 3 for r in flat)
    line = trajectories.traj_ar_lags(series(spark, [0.1, 0.2, 0.3, 0.4, 0.5]), 3, 2).collect()[-1]
    assert line["neutral"] == pytest.approx([0.5, 0.6, 0.7]) == line["positive"]
    assert trajectories.traj_ar_lags(series(spark, [0.1, 0.2, 0.3]), 3).count() == 0
    kinds = trajectories.trajectories(series(spark, [0.1, 0.3, 0.2, 0.4, 0.5]), "AR_LAGS").select("kind").distinct().count()
    assert kinds == 3


def test_merges(spark, rows):
    new, old = series(spark, [0.1, 0.2, 0.3]), series(spark, [0.9, 0.8])
    assert rows(scoring.merge_forecasts(new, old), "month", "p") == [(0, 0.9), (1, 0.8), (2, 0.3)]


def test_scores(spark, panel):
    status = spark.createDataFrame([("a", "graduated"), ("b", "retired"), ("c", "retired"), ("d", "graduated")], "project string, status string")
    rows = datasets.label_projects(panel, status)
    model = scoring.fit(rows)
    scores = scoring.score_months(rows.drop("label"), model)
    assert scores.count() == 36 and scores.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    assert scoring.predict_labels(rows, model, 12).count() == 4
    soft = scoring.soft_labels(rows, model, 12)
    assert soft.count() == 36 and soft.select("proj_name", "soft_label").distinct().count() == 4


def test_report_by_hand(spark):
    preds = spark.createDataFrame([("s", 1, 1), ("s", 1, 0), ("s", 0, 0), ("s", 1, 1), ("t", 1, 1)], "k string, pred int, target int")
    got = {(r["k"], r["label"], r["metric"]): (round(r["perf"], 4), r["support"]) for r in trials.class_report(preds, ["k"]).collect()}
    assert got["s", "graduated", "precision"] == (0.6667, 2) and got["s", "retired", "recall"] == (0.5, 2)
    assert got["s", "accuracy", "accuracy"] == (0.75, 4) and got["s", "macro avg", "f1-score"] == (0.7333, 4)
    assert ("t", "retired", "recall") not in got and got["t", "macro avg", "recall"] == (0.5, 1)
    assert got["t", "weighted avg", "recall"] == (1.0, 1)


def test_option_letters(spark):
    names = ["Acbn --> An", "Anbc --> Acbn", "Acn --> An", "Acbna --> A", "Ac*bn --> A", "E --> A", "Acxbn --> A"]
    df = spark.createDataFrame([(n,) for n in names], "transfer_strategy string")
    kept = lambda **kw: [r[0] for r in df.where(trials.option_filter("cbn", **kw)).collect()]
    assert kept() == ["Acbn --> An", "Anbc --> Acbn"]
    assert kept(strict=False) == [n for n in names if n != "E --> A"]


def test_strategy_words(spark):
    df = spark.createDataFrame([("A-1-1cbn + G^ --> E-1-1",)], "s string")
    assert df.select(trials.describe_strategy("s")).first()[0] == (
        "[A-1-1cbn + G^ --> E-1-1] -- trained w/ {apache, filepaths cleaned commits data, sender name cleaned emails data,"
        "github, source imputation, bot-free, dealiased commits data, reply imputed, m-id imputed, bot-free, de-aliased issues data}; "
        "tested w/ {eclipse, dealiased w/ source files & bots commits data, now aggregated by project, deliased w/ reply & bots issues data}")


def test_effective_lag(spark, rows):
    assert rows(trajectories.effective_lag(series(spark, [0.1, 0.2])), "lag") == [(2,)]
    assert rows(trajectories.effective_lag(series(spark, [0.1] * 20)), "lag") == [(12,)]
