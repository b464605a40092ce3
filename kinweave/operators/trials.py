"""Reports over model trials."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.schemas import TRIAL_COLUMNS

# Class names by number.
CLASSES = ["retired", "graduated"]

# Option letters of a strategy string and what they stand for.
OPTION_LETTERS = {
    "*": "interval", "%": "proportion-interval", "l": "lag-interval", "j": "jitter",
    "n": "normalize-actdev", "m": "normalize-minmax", "z": "normalize-zscore",
    "a": "aggregate", "d": "diff", "u": "upsample", "b": "downsample", "c": "feature-subset",
}

# Data sets by letter, their default versions and version notes.
DATASETS = {"A": "apache", "G": "github", "E": "eclipse"}
DEFAULT_VERSIONS = {"apache": ("1", "1"), "github": ("3", "4"), "eclipse": ("1", "1")}
TECH_NOTES = {
    "apache": {"1": "filepaths cleaned commits data"},
    "github": {"3": "source imputation, bot-free, dealiased commits data"},
    "eclipse": {"1": "dealiased w/ source files & bots commits data, now aggregated by project"},
}
SOCIAL_NOTES = {
    "apache": {"1": "sender name cleaned emails data"},
    "github": {"4": "reply imputed, m-id imputed, bot-free, de-aliased issues data"},
    "eclipse": {"1": "deliased w/ reply & bots issues data"},
}

# The strategy families compared with each other.
FAMILIES = [
    "A{opt}^ --> A{t_opt}^^",
    "E{opt} --> A{t_opt}",
    "A{opt}^ + E{opt} --> A{t_opt}^^",
    "A{opt} --> E{t_opt}",
    "E{opt}^ --> E{t_opt}^^",
    "A{opt} + E{opt}^ --> E{t_opt}^^",
    "A{opt} --> G{t_opt}",
    "E{opt} --> G{t_opt}",
    "A{opt} + E{opt} --> G{t_opt}",
    "A{opt}^ + E{opt}^ --> A{t_opt}^^ + E{t_opt}^^",
    "A{opt}^ + E{opt}^ --> A{t_opt}^^ + E{t_opt}^^ + G{t_opt}",
]

# The three option sets of the standard reports.
PRESETS = {"exp1": "cbn", "exp2": "cbna", "exp3": "cbnd"}

DEFAULT_METRICS = [("accuracy", "accuracy"), ("macro avg", "f1-score"), ("weighted avg", "f1-score")]


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(preds: DataFrame, keys: list[str], classes: list[str] = CLASSES) -> DataFrame:
    """Precision, recall and F1 per class, their averages and the accuracy, in long form.

    `preds` has `pred` and `target` as class numbers.  One grouping counts
    everything; undefined ratios are 0 and classes nobody belongs to are left out.
    """
    hit = lambda cond: F.sum(cond.cast("long"))
    pred, target = F.col("pred"), F.col("target")
    counts = [F.count(F.lit(1)).alias("_n"), hit(pred == target).alias("_right")]
    for i in range(len(classes)):
        counts += [
            hit((pred == i) & (target == i)).alias(f"_tp{i}"), hit(pred == i).alias(f"_pp{i}"),
            hit(target == i).alias(f"_s{i}")]
    sums = preds.groupBy(*keys).agg(*counts)
    metric = {}
    for i in range(len(classes)):
        tp, pp, s = F.col(f"_tp{i}"), F.col(f"_pp{i}"), F.col(f"_s{i}")
        p, r = _over(tp, pp), _over(tp, s)
        metric[i] = {"precision": p, "recall": r, "f1-score": _over(2 * tp, pp + s)}
    rows = []
    n = F.col("_n")

    def add(label: str, name: str, value: Column, support: Column) -> None:
        rows.append(F.struct(
            F.lit(label).alias("label"), F.lit(name).alias("metric"), value.alias("perf"),
            support.alias("support")))

    for i, label in enumerate(classes):
        for name, value in metric[i].items():
            add(label, name, value, F.col(f"_s{i}"))
    for name in ("precision", "recall", "f1-score"):
        weighted = reduce(lambda a, b: a + b, [metric[i][name] * F.col(f"_s{i}") for i in metric])
        add("weighted avg", name, _over(weighted, n), n)
        add("macro avg", name, reduce(lambda a, b: a + b, [m[name] for m in metric.values()]) / len(classes), n)
    add("accuracy", "accuracy", _over(F.col("_right"), n), n)
    return sums.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*").where("support > 0")


def append(trials: DataFrame | None, report: DataFrame, date: str) -> DataFrame:
    """The store with a report's rows added under a date; without a store, just those rows."""
    rows = report.withColumn("date", F.lit(date))
    if "month" not in rows.columns:
        rows = rows.withColumn("month", F.lit("all"))
    rows = rows.select(*TRIAL_COLUMNS)
    return rows if trials is None else trials.select(*TRIAL_COLUMNS).unionByName(rows)


def remove(trials: DataFrame, values: dict[str, object]) -> DataFrame:
    """Drop the rows equal to all of the given column values."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in values.items()])
    return trials.where(~same)


def summary(trials: DataFrame, metrics: list[str] | None = None, full: bool = True,
            average: str = "macro") -> DataFrame:
    """Max, mean, deviation and count of score and support per strategy, model, month and metric."""
    kept = trials if full else trials.where(F.col("month") == "all")
    kept = kept.where(F.col("label").isin(f"{average} avg", "accuracy") & F.col("metric").isin(metrics or ["accuracy"]))
    stats = [
        fn(c).alias(f"{c}_{name}") for c in ("perf", "support")
        for name, fn in (("max", F.max), ("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    keys = ["transfer_strategy", "model_arch", "month", "label", "metric"]
    return kept.groupBy(*keys).agg(*stats).orderBy(F.desc("perf_mean"), *keys)


def _pick(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _dataset_text(token: Column) -> Column:
    letter = F.regexp_extract(token, r"^\s*([a-zA-Z])", 1)
    name = _pick(DATASETS, letter)
    version = r"^\s*[a-zA-Z]-(\d+)-(\d+)"
    given = lambda group: F.nullif(F.regexp_extract(token, version, group), F.lit(""))
    tech = F.coalesce(given(1), _pick({k: v[0] for k, v in DEFAULT_VERSIONS.items()}, name))
    social = F.coalesce(given(2), _pick({k: v[1] for k, v in DEFAULT_VERSIONS.items()}, name))
    flat = lambda notes: {f"{d}|{v}": note for d, by in notes.items() for v, note in by.items()}
    at = lambda v: F.concat(name, F.lit("|"), v)
    return F.concat_ws(", ", name, _pick(flat(TECH_NOTES), at(tech)), _pick(flat(SOCIAL_NOTES), at(social)))


def describe_strategy(strategy) -> Column:
    """A strategy string in words: which data it trains and tests on, in which version."""
    sides = F.split(strategy, "-->")
    text = lambda side: F.array_join(F.transform(F.split(side, r"\s*\+\s*"), _dataset_text), ",")
    return F.concat(
        F.lit("["), F.col(strategy) if isinstance(strategy, str) else strategy, F.lit("] -- trained w/ {"),
        text(sides[0]), F.lit("}; tested w/ {"), text(sides[1]), F.lit("}"))


def compare(trials: DataFrame, field: str = "model_arch") -> DataFrame:
    """Mean and deviation of the accuracy by one field; strategies without digits and interval runs."""
    if field not in ("transfer_strategy", "model_arch", "month"):
        raise ValueError(f"unsupported field {field!r}")
    rows = trials.where(F.col("metric") == "accuracy")
    if field == "transfer_strategy":
        rows = rows.where(~F.col(field).contains("*"))
        bare = F.transform(F.split(field, "-->"), lambda t: F.regexp_replace(t, "[0-9-]", ""))
        rows = rows.withColumn(field, F.array_join(bare, " --> "))
    return rows.groupBy(field).agg(F.avg("perf").alias("mean"), F.stddev_samp("perf").alias("std")).orderBy("mean", field)


def option_filter(options: str, strict: bool = True) -> Column:
    """Strategies with any of the letters; strict: no other letter, all of them side by side."""
    chosen = [c for c in OPTION_LETTERS if c in options]
    either = lambda letters: "[" + "".join(re.escape(c) for c in letters) + "]"
    s = F.col("transfer_strategy")
    keep = s.rlike(either(chosen))
    if strict:
        others = [c for c in OPTION_LETTERS if c not in chosen]
        n = len(chosen)
        block = "".join(f"(?=.{{0,{n - 1}}}{re.escape(c)})" for c in chosen)
        keep = keep & s.rlike(f"(?={either(chosen)}{{{n}}}){block}")
        if others:
            keep = keep & ~s.rlike(either(others))
    return keep


def metric_column(label: str, metric: str) -> str:
    """Column name of a (label, metric) pair, e.g. `macro-f1`."""
    if label == "accuracy":
        return "accuracy"
    return f"{label.replace(' avg', '')}-{metric.replace('f1-score', 'f1')}"


def breakdown(trials: DataFrame, pattern: str | None = None, options: str | None = None,
              metrics: list[tuple[str, str]] | None = None, agg: str = "mean", strict: bool = True,
              by: list[str] | None = None) -> DataFrame:
    """One row per strategy with its metrics as columns and the support of the accuracy."""
    metrics = metrics or DEFAULT_METRICS
    if pattern is not None:
        rows = trials.where(F.col("transfer_strategy").rlike("^(?:" + pattern + ")"))
    elif options is not None:
        rows = trials.where(option_filter(options, strict))
    else:
        raise ValueError("give a pattern or options")
    fn = {"mean": F.avg, "median": F.median, "max": F.max}[agg]
    is_pair = lambda l, m: (F.col("label") == l) & (F.col("metric") == m)
    rows = rows.where(reduce(lambda a, b: a | b, [is_pair(l, m) for l, m in metrics]))
    cols = [fn(F.when(is_pair(l, m), F.col("perf"))).alias(metric_column(l, m)) for l, m in metrics]
    support = fn(F.when(is_pair(*metrics[0]), F.col("support"))).cast("double").alias("support")
    order = [F.desc(metric_column(l, m)) for l, m in metrics]
    keys = [*(by or []), "transfer_strategy"]
    return (
        rows.groupBy(*keys).agg(*cols, support).withColumnRenamed("transfer_strategy", "strat")
        .orderBy(*order, F.desc("support"), "strat"))


def melt_top(table: DataFrame, metrics: list[tuple[str, str]] | None = None, n: int = 10) -> DataFrame:
    """The first `n` strategies of a breakdown as (strat, metric, value) rows."""
    names = [metric_column(l, m) for l, m in (metrics or DEFAULT_METRICS)]
    order = [F.desc(c) for c in names]
    top = table.orderBy(*order, F.desc("support"), "strat").limit(n)
    return top.unpivot(["strat"], names, "metric", "value")


BEST_METRICS = [
    ("accuracy", "accuracy"), ("weighted avg", "f1-score"), ("weighted avg", "precision"),
    ("weighted avg", "recall"),
]


def family_patterns(any_options: bool = True) -> dict[str, str]:
    """Pattern of each family: any options, or the standard ones only."""
    out = {}
    for family in FAMILIES:
        if any_options:
            plain = family.replace("{t_opt}", "{opt}")
            out[family] = "[^+]*".join(re.escape(part) for part in plain.split("{opt}")) + "$"
        else:
            plain = family.replace("{t_opt}", "cn").replace("{opt}", "cbn")
            out[family] = re.escape(plain) + "$"
    return out


def best(trials: DataFrame, agg: str = "median", any_options: bool = True,
         by: list[str] | None = None) -> DataFrame:
    """The best strategy of each family, optionally within each value of other columns.

    The families are a fixed list, so matching them is an expression of the row
    and needs no join; the winner is an aggregate and needs no window.
    """
    by = by or []
    matches = F.filter(
        F.array(*[
            F.when(F.col("transfer_strategy").rlike("^(?:" + p + ")"), F.lit(f))
            for f, p in family_patterns(any_options).items()]),
        lambda f: f.isNotNull())
    rows = trials.withColumn("family", F.explode(matches))
    names = [metric_column(l, m) for l, m in BEST_METRICS]
    table = breakdown(rows, pattern=".*", metrics=BEST_METRICS, agg=agg, by=["family", *by])
    winner = F.min_by(F.struct("strat", *[F.col(f"`{c}`") for c in names], "support"), F.struct(
        *[-F.col(f"`{c}`") for c in names], -F.col("support"), F.col("strat")))
    won = table.groupBy("family", *by).agg(winner.alias("_b"))
    return won.select("family", *by, "_b.*")


def latest_run(trials: DataFrame, strategy: str, arch: str, labels: list[str], metrics: list[str],
               since: str | None = None, slack_seconds: int = 5) -> DataFrame:
    """Rows of the last run of a strategy: since a given time, else close to the last row."""
    rows = trials.where(
        (F.col("transfer_strategy") == strategy) & (F.col("model_arch") == arch)
        & F.col("label").isin(labels) & F.col("metric").isin(metrics))
    rows = rows.withColumn("_at", F.to_timestamp("date"))
    last = rows.agg(F.max("_at").alias("m")).first()["m"]
    if last is None:
        return rows.drop("_at")
    if since is not None:
        recent = rows.where(F.col("_at") >= F.to_timestamp(F.lit(since)))
        if not recent.isEmpty():
            return recent.drop("_at")
    edge = F.lit(last) - F.make_interval(secs=F.lit(slack_seconds))
    return rows.where(F.col("_at") >= edge).drop("_at")


def month_order(month) -> Column:
    """Number in front of an interval name; `all` has none and comes last."""
    return F.expr(f"try_cast(split_part({month}, '-', 1) AS double)")


METRICS = ["f1-score", "precision", "recall"]


def over_steps(trials: DataFrame, strategy: str, arch: str, labels: list[str] = CLASSES,
               metrics: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Mean metrics and support by interval step, classes together, in step order."""
    metrics = metrics or METRICS
    rows = latest_run(trials, strategy, arch, labels, metrics, since)
    cols = [F.avg(F.when(F.col("metric") == m, F.col("perf"))).alias(m) for m in metrics]
    total = F.sum(F.when(F.col("metric") == metrics[0], F.col("support"))).alias("support")
    return rows.groupBy("month").agg(*cols, total).orderBy(month_order("month").asc_nulls_last())


def plot_table(trials: DataFrame, strategy: str, arch: str, metric: str = "f1-score", stop: int = 250,
               labels: list[str] = CLASSES) -> DataFrame:
    """Mean of one metric by class and step number; `all` follows the last step."""
    rows = latest_run(trials, strategy, arch, labels, [metric])
    name = F.concat("transfer_strategy", F.lit("-"), "label")
    means = rows.groupBy(name.alias("label"), month_order("month").alias("step")).agg(F.avg("perf").alias("value"))
    longest = means.agg(F.max("step").alias("m")).first()["m"] or 0.0
    step = F.coalesce("step", F.lit(float(longest) + 1))
    return means.withColumn("step", step).where(F.col("step") <= stop).orderBy("step", "label")


def best_trial(records: DataFrame) -> DataFrame:
    """Best record of each strategy and model, and what the others amount to.

    Ranked by accuracy, F1, precision, recall; an aggregate, so a strategy with
    most of the records is still combined by many tasks.
    """
    rank = F.struct("acc", "f1", "prec", "rec", "trial")
    best = F.max_by(F.struct("trial", "acc", "f1", "prec", "rec", "size"), rank)
    return records.groupBy("transfer_strategy", "model_arch").agg(
        best.alias("_b"), (F.count(F.lit(1)) - 1).alias("others"), F.sum("size").alias("_t")
    ).select(
        "transfer_strategy", "model_arch", "_b.trial", "_b.acc", "_b.f1", "_b.prec", "_b.rec", "others",
        (F.col("_t") - F.col("_b.size")).alias("others_size"))
