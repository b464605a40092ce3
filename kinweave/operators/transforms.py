"""Panel transforms.

All windows run over the months of one series, which the calendar keeps short,
so one task per series is safe here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.chance import draw_key, uniform
from kinweave.operators.ordering import row_numbers
from kinweave.session import settle

KEYS = ["proj_name", "month"]
EXTRA = ["base_project", "step"]


def feature_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in KEYS + EXTRA]


def _series():
    return Window.partitionBy("proj_name")


def _ordered():
    return Window.partitionBy("proj_name").orderBy("month")


def normalise(panel: DataFrame, strategy: str = "actdev", eps: float = 1e-10) -> DataFrame:
    """Scale each feature within its series by z-score, range or active people."""
    w = _series()

    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        if strategy == "zscore":
            return (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + eps)
        if strategy == "minmax":
            return (x - F.min(x).over(w)) / (F.max(x).over(w) + eps)
        if strategy == "actdev":
            people = F.col("st_num_dev")
            return x / F.when(people == 0, F.lit(1)).otherwise(people)
        raise ValueError(f"unknown strategy {strategy!r}")

    scaled = {c: one(c) for c in feature_columns(panel)}
    return panel.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in panel.columns])


def drop_incomplete(panel: DataFrame) -> DataFrame:
    """Rows without a missing feature; NaN counts as missing."""
    return panel.dropna()


def incomplete_report(panel: DataFrame) -> DataFrame:
    """Missing values per feature."""
    cols = feature_columns(panel)
    counts = panel.agg(*[
        F.coalesce(F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long")), F.lit(0)).alias(c)
        for c in cols])
    return counts.unpivot([], cols, "feature", "missing")


def cumulate(panel: DataFrame, concat: bool = False) -> DataFrame:
    """Running sums of every feature; beside the originals with `concat`."""
    w = _ordered().rowsBetween(Window.unboundedPreceding, 0)
    cols = [c for c in feature_columns(panel) if not c.endswith("_diff")]
    sums = {c + "_agg" if concat else c: F.sum(c).over(w) for c in cols}
    return panel.withColumns(sums)


def diff(panel: DataFrame, n: int = 3, concat: bool = False) -> DataFrame:
    """Each feature less the mean of the up to `n` months before; the first `n` months go."""
    w = _ordered()
    cols = [c for c in feature_columns(panel) if not c.endswith("_agg")]
    lag_mean = lambda c: F.coalesce(F.avg(c).over(w.rowsBetween(-n, -1)), F.lit(0.0))
    out = panel.withColumns({
        **{f"{c}_diff": F.col(c) - lag_mean(c) for c in cols}, "_rank": F.row_number().over(w)})
    out = out.where(F.col("_rank") > n).drop("_rank")
    return out if concat else out.drop(*cols)


def _with_base(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"base_project": F.col("proj_name"), "step": F.lit("all")})


def intervals(panel: DataFrame, start: int = 0, spacing: int = 1, end: int | None = None) -> DataFrame:
    """The panel plus, for each end month e, the rows before e as series `[p]-e-months`.

    Every row finds the end months behind it by itself, so nothing is joined.
    """
    last = F.max("month").over(_series())
    stop = last if end is None else F.least(F.lit(end + 1), last)
    ahead = F.ceil((F.col("month") + 1 - start) / F.lit(spacing)).cast("int")
    first = F.lit(start) + F.greatest(ahead, F.lit(0)) * spacing
    wanted = ((F.col("_stop") - start) / F.lit(max(spacing, 1)) > 1) & (F.col("_first") < F.col("_stop"))
    rows = panel.withColumns({"_stop": stop, "_first": first}).where(wanted)
    rows = rows.withColumn("_e", F.explode(F.expr(f"sequence(_first, _stop - 1, {int(spacing)})")))
    step = F.concat(F.col("_e").cast("string"), F.lit("-months"))
    series = rows.withColumns({
        "base_project": F.col("proj_name"), "step": step,
        "proj_name": F.concat(F.lit("["), "proj_name", F.lit("]-"), step)})
    return _with_base(panel).unionByName(series.drop("_stop", "_first", "_e"))


def proportion_intervals(panel: DataFrame, proportion: float = 0.125, backwards: bool = False) -> DataFrame:
    """The panel plus its series cut at equal shares of each project's length.

    Short projects have fewer shares and are padded in front.  `backwards`
    gives the stretch between two cuts instead of everything before a cut, and
    a last stretch up to the end.
    """
    parts = round(1 / proportion)
    length = F.col("_len")
    n = F.least(length, F.lit(parts))
    size = length / n
    cut = lambda i: F.when(i < parts - n, F.lit(0)).otherwise(F.ceil((i - (parts - n) + 1) * size)).cast("int")
    total = parts if backwards else parts - 1
    hi = lambda i: F.when(i == parts - 1, length).otherwise(cut(i)).cast("int")
    lo = lambda i: F.when(i == 0, F.lit(0)).otherwise(hi(i - 1))
    options = F.transform(
        F.sequence(F.lit(0), F.lit(total - 1)),
        lambda i: F.struct(i.alias("i"), (lo(i) if backwards else F.lit(0)).alias("lo"), hi(i).alias("hi")))
    here = F.filter(options, lambda o: (F.col("month") >= o.lo) & (F.col("month") <= o.hi))
    rows = panel.withColumn("_len", F.max("month").over(_series()) + 1).where(n > 1)
    rows = rows.withColumn("_o", F.explode(here))
    step = F.concat(F.col("_o.i").cast("string"), F.lit("-lag-steps" if backwards else "-steps"))
    series = rows.withColumns({
        "base_project": F.col("proj_name"), "step": step,
        "proj_name": F.concat(F.lit("["), "proj_name", F.lit("]-"), step)})
    return _with_base(panel).unionByName(series.drop("_len", "_o"))


def check_intervals(panel: DataFrame, lengths: DataFrame, start: int = 0, spacing: int = 1,
                    end: int | None = None) -> DataFrame:
    """Per base project: series expected and found, and series with a wrong row count."""
    sizes = panel.where("step <> 'all'").groupBy("base_project", "step").agg(F.count(F.lit(1)).alias("n"))
    want = F.split_part("step", F.lit("-"), F.lit(1)).cast("long")
    found = sizes.groupBy("base_project").agg(
        (F.count(F.lit(1)) + 1).alias("found"), F.sum((F.col("n") != want).cast("long")).alias("wrong"))
    months = F.col("months") if end is None else F.least(F.lit(end), F.col("months"))
    base = lengths.select(
        F.col("project").alias("base_project"),
        F.ceil((months - start - 1) / F.lit(max(spacing, 1))).cast("long").alias("expected"))
    return base.join(found, "base_project", "full_outer").select(
        "base_project", "expected", F.coalesce("found", F.lit(0)).alias("found"),
        F.coalesce("wrong", F.lit(0)).alias("wrong"),
        (F.col("expected").eqNullSafe(F.col("found")) & (F.coalesce("wrong", F.lit(0)) == 0)).cast("int").alias("passed"))


def match_base(panel: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds `base`: the known project a series comes from, else the series itself."""
    inner = F.regexp_extract("proj_name", r"\[(.*?)\]", 1)
    exact = bases.select(F.col("project").alias("_exact"))
    wrapped = bases.select(F.col("project").alias("_inner"))
    return (
        panel.withColumn("_in", inner)
        .join(exact, F.col("proj_name") == F.col("_exact"), "left")
        .join(wrapped, F.col("_in") == F.col("_inner"), "left")
        .withColumn("base", F.coalesce("_exact", "_inner", "proj_name"))
        .select(*panel.columns, "base")
    )


def _jitter_once(panel: DataFrame, entry: float, delta: float, seed: int, tag: str) -> DataFrame:
    w = _series()
    picked = Window.partitionBy("proj_name").orderBy(draw_key(seed, "proj_name", "month", F.lit(tag)), "month")
    cols = feature_columns(panel)
    shift = lambda c: 1 + (2 * uniform(seed, "proj_name", "month", F.lit(tag + "/" + c)) - 1) * delta
    chosen = F.row_number().over(picked) <= F.floor(F.count(F.lit(1)).over(w) * entry)
    rows = panel.withColumn("_hit", chosen)
    moved = {c: F.when(F.col("_hit"), F.col(c) * shift(c)).otherwise(F.col(c).cast("double")) for c in cols}
    name = F.concat(F.lit("["), "proj_name", F.lit("]-" + tag))
    return rows.select(*[
        moved[c].alias(c) if c in moved else name.alias(c) if c == "proj_name" else F.col(c)
        for c in panel.columns])


def pick_projects(projects: DataFrame, count: int, seed: int, key: str = "proj_name") -> DataFrame:
    """`count` of the projects, by digest order."""
    drawn = projects.select(key).distinct().withColumn("_draw", draw_key(seed, key))
    return row_numbers(drawn, [], ["_draw", key], "_rank").where(F.col("_rank") <= count).select(key)


def jitter(panel: DataFrame, entry: float = 0.4, delta: float = 0.05, cycles: float = 1,
           projects: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """The panel plus copies of its projects with a share of rows shifted a little.

    The fractional part of `cycles` copies that share of the projects once more.
    """
    if not math.isclose(cycles, int(cycles)):
        panel = settle(panel)  # counted, sampled and copied below
    source = panel if projects is None else panel.join(
        projects.select("proj_name").distinct(), "proj_name", "left_semi").select(*panel.columns)
    whole = int(cycles)
    rest = 0.0 if math.isclose(cycles, whole) else cycles - whole
    base = panel.select(*[
        F.col(c).cast("double").alias(c) if c in feature_columns(panel) else F.col(c) for c in panel.columns])
    parts = [base]
    for j in range(whole):
        parts.append(_jitter_once(source, entry, delta, seed, "jit" if whole == 1 else f"jit-{j}"))
    if rest:
        names = source.select("proj_name").distinct()
        # A third of three projects is one project, whatever the last bit of the third says.
        few = pick_projects(names, math.floor(names.count() * rest + 1e-9), seed)
        part = source.join(few, "proj_name", "left_semi").select(*panel.columns)
        parts.append(_jitter_once(part, entry, delta, seed, f"jit-{whole + 1}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# The two labels that are balanced, in tie order.
LABELS = ["retired", "graduated"]


def label_counts(panel: DataFrame, status: DataFrame) -> dict[str, int]:
    """Projects of the panel per label; two numbers."""
    names = panel.select(F.col("proj_name").alias("project")).distinct()
    rows = names.join(status, "project").groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["status"]: r["n"] for r in rows}
    return {label: found.get(label, 0) for label in LABELS}


def upsample(panel: DataFrame, train: DataFrame, status: DataFrame, seed: int = 42) -> DataFrame:
    """Jitter the training projects of the rarer label until both labels are level."""
    panel = settle(panel)
    names = train.select(F.col("project").alias("proj_name"))
    counts = label_counts(panel.join(names, "proj_name", "left_semi"), status)
    few, many = sorted(LABELS, key=lambda l: (counts[l], LABELS.index(l)))
    if counts[few] == counts[many] or counts[few] == 0:
        return panel
    rare = train.join(status.where(F.col("status") == few), "project", "left_semi")
    return jitter(
        panel, cycles=(counts[many] - counts[few]) / counts[few], seed=seed,
        projects=rare.select(F.col("project").alias("proj_name")))


def downsample(panel: DataFrame, status: DataFrame, max_diff: float = 0.1, seed: int = 42) -> DataFrame:
    """All projects of the rarer label and slightly more than as many of the other."""
    panel = settle(panel)
    counts = label_counts(panel, status)
    few, many = sorted(LABELS, key=lambda l: (counts[l], LABELS.index(l)))
    if counts[few] == counts[many]:
        return panel
    present = panel.select(F.col("proj_name").alias("project")).distinct().join(status, "project")
    rare = present.where(F.col("status") == few).select("project")
    common = present.where(F.col("status") == many).select("project")
    kept = rare.unionByName(
        pick_projects(common, math.ceil(counts[few] * (1 + max_diff)), seed, "project"))
    return panel.join(
        kept.select(F.col("project").alias("proj_name")), "proj_name", "left_semi").select(*panel.columns)
