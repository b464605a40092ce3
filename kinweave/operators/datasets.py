"""Labelled train and test sets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.chance import draw_key
from kinweave.operators import transforms
from kinweave.operators.contracts import feature_subset
from kinweave.operators.ordering import row_numbers

# Class of each status; anything else has none.
STATUS_LABEL = {"graduated": 1, "retired": 0}


def base_name(name="proj_name") -> F.Column:
    """The project a series was made from: the text in brackets, else the name itself."""
    inner = F.regexp_extract(name, r"\[(.*?)\]", 1)
    return F.when(inner != "", inner).otherwise(F.col(name))


def label_projects(panel: DataFrame, status: DataFrame, keep_unlabelled: bool = False) -> DataFrame:
    """Adds `label`: 1 graduated, 0 retired; others are dropped or kept as -1."""
    label = F.create_map(*[F.lit(x) for kv in STATUS_LABEL.items() for x in kv])
    known = status.select(F.col("project").alias("_base"), label[F.col("status")].alias("label"))
    rows = panel.withColumn("_base", base_name()).join(known, "_base", "left").drop("_base")
    if keep_unlabelled:
        return rows.withColumn("label", F.coalesce("label", F.lit(-1)))
    return rows.where("label IS NOT NULL")


def stratified_split(status: DataFrame, test_prop: float = 0.3, seed: int = 42,
                     max_diff: float | None = None) -> DataFrame:
    """(project, status, part): each label gives its share of projects to the test part.

    Projects are ranked by digest within their label.  A label may hold most
    projects, so ranks come from ordered slices.  With `max_diff` both parts
    are cut to slightly more than the rarer label's size.
    """
    known = status.where(F.col("status").isin(list(STATUS_LABEL))).select("project", "status").distinct()
    ranked = row_numbers(
        known.withColumn("_draw", draw_key(seed, "project")), ["status"], ["_draw", "project"], "rank")
    counts = known.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per label from here on.
    total = counts.agg(F.sum("n").alias("base")).withColumn("_k", F.lit(1))
    quota = counts.withColumn("_k", F.lit(1)).join(total, "_k").withColumn(
        "test", F.ceil(F.col("n") / F.greatest("base", F.lit(1)) * F.floor(F.col("base") * test_prop)).cast("long"))
    test_cap, train_cap = F.col("test"), F.col("n") - F.col("test")
    if max_diff is not None:
        least = quota.groupBy("_k").agg(F.min("test").alias("_lt"), F.min(F.col("n") - F.col("test")).alias("_ln"))
        quota = quota.join(least, "_k")
        cap = lambda c: F.ceil(F.col(c) * (1 + max_diff)).cast("long")
        test_cap, train_cap = F.least(test_cap, cap("_lt")), F.least(train_cap, cap("_ln"))
    quota = quota.select("status", "test", test_cap.alias("_tc"), train_cap.alias("_nc"))
    part = F.when(F.col("rank") <= F.col("_tc"), "test").when(
        (F.col("rank") > F.col("test")) & (F.col("rank") <= F.col("test") + F.col("_nc")), "train")
    return ranked.join(F.broadcast(quota), "status").withColumn("part", part).where("part IS NOT NULL").select(
        "project", "status", "part")


def fixed_split(projects: DataFrame, train: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """Given one part, the other is everything else; given both, both are kept."""
    if train is None and test is None:
        raise ValueError("give the train or the test projects")
    projects = projects.select("project").distinct()
    pick = lambda part, how: projects.join(part.select("project"), "project", how)
    trained = pick(train, "left_semi") if train is not None else pick(test, "left_anti")
    tested = pick(test, "left_semi") if test is not None else pick(train, "left_anti")
    return trained.withColumn("part", F.lit("train")).unionByName(tested.withColumn("part", F.lit("test")))


def sequences(panel: DataFrame, by_step: bool = False) -> DataFrame:
    """One row per series: its feature vectors in month order (months of one series, so short)."""
    cols = transforms.feature_columns(panel)
    cols = [c for c in cols if c != "label"]
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    keys = ["proj_name"] + (["label"] if "label" in panel.columns else [])
    rows = panel
    if by_step:
        rows = panel.withColumn("step", step_name())
        keys = ["step", *keys]
    return rows.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("month", vector.alias("x")))).alias("_s")
    ).select(*keys, F.transform("_s", lambda s: s.x).alias("steps"))


def step_name(name="proj_name") -> F.Column:
    """Interval step of a series: `all`, `e-months`, `i-steps`, `i-lag-steps`, else its last part."""
    numbered = F.regexp_extract(name, r"\[.*\]-(\d+-(?:months|steps|lag-steps))", 1)
    made = F.col(name).startswith("[")
    return F.when(~made, "all").when(numbered != "", numbered).otherwise(F.element_at(F.split(name, "-"), -1))


@dataclass(frozen=True)
class Source:
    """One data set of a strategy: its part, its panel and what is done to it."""

    role: str
    dataset: str
    holdout: bool = False
    options: tuple[str, ...] = field(default_factory=tuple)


# Transforms by option name, in the order they are applied.
OPTION_ORDER = [
    "feature-subset", "normalize-actdev", "normalize-minmax", "normalize-zscore", "jitter",
    "upsample", "downsample", "diff", "aggregate", "interval", "proportion-interval", "lag-interval",
]
OPTIONS = {
    "feature-subset": lambda p: feature_subset(p),
    "normalize-actdev": lambda p: transforms.drop_incomplete(transforms.normalise(p, "actdev")),
    "normalize-minmax": lambda p: transforms.drop_incomplete(transforms.normalise(p, "minmax")),
    "normalize-zscore": lambda p: transforms.drop_incomplete(transforms.normalise(p, "zscore")),
    "jitter": lambda p: transforms.jitter(p),
    "diff": lambda p: transforms.diff(p),
    "aggregate": lambda p: transforms.cumulate(p),
    "interval": lambda p: transforms.intervals(p),
    "proportion-interval": lambda p: transforms.proportion_intervals(p),
    "lag-interval": lambda p: transforms.proportion_intervals(p, backwards=True),
}


def augment(panel: DataFrame, options, balance: dict | None = None) -> DataFrame:
    """Apply the chosen transforms in their fixed order.

    `balance` gives the two that need labels; without it they change nothing.
    """
    unknown = set(options) - set(OPTION_ORDER) - {"clean"}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    table = {**OPTIONS, **(balance or {})}
    for name in OPTION_ORDER:
        if name in options and name in table:
            panel = table[name](panel)
    return panel


def dataset_mix(sources: list[Source], panels: dict[str, DataFrame], statuses: dict[str, DataFrame],
                test_prop: float = 0.2, seed: int = 42) -> DataFrame:
    """Labelled rows of the train and test parts, over several data sets.

    A held-out source gives the test share of its projects; a train source
    without holdout trains on all, a test source without holdout tests on all.
    Only training projects are upsampled; a split is balanced by its own caps.
    """
    rows = None
    for s in sources:
        status, split = statuses[s.dataset], None
        if s.holdout:
            split = stratified_split(
                status, test_prop, seed, 0.1 if "downsample" in s.options else None
            ).where(F.col("part") == s.role)
        balance = {}
        if s.role == "train":
            train = status if split is None else split
            balance["upsample"] = lambda p, train=train, status=status: transforms.upsample(
                p, train.select("project"), status, seed)
        if split is None:
            balance["downsample"] = lambda p, status=status: transforms.downsample(p, status, seed=seed)
        panel = augment(panels[s.dataset], s.options, balance)
        panel = panel.drop(*[c for c in transforms.EXTRA if c in panel.columns])
        labelled = label_projects(panel, status)
        if split is not None:
            labelled = (
                labelled.withColumn("project", base_name())
                .join(split.select("project"), "project", "left_semi").drop("project"))
        part = labelled.withColumns({"role": F.lit(s.role), "dataset": F.lit(s.dataset)})
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows
