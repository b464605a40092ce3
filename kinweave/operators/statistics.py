"""Panel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.ordering import running_sum
from kinweave.operators.skew import lookup
from kinweave.operators.transforms import feature_columns
from kinweave.session import settle

QUARTILES = [0.25, 0.5, 0.75]
#: Ranks of a sketch; it is off by one of so many at most.
ACCURACY = 10_000


def describe_by_project(panel: DataFrame) -> DataFrame:
    """Count, mean, deviation and quartiles within each project, averaged over projects.

    One aggregation holds all plain statistics, so the rows are not multiplied;
    quartiles come from brackets, so no project's values are held together.
    """
    cols = feature_columns(panel)
    rows = settle(panel.select("proj_name", *cols))
    stats = {
        "count": lambda c: F.count(c).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    each = rows.groupBy("proj_name").agg(*[
        fn(F.col(c).cast("double")).alias(f"{c}|{s}") for c in cols for s, fn in stats.items()])
    means = each.agg(*[F.avg(F.col(f"`{c}|{s}`")).alias(f"{c}|{s}") for c in cols for s in stats])
    plain = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in cols]))
    quart = exact_quantiles(rows, cols, QUARTILES, ["proj_name"]).groupBy("feature").agg(*[
        F.avg(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{round(p * 100)}") for p in QUARTILES])
    return means.select(plain.alias("r")).select("r.*").join(quart, "feature", "left").select(
        "feature", "count", "mean", "std", "min", *[f"q{round(p * 100)}" for p in QUARTILES], "max")


def _brackets(df: DataFrame, cols: list[str], probs: list[float], group: list[str], accuracy: int) -> DataFrame:
    """Per group `_rows` and for each column number `b<i>`: its count and two values around every wanted rank.

    The sketch is off by at most a share 1 / accuracy of the ranks, so values four such
    shares to either side enclose it; up to `accuracy` values are a bracket as they are.
    """
    slack = 4 / accuracy
    at = [*[max(0.0, p - slack) for p in probs], *[min(1.0, p + slack) for p in probs]]
    found = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"), *[x for i, c in enumerate(cols) for x in (
            F.count(c).alias(f"n{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
            F.percentile_approx(c, at, accuracy).alias(f"q{i}"))])

    def bracket(i: int) -> Column:
        small = F.col(f"n{i}") <= accuracy
        low = F.array(*[F.when(small, F.col(f"lo{i}")).otherwise(F.col(f"q{i}")[k]) for k in range(len(probs))])
        high = F.array(*[F.when(small, F.col(f"hi{i}")).otherwise(F.col(f"q{i}")[len(probs) + k]) for k in range(len(probs))])
        return F.struct(F.col(f"n{i}").alias("n"), low.alias("low"), high.alias("high")).alias(f"b{i}")

    return found.select(*group, "_rows", *[bracket(i) for i in range(len(cols))])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], group: list[str] | None = None,
                    accuracy: int = ACCURACY) -> DataFrame:
    """(group, feature, prob, value) with linear interpolation, exact on any number of rows.

    A first pass brackets each rank by a mergeable sketch, a second one counts the
    values below the brackets and, one by one, those inside: beyond `accuracy` rows
    of a group that is a share of some 8 / accuracy of them, and only their distinct
    values are shuffled.  Groups are not null; columns without values have no rows.
    """
    group = group or []
    rows = df.select(*group, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    found = settle(_brackets(rows, [f"c{i}" for i in range(len(cols))], probs, group, accuracy))
    if group:
        met = lookup(rows, found, group, "_rows")
    else:
        one = found.first()  # the only row
        values = lambda xs: F.array(*[F.lit(x).cast("double") for x in xs])
        met = rows.select("*", *[F.struct(F.lit(one[f"b{i}"]["n"]).alias("n"), values(one[f"b{i}"]["low"]).alias("low"), values(
            one[f"b{i}"]["high"]).alias("high")).alias(f"b{i}") for i in range(len(cols))])
    cells = [(i, k) for i in range(len(cols)) for k in range(len(probs))]
    low, high = (lambda i, k, side=side: F.col(f"b{i}.{side}")[k] for side in ("low", "high"))
    sums = met.groupBy(*group).agg(*[
        F.coalesce(F.sum((F.col(f"c{i}") < low(i, k)).cast("long")), F.lit(0)).alias(f"s{i}_{k}") for i, k in cells],
        *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(cols))])
    below = sums.select(*group, F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"s{i}_{k}").alias("below"), F.col(f"n{i}").alias("total")) for i, k in cells])).alias("x")).select(
        *group, "x.*")
    inside = F.filter(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"c{i}").alias("value"),
        ((F.col(f"c{i}") >= low(i, k)) & (F.col(f"c{i}") <= high(i, k))).alias("held")) for i, k in cells]), lambda x: x.held)
    counts = met.select(*group, F.explode(inside).alias("x")).groupBy(
        *group, "x.i", "x.k", "x.value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sum(counts, [*group, "i", "k"], ["value"], "n", "upto").join(below, [*group, "i", "k"])
    at = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("k") + 1) * (F.col("total") - 1)
    placed = placed.withColumn("at", at).withColumn("upto", F.col("upto") + F.col("below"))
    covers = lambda rank: (rank + 1 > F.col("upto") - F.col("n")) & (rank + 1 <= F.col("upto"))
    first, last = covers(F.floor("at")), covers(F.ceil("at"))
    ends = placed.where(first | last).groupBy(*group, "i", "k", "at").agg(
        F.max(F.when(first, F.col("value"))).alias("lo"), F.max(F.when(last, F.col("value"))).alias("hi"))
    return ends.select(
        *group, F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1).alias("feature"),
        F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("k") + 1).alias("prob"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value"))


def describe(panel: DataFrame, outlier: float | None = None) -> DataFrame:
    """The same statistics over all rows; values above the (1 - outlier) quantile left out."""
    cols = feature_columns(panel)
    rows = settle(panel.select(*cols))  # read by the plain statistics and by the quantiles
    if outlier is not None:
        limits = {r["feature"]: r["value"] for r in exact_quantiles(rows, cols, [1 - outlier]).collect()}
        rows = rows.select(*[F.when(F.col(c) <= limits[c], F.col(c)).alias(c) for c in cols if c in limits])
    wide = rows.agg(*[
        F.struct(
            F.lit(c).alias("feature"), F.count(c).alias("count"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max")).alias(c)
        for c in cols])
    plain = wide.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("r")).select("r.*")
    quart = exact_quantiles(rows, cols, QUARTILES).groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{round(p * 100)}") for p in QUARTILES])
    return plain.join(quart, "feature", "left")


def correlations(panel: DataFrame, least: float | None = None) -> DataFrame:
    """Pearson correlation of every pair of features, from one pass; strong pairs with `least`.

    A feature of one value has none, null (`F.corr` divides by its deviation, an error in ANSI mode).
    """
    cols = feature_columns(panel)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]

    def one(a: str, b: str) -> Column:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))

    wide = panel.agg(*[one(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs]))
    out = wide.select(rows.alias("r")).select("r.*")
    out = out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    return out if least is None else out.where(F.abs("corr") > least)


def length_distribution(lengths: DataFrame, bucket: int = 1) -> DataFrame:
    """Projects per incubator and length, with the incubator's longest."""
    sized = lengths.groupBy("incubator", (F.floor(F.col("months") / bucket) * bucket).cast("int").alias("months")).agg(
        F.count(F.lit(1)).alias("projects"), F.max("months").alias("_max"))
    longest = sized.groupBy("incubator").agg(F.max("_max").cast("int").alias("longest"))
    return sized.drop("_max").join(longest, "incubator")


def activity(panel: DataFrame, base: str, stop: int = 50) -> DataFrame:
    """People seen per month in a project and the series made from it."""
    mine = (F.col("proj_name") == base) | (F.regexp_extract("proj_name", r"\[(.*?)\]", 1) == base)
    return panel.where(mine & (F.col("month") <= stop)).select(
        "proj_name", "month", (F.col("s_num_nodes") + F.col("t_num_dev_nodes")).alias("activity"))
