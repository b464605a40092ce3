"""Extrapolating forecast series.

Windows run over the months of one project.  Each path is folded inside its
row by built-in expressions, so every month of every project is projected in
one pass and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.scoring import merge_keyed

# Fixed value: decay rate of the exponential damping.
DECAY = 0.5
# Variances, and shares of a variance, that count as none.
FLAT = 1e-12
# Two-sided normal quantiles by confidence level.
NORMAL = {90: 1.6448536269514722, 95: 1.959963984540054, 99: 2.5758293035489004}


def diminish(step: Column, at: Column, strategy: str = "diff") -> Column:
    """Damp a step as the position nears the bound it moves to."""
    if strategy == "diff":
        bound = F.when(step < 0, F.lit(0.0)).otherwise(F.lit(1.0))
        return step * F.abs(bound - at)
    if strategy == "exp":
        return (step / F.lit(DECAY)) * (1 - F.exp(-F.lit(DECAY) * at))
    return F.lit(0.0)


def clip(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))


def bound(path) -> Column:
    """Every value of a path brought into [0, 1]."""
    return F.transform(path, clip)


def effective_lag(forecast: DataFrame, most: int = 12) -> DataFrame:
    """Per project the lag that is used: `most`, or fewer when there are fewer forecasts."""
    return forecast.groupBy("project").agg(
        F.least(F.lit(most), F.count(F.lit(1)).cast("int")).alias("lag"))


def check_series(forecast: DataFrame, lag: int) -> None:
    """Fail for a lag without a slope, and for a series shorter than the lag."""
    if lag <= 1:
        raise ValueError(f"lag must be greater than 1, got {lag}")
    short = forecast.groupBy("project").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < lag)
    found = short.orderBy("project").limit(1).collect()
    if found:
        raise ValueError(f"series of {found[0]['project']} has {found[0]['n']} values, lag is {lag}")


def _series():
    return Window.partitionBy("project").orderBy("month")


def traj_simple(forecast: DataFrame, lag: int = 3, k: int = 3, strategy: str = "diff") -> DataFrame:
    """From each month on, k further steps along the mean slope of the `lag` months before it."""
    if lag <= 1:
        raise ValueError(f"lag must be greater than 1, got {lag}")
    w = _series()
    slope = (F.lag("p", 1).over(w) - F.lag("p", lag).over(w)) / F.lit(float(lag - 1))
    rows = forecast.select("project", "month", F.col("p").cast("double").alias("p"))
    rows = rows.withColumns({"_g": slope, "_n": F.row_number().over(w)}).where(F.col("_n") > lag)

    def step(acc, _):
        here = clip(acc.at)
        there = here + acc.step
        return F.struct(
            there.alias("at"), diminish(acc.step, there, strategy).alias("step"),
            F.concat(acc.path, F.array(here)).alias("path"))

    start = F.struct(
        F.col("p").alias("at"), F.col("_g").alias("step"), F.array().cast("array<double>").alias("path"))
    path = F.aggregate(F.sequence(F.lit(0), F.lit(k)), start, step, lambda acc: acc.path)
    return rows.select("project", "month", path.alias("neutral"))


def traj_ar(forecast: DataFrame, lag: int = 3, k: int = 3, ci: int = 95) -> DataFrame:
    """k further steps by a first-order regression of the month-to-month changes.

    Slope and intercept come from all changes up to the month (an expanding
    window); the band is the normal one for the summed changes.  The path starts
    at the month's own value with a band of no width.
    """
    if lag <= 1:
        raise ValueError(f"lag must be greater than 1, got {lag}")
    w = _series()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = forecast.select("project", "month", F.col("p").cast("double").alias("p"))
    rows = rows.withColumns({"_d": F.col("p") - F.lag("p").over(w), "_n": F.row_number().over(w)})
    rows = rows.withColumn("_e", F.lag("_d").over(w))
    y, x = F.col("_d"), F.col("_e")
    rows = rows.withColumns({
        "_sxx": F.regr_sxx(y, x).over(so_far), "_syy": F.regr_syy(y, x).over(so_far),
        "_b": F.regr_slope(y, x).over(so_far), "_a": F.regr_intercept(y, x).over(so_far),
        "_m": F.avg(y).over(so_far), "_c": F.regr_count(y, x).over(so_far),
    }).where(F.col("_n") > lag)
    flat = F.coalesce(F.col("_sxx") < 1e-12, F.lit(True))
    rows = rows.withColumns({
        "_b": F.when(flat, F.lit(0.0)).otherwise(F.col("_b")),
        "_a": F.when(flat, F.coalesce("_m", F.lit(0.0))).otherwise(F.col("_a")),
    })
    rest = F.coalesce(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.lit(0.0))
    rows = rows.withColumn(
        "_v", F.greatest(rest, F.lit(0.0)) / F.greatest(F.col("_c") - 2, F.lit(1)).cast("double"))

    def step(acc, _):
        change = F.col("_a") + F.col("_b") * acc.change
        at = acc.at + change
        weight = 1 + F.col("_b") * acc.weight
        spread = acc.spread + weight * weight
        width = F.lit(NORMAL[ci]) * F.sqrt(F.col("_v") * spread)
        return F.struct(
            at.alias("at"), change.alias("change"), weight.alias("weight"), spread.alias("spread"),
            F.concat(acc.mid, F.array(clip(at))).alias("mid"),
            F.concat(acc.low, F.array(at - width)).alias("low"),
            F.concat(acc.high, F.array(at + width)).alias("high"))

    zero, first = F.lit(0.0), F.array(F.col("p"))
    start = F.struct(
        F.col("p").alias("at"), F.coalesce("_d", zero).alias("change"), zero.alias("weight"), zero.alias("spread"),
        first.alias("mid"), first.alias("low"), first.alias("high"))
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(k)), start, step,
        lambda acc: F.struct(acc.mid.alias("neutral"), acc.low.alias("negative"), acc.high.alias("positive")))
    return rows.select("project", "month", path.alias("_t")).select("project", "month", "_t.*")


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, term: total + term)


def _regression(c: Column, order: int) -> Column:
    """Levinson-Durbin: the weights of the last `order` changes and the variance left, from autocovariances 0 to `order`."""
    def longer(acc, h):
        known = F.reverse(F.slice(c, F.lit(2), h - 1))  # autocovariances h - 1 down to 1
        weight = F.when(acc.rest <= c[0] * FLAT, F.lit(0.0)).otherwise((c[h] - _dot(acc.phi, known)) / acc.rest)
        step = F.struct(acc.phi.alias("phi"), acc.rest.alias("rest"), weight.alias("weight"))
        return F.transform(F.array(step), lambda s: F.struct(  # names the weight, so that it is taken once
            F.concat(F.zip_with(s.phi, F.reverse(s.phi), lambda a, b: a - s.weight * b), F.array(s.weight)).alias("phi"),
            (s.rest * (1 - s.weight * s.weight)).alias("rest")))[0]

    start = F.struct(F.array().cast("array<double>").alias("phi"), c[0].alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, longer)


def traj_ar_lags(forecast: DataFrame, lag: int = 3, k: int = 3, ci: int = 95) -> DataFrame:
    """k further steps by a regression of the month-to-month changes on the `lag` changes before them.

    The weights solve the Yule-Walker equations of all changes up to the month:
    autocovariances come from running sums of lag products, so each month costs
    the same, and the recursion runs inside the row.  The band adds up the squared
    weights that past shocks have in the summed changes.  Changes that are all
    equal go on as they are with a band of no width; months with no more than
    `lag` values up to them have no path.
    """
    if lag <= 1:
        raise ValueError(f"lag must be greater than 1, got {lag}")
    w = _series()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = forecast.select("project", "month", F.col("p").cast("double").alias("p"))
    rows = rows.withColumns({"_d": F.col("p") - F.lag("p").over(w), "_n": F.row_number().over(w)})
    rows = rows.withColumns({f"_d{h}": F.lag("_d", h).over(w) for h in range(1, lag + 1)})
    d = [F.col("_d"), *[F.col(f"_d{h}") for h in range(1, lag + 1)]]
    rows = rows.withColumns({
        "_m": F.avg("_d").over(so_far),
        **{f"_s{h}": F.sum(d[0] * d[h]).over(so_far) for h in range(lag + 1)},
        **{f"_t{h}": F.sum(d[0] + d[h]).over(so_far) for h in range(lag + 1)},
    }).where(F.col("_n") > lag)
    m, mean, zero = F.col("_n") - 1, F.col("_m"), F.lit(0.0)
    # A lag with no product yet has no covariance.
    about = [F.coalesce((F.col(f"_s{h}") - mean * F.col(f"_t{h}") + (m - h) * mean * mean) / m, zero) for h in range(lag + 1)]
    rows = rows.withColumn("_c", F.transform(F.array(*about), lambda c: F.when(F.abs(c) < FLAT, zero).otherwise(c)))
    rows = rows.withColumn("_f", _regression(F.col("_c"), lag))
    phi, rest = F.col("_f.phi"), F.greatest(F.col("_f.rest"), zero)

    def step(acc, _):
        change = _dot(phi, acc.past)
        shock = _dot(F.slice(phi, 1, F.least(F.size(acc.shocks), F.lit(lag))), F.slice(acc.shocks, 1, F.least(F.size(acc.shocks), F.lit(lag))))
        shock = F.when(F.size(acc.shocks) == 0, F.lit(1.0)).otherwise(shock)
        at = acc.at + mean + change
        weight = acc.weight + shock
        spread = acc.spread + weight * weight
        width = F.lit(NORMAL[ci]) * F.sqrt(rest * spread)
        return F.struct(
            at.alias("at"), F.concat(F.array(change), F.slice(acc.past, 1, lag - 1)).alias("past"),
            F.concat(F.array(shock), acc.shocks).alias("shocks"), weight.alias("weight"), spread.alias("spread"),
            F.concat(acc.mid, F.array(clip(at))).alias("mid"),
            F.concat(acc.low, F.array(at - width)).alias("low"),
            F.concat(acc.high, F.array(at + width)).alias("high"))

    first = F.array(F.col("p"))
    start = F.struct(
        F.col("p").alias("at"), F.array(*[F.coalesce(x - mean, zero) for x in d[:lag]]).alias("past"),
        F.array().cast("array<double>").alias("shocks"), zero.alias("weight"), zero.alias("spread"),
        first.alias("mid"), first.alias("low"), first.alias("high"))
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(k)), start, step,
        lambda acc: F.struct(acc.mid.alias("neutral"), acc.low.alias("negative"), acc.high.alias("positive")))
    return rows.select("project", "month", path.alias("_t")).select("project", "month", "_t.*")


def trajectories(forecast: DataFrame, strategy: str = "AR", lag: int = 3, k: int = 3, **options) -> DataFrame:
    """(project, month, kind, path): the bounded path and, where the method has one, its band."""
    if strategy == "SIMPLE":
        rows = traj_simple(forecast, lag, k, **options)
        empty = F.lit(None).cast("array<double>")
        rows = rows.withColumns({"negative": empty, "positive": empty})
    elif strategy == "AR":
        rows = traj_ar(forecast, lag, k, **options)
    elif strategy == "AR_LAGS":
        rows = traj_ar_lags(forecast, lag, k, **options)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    kinds = F.explode(F.array(*[
        F.struct(F.lit(kind.upper()).alias("kind"), bound(kind).alias("path"))
        for kind in ("neutral", "negative", "positive")]))
    return rows.select("project", "month", kinds.alias("t")).select("project", "month", "t.kind", "t.path")


def merge_trajectories(new: DataFrame, cached: DataFrame) -> DataFrame:
    """New and stored paths; a stored path is kept."""
    return merge_keyed(cached, new, ["project", "month", "kind"])
