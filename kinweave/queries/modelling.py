"""Queries over labelled sets, scoring and trajectories."""

from pyspark.sql import functions as F

from kinweave.operators import datasets, scoring, trajectories, transforms
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import MEMBERS, STATUS, with_ctes
from kinweave.queries.transforms import COLS, ROUND, SMALL_SQL, each, rounded, small_panel
from kinweave.session import settle
from kinweave.sources import views


def mixed_status(spark, sf):
    return views.status(spark, sf).withColumn(
        "status", F.when(F.col("project").isin("proj6", "proj7"), "incubating").otherwise(F.col("status")))


MIXED = "mixed AS (SELECT project, CASE WHEN project IN ('proj6', 'proj7') THEN 'incubating' ELSE status END AS status FROM status)"
LABEL = "CASE m.status WHEN 'graduated' THEN 1 WHEN 'retired' THEN 0 END"


@query("label_projects", with_ctes(*SMALL_SQL, STATUS, MIXED) + f"""
SELECT proj_name, month, {LABEL} AS label FROM p JOIN mixed m ON m.project = proj_name WHERE m.status <> 'incubating'""")
def label_projects(spark, sf):
    out = datasets.label_projects(small_panel(spark, sf), mixed_status(spark, sf))
    return out.select("proj_name", "month", "label")


CUT = """q AS (
  SELECT '[' || proj_name || ']-' || e || '-months' AS proj_name, month, proj_name AS base, e || '-months' AS step, p.* EXCLUDE (proj_name, month)
  FROM (SELECT p.*, least(41, max(month) OVER (PARTITION BY proj_name)) AS stop FROM p) p, (SELECT unnest(range(6, 41, 4)) AS e) g
  WHERE e < stop AND (stop - 6) / 4.0 > 1 AND month < e
  UNION ALL SELECT proj_name, month, proj_name, 'all', * EXCLUDE (proj_name, month), 0 FROM p)"""


def cut_panel(spark, sf):
    return transforms.intervals(small_panel(spark, sf), start=6, spacing=4, end=40).drop("base_project", "step")


@query("label_projects_keep", with_ctes(*SMALL_SQL, STATUS, MIXED, CUT) + f"""
SELECT proj_name, coalesce({LABEL}, -1) AS label, CAST(count(*) AS BIGINT) AS n FROM q JOIN mixed m ON m.project = base GROUP BY ALL""")
def label_projects_keep(spark, sf):
    out = datasets.label_projects(cut_panel(spark, sf), mixed_status(spark, sf), keep_unlabelled=True)
    return out.groupBy("proj_name", "label").agg(F.count(F.lit(1)).alias("n"))


SPLIT = """known AS (SELECT DISTINCT project, status FROM members WHERE status IN ('graduated', 'retired')),
ranked AS (SELECT project, status, row_number() OVER (PARTITION BY status ORDER BY md5('42|' || project), project) AS rn FROM known),
cnt AS (SELECT status, count(*) AS n FROM known GROUP BY status),
quota AS (SELECT status, n, ceil(CAST(n AS DOUBLE) / sum(n) OVER () * floor(sum(n) OVER () * 0.3)) AS t FROM cnt),
cap AS (SELECT status, n, t, ceil(min(t) OVER () * 1.1) AS tc, ceil(min(n - t) OVER () * 1.1) AS nc FROM quota)"""


@query("stratified_split", with_ctes(MEMBERS, SPLIT) + """
SELECT project, status, CASE WHEN rn <= t THEN 'test' ELSE 'train' END AS part FROM ranked JOIN quota USING (status)""")
def stratified_split(spark, sf):
    return datasets.stratified_split(views.member_projects(spark, sf), 0.3)


@query("balanced_split", with_ctes(MEMBERS, SPLIT) + """
SELECT project, status, CASE WHEN rn <= least(t, tc) THEN 'test' ELSE 'train' END AS part FROM ranked JOIN cap USING (status)
WHERE rn <= least(t, tc) OR (rn > t AND rn <= t + least(n - t, nc))""")
def balanced_split(spark, sf):
    return datasets.stratified_split(views.member_projects(spark, sf), 0.3, max_diff=0.1)


@query("fixed_split", with_ctes(MEMBERS) + """
SELECT project, CASE WHEN status = 'retired' THEN 'test' ELSE 'train' END AS part FROM members""")
def fixed_split(spark, sf):
    members = views.member_projects(spark, sf)
    return datasets.fixed_split(members, test=members.where("status = 'retired'"))


def opened(df, keys):
    """Sequences as rows, one per step."""
    rows = df.select(*keys, F.posexplode("steps").alias("pos", "x"))
    return rows.select(*keys, "pos", *[F.round(F.col("x")[i], 6).alias(c) for i, c in enumerate(COLS)])


POS = "CAST(row_number() OVER (PARTITION BY proj_name ORDER BY month) - 1 AS INTEGER) AS pos"


@query("sequences", with_ctes(*SMALL_SQL) + f"SELECT proj_name, {POS}, {ROUND} FROM p")
def sequences(spark, sf):
    return opened(datasets.sequences(small_panel(spark, sf)), ["proj_name"])


@query("sequences_by_step", with_ctes(*SMALL_SQL, CUT) + f"SELECT step, proj_name, {POS}, {ROUND} FROM q")
def sequences_by_step(spark, sf):
    return opened(datasets.sequences(cut_panel(spark, sf), by_step=True), ["step", "proj_name"])


SOURCES = [
    datasets.Source("train", "apache", True, ("normalize-actdev",)),
    datasets.Source("train", "eclipse", False, ("aggregate",)),
    datasets.Source("test", "apache", True, ("normalize-actdev",)),
    datasets.Source("test", "eclipse", False, ()),
]


def mix(spark, sf):
    rows, status = small_panel(spark, sf), mixed_status(spark, sf)
    other = rows.withColumn("proj_name", F.concat(F.lit("x"), "proj_name"))
    return datasets.dataset_mix(
        SOURCES, {"apache": rows, "eclipse": other},
        {"apache": status, "eclipse": status.withColumn("project", F.concat(F.lit("x"), "project"))})


DIV = each("round(CAST({c} AS DOUBLE) / CASE WHEN st_num_dev = 0 THEN 1 ELSE st_num_dev END, 6) AS {c}")
RUN = each("round(CAST(sum({c}) OVER (PARTITION BY proj_name ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE), 6) AS {c}")


@query("dataset_mix", with_ctes(*SMALL_SQL, STATUS, MIXED, """
known AS (SELECT project, status FROM mixed WHERE status <> 'incubating'),
rk AS (SELECT project, status, row_number() OVER (PARTITION BY status ORDER BY md5('42|' || project), project) AS rn,
         count(*) OVER (PARTITION BY status) AS n, count(*) OVER () AS base FROM known),
part AS (SELECT project, status, CASE WHEN rn <= ceil(CAST(n AS DOUBLE) / base * floor(base * 0.2)) THEN 'test' ELSE 'train' END AS role FROM rk)""") + f"""
SELECT proj_name, month, {DIV}, role, 'apache' AS dataset, {LABEL} AS label FROM p JOIN part m ON m.project = proj_name
UNION ALL
SELECT 'x' || proj_name, month, {RUN}, 'train', 'eclipse', {LABEL} FROM p JOIN known m ON m.project = proj_name
UNION ALL
SELECT 'x' || proj_name, month, {ROUND}, 'test', 'eclipse', {LABEL} FROM p JOIN known m ON m.project = proj_name""")
def dataset_mix(spark, sf):
    out = mix(spark, sf)
    return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in COLS else F.col(c) for c in out.columns])


def window_rows(df):
    steps = df.select("proj_name", "month", F.size("steps").alias("n"), F.explode("steps").alias("s"))
    return steps.groupBy("proj_name", "month", "n").agg(
        F.min("s.month").alias("first"), F.max("s.month").alias("last"),
        *[F.round(F.sum(F.col("s.x")[i]), 6).alias(c) for i, c in enumerate(COLS)])


def window_sql(frame: str) -> str:
    sums = each("round(CAST(sum({c}) OVER w AS DOUBLE), 6) AS {c}")
    return f"""SELECT proj_name, month, CAST(count(*) OVER w AS INTEGER) AS n, min(month) OVER w AS first, max(month) OVER w AS last, {sums}
FROM p WINDOW w AS (PARTITION BY proj_name ORDER BY month ROWS BETWEEN {frame} AND CURRENT ROW)"""


@query("window_lagged", with_ctes(*SMALL_SQL) + window_sql("11 PRECEDING"))
def window_lagged(spark, sf):
    return window_rows(scoring.windows(small_panel(spark, sf), 12))


@query("window_prefix", with_ctes(*SMALL_SQL) + window_sql("UNBOUNDED PRECEDING"))
def window_prefix(spark, sf):
    return window_rows(scoring.windows(small_panel(spark, sf), None))


@query("window_features", with_ctes(*SMALL_SQL) + "SELECT proj_name, month, " + ", ".join(
    f"round(CAST({c} AS DOUBLE), 6) AS {c}_last, round(avg({c}) OVER w, 6) AS {c}_mean, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE regr_slope({c}, month) OVER w END, 5) AS {c}_slope" for c in COLS) +
    " FROM p WINDOW w AS (PARTITION BY proj_name ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def window_features(spark, sf):
    out = scoring.window_features(small_panel(spark, sf), 12)
    places = lambda c: 5 if c.endswith("_slope") else 6
    return out.select("proj_name", "month", *[F.round(c, places(c)).alias(c) for c in out.columns[2:]])


def trained(spark, sf):
    rows = settle(datasets.label_projects(small_panel(spark, sf), mixed_status(spark, sf)))  # for the fit and for what is scored
    return rows, scoring.fit(rows)


@query("train_classifier", with_ctes(*SMALL_SQL, STATUS, MIXED) + f"""
SELECT count(*) AS rows, {3 * len(COLS)} AS inputs, 1 AS better FROM p JOIN mixed m ON m.project = proj_name WHERE m.status <> 'incubating'""")
def train_classifier(spark, sf):
    """Rows and inputs of the training, and whether the model's log-loss is below that of the share of ones."""
    rows, model = trained(spark, sf)
    scored = scoring.score_months(rows.drop("label"), model).join(
        rows.select(F.col("proj_name").alias("project"), "month", "label"), ["project", "month"])
    hit = F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))
    share = F.avg("label")
    constant = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(model.stages[0].getInputCols())).alias("inputs"),
        (-F.avg(F.log(F.greatest(hit, F.lit(1e-12)))) < constant).cast("int").alias("better"))


LINEAR = scoring.LinearModel(
    {f"{c}_last": 0.01 * (i % 5 - 2) for i, c in enumerate(COLS)} | {f"{c}_mean": 0.02 * (i % 3 - 1) for i, c in enumerate(COLS)}, -0.2)
SUM = " + ".join(
    [f"{0.01 * (i % 5 - 2)} * {c}" for i, c in enumerate(COLS)] + [f"{0.02 * (i % 3 - 1)} * avg({c}) OVER w" for i, c in enumerate(COLS)])


def scored_sql(table: str, name: str = "sc") -> str:
    return f"""{name} AS (SELECT proj_name, month, 1 / (1 + exp(-({SUM} - 0.2))) AS pr
  FROM {table} WINDOW w AS (PARTITION BY proj_name ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("score_months", with_ctes(*SMALL_SQL, scored_sql("p")) + "SELECT proj_name AS project, month, round(pr, 6) AS p FROM sc")
def score_months(spark, sf):
    return rounded(scoring.score_months(small_panel(spark, sf), LINEAR))


@query("predict_labels", with_ctes(*SMALL_SQL, STATUS, MIXED, scored_sql("p")) + f"""
SELECT proj_name, month, label, pred, CASE WHEN label <> pred THEN 1 ELSE 0 END AS missed
FROM (SELECT proj_name, max(month) AS month, arg_max(CASE WHEN pr >= 0.5 THEN 1 ELSE 0 END, month) AS pred, any_value({LABEL}) AS label
      FROM sc JOIN mixed m ON m.project = proj_name WHERE m.status <> 'incubating' GROUP BY proj_name)""")
def predict_labels(spark, sf):
    rows = datasets.label_projects(small_panel(spark, sf), mixed_status(spark, sf))
    return scoring.predict_labels(rows, LINEAR, 12)


@query("soft_labels", with_ctes(*SMALL_SQL, STATUS, MIXED, CUT, scored_sql("q")) + f"""
SELECT q.proj_name, q.month, {LABEL} AS label, round(l.soft, 6) AS soft_label
FROM q JOIN mixed m ON m.project = q.base JOIN (SELECT proj_name, arg_max(pr, month) AS soft FROM sc GROUP BY proj_name) l USING (proj_name)
WHERE m.status <> 'incubating'""")
def soft_labels(spark, sf):
    prefixes = datasets.label_projects(cut_panel(spark, sf), mixed_status(spark, sf))
    return rounded(scoring.soft_labels(prefixes, LINEAR, 12).select("proj_name", "month", "label", "soft_label"))


def forecast(spark, sf):
    """A forecast in closed form: a logistic of the people seen in a month."""
    people = F.col("t_num_dev_nodes") + F.col("s_num_nodes") - 28
    return small_panel(spark, sf).select(
        F.col("proj_name").alias("project"), "month", (1 / (1 + F.exp(-people / 6.0))).alias("p"))


FORECAST = "fc AS (SELECT proj_name AS project, month, 1 / (1 + exp(-(t_num_dev_nodes + s_num_nodes - 28) / 6.0)) AS p FROM p)"


@query("confusion_sets", with_ctes(*SMALL_SQL, STATUS, MIXED, FORECAST) + """
SELECT l.project, round(p, 6) AS p, CASE WHEN status = 'graduated' AND p >= 0.5 THEN 'true-positive' WHEN status = 'graduated' THEN 'false-negative'
  WHEN status = 'retired' AND p >= 0.5 THEN 'false-positive' WHEN status = 'retired' THEN 'true-negative' ELSE 'incubating' END AS outcome
FROM (SELECT project, arg_max(p, month) AS p FROM fc GROUP BY project) l LEFT JOIN mixed USING (project)""")
def confusion_sets(spark, sf):
    return rounded(scoring.confusion_sets(forecast(spark, sf), mixed_status(spark, sf)))


@query("confusion_counts", with_ctes(*SMALL_SQL, STATUS, MIXED, FORECAST) + """
SELECT CASE WHEN status = 'graduated' AND p >= 0.5 THEN 'true-positive' WHEN status = 'graduated' THEN 'false-negative'
  WHEN status = 'retired' AND p >= 0.5 THEN 'false-positive' WHEN status = 'retired' THEN 'true-negative' ELSE 'incubating' END AS outcome, CAST(count(*) AS BIGINT) AS projects
FROM (SELECT project, arg_max(p, month) AS p FROM fc GROUP BY project) l LEFT JOIN mixed USING (project) GROUP BY 1""")
def confusion_counts(spark, sf):
    return scoring.confusion_counts(scoring.confusion_sets(forecast(spark, sf), mixed_status(spark, sf)))


@query("hard_labels", with_ctes(*SMALL_SQL, FORECAST) + "SELECT project, month, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM fc")
def hard_labels(spark, sf):
    return rounded(scoring.hard_labels(forecast(spark, sf)))


@query("merge_forecasts", with_ctes(*SMALL_SQL, FORECAST) + """
SELECT coalesce(o.project, n.project) AS project, coalesce(o.month, n.month) AS month, round(coalesce(o.p, n.p), 6) AS p
FROM (SELECT project, month, p FROM fc WHERE month >= 10) n
FULL JOIN (SELECT project, month, p / 2 AS p FROM fc WHERE month < 30) o ON o.project = n.project AND o.month = n.month""")
def merge_forecasts(spark, sf):
    rows = forecast(spark, sf)
    old = rows.where("month < 30").withColumn("p", F.col("p") / 2)
    return rounded(scoring.merge_forecasts(rows.where("month >= 10"), old))


@query("diminish", with_ctes(*SMALL_SQL, FORECAST) + """
SELECT project, month, round(CASE WHEN g < 0 THEN g * abs(p) ELSE g * abs(1 - p) END, 6) AS diff,
       round((g / 0.5) * (1 - exp(-0.5 * p)), 6) AS exponential, 0.0::DOUBLE AS other
FROM (SELECT *, (p - 0.5) / (month + 1) AS g FROM fc)""")
def diminish(spark, sf):
    g = (F.col("p") - 0.5) / (F.col("month") + 1)
    return rounded(forecast(spark, sf).select(
        "project", "month", trajectories.diminish(g, F.col("p"), "diff").alias("diff"),
        trajectories.diminish(g, F.col("p"), "exp").alias("exponential"),
        trajectories.diminish(g, F.col("p"), "none").alias("other")))


def path_rows(df, cols):
    keys = [c for c in df.columns if c not in cols]
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*cols)).alias("pos", "x"))
    return rows.select(*keys, "pos", *[F.round(f"x.{c}", 6).alias(c) for c in cols])


def clip(x: str) -> str:
    return f"greatest(least({x}, 1.0), 0.0)"


def simple_sql(damp: str) -> str:
    parts = ["""s0 AS (SELECT * FROM (SELECT project, month, p AS t, (lag(p, 1) OVER w - lag(p, 3) OVER w) / 2.0 AS g, row_number() OVER w AS n
  FROM fc WINDOW w AS (PARTITION BY project ORDER BY month)) WHERE n > 3)"""]
    for i in range(1, 4):
        parts.append(f"""s{i} AS (SELECT project, month, t, {damp} AS g FROM (SELECT project, month, {clip('t')} + g AS t, g FROM s{i - 1}))""")
    rows = " UNION ALL ".join(f"SELECT project, month, {i} AS pos, round({clip('t')}, 6) AS neutral FROM s{i}" for i in range(4))
    return with_ctes(*SMALL_SQL, FORECAST, *parts) + rows


@query("traj_simple", simple_sql("CASE WHEN g < 0 THEN g * abs(t) ELSE g * abs(1 - t) END"))
def traj_simple(spark, sf):
    return path_rows(trajectories.traj_simple(forecast(spark, sf)), ["neutral"])


@query("traj_simple_exp", simple_sql("(g / 0.5) * (1 - exp(-0.5 * t))"))
def traj_simple_exp(spark, sf):
    return path_rows(trajectories.traj_simple(forecast(spark, sf), strategy="exp"), ["neutral"])


AR = ["""d1 AS (SELECT project, month, p, p - lag(p) OVER w AS d, row_number() OVER w AS n FROM fc WINDOW w AS (PARTITION BY project ORDER BY month)),
d2 AS (SELECT *, lag(d) OVER (PARTITION BY project ORDER BY month) AS e FROM d1),
d3 AS (SELECT project, month, p, d, n, coalesce(regr_sxx(d, e) OVER w, 0) AS sxx, coalesce(regr_syy(d, e) OVER w, 0) AS syy, regr_slope(d, e) OVER w AS b0,
         regr_intercept(d, e) OVER w AS a0, avg(d) OVER w AS m, regr_count(d, e) OVER w AS c
       FROM d2 WINDOW w AS (PARTITION BY project ORDER BY month ROWS UNBOUNDED PRECEDING)),
d4 AS (SELECT *, CASE WHEN sxx < 1e-12 THEN 0.0 ELSE b0 END AS b, CASE WHEN sxx < 1e-12 THEN coalesce(m, 0.0) ELSE a0 END AS a FROM d3 WHERE n > 3),
r0 AS (SELECT project, month, p AS t, coalesce(d, 0.0) AS ch, 0.0::DOUBLE AS w, 0.0::DOUBLE AS sp, a, b,
         greatest(syy - b * b * sxx, 0.0) / greatest(c - 2, 1) AS v FROM d4)"""]
for _i in range(1, 4):
    AR.append(f"""r{_i} AS (SELECT project, month, t + a + b * ch AS t, a + b * ch AS ch, 1 + b * w AS w, sp + (1 + b * w) * (1 + b * w) AS sp, a, b, v FROM r{_i - 1})""")
WIDTH = "1.959963984540054 * sqrt(v * sp)"
AR_ROWS = " UNION ALL ".join(
    f"SELECT project, month, {i} AS pos, {('t' if i == 0 else clip('t'))} AS neutral, t - {WIDTH} AS negative, t + {WIDTH} AS positive FROM r{i}" for i in range(4))


@query("traj_ar", with_ctes(*SMALL_SQL, FORECAST, *AR) +
       f"SELECT project, month, pos, round(neutral, 6) AS neutral, round(negative, 6) AS negative, round(positive, 6) AS positive FROM ({AR_ROWS})")
def traj_ar(spark, sf):
    return path_rows(trajectories.traj_ar(forecast(spark, sf)), ["neutral", "negative", "positive"])


def lags_sql(lag: int, k: int = 3) -> str:
    """Yule-Walker weights of `lag` changes, column by column, and k steps along them."""
    hs = range(lag + 1)
    ctes = [
        "y1 AS (SELECT project, month, p, p - lag(p) OVER w AS d, row_number() OVER w AS n FROM fc WINDOW w AS (PARTITION BY project ORDER BY month))",
        "y2 AS (SELECT *, " + ", ".join(f"lag(d, {h}) OVER w AS d{h}" for h in hs) +
        " FROM y1 WINDOW w AS (PARTITION BY project ORDER BY month))",
        "y3 AS (SELECT *, avg(d) OVER w AS m, " + ", ".join(f"sum(d * d{h}) OVER w AS s{h}, sum(d + d{h}) OVER w AS t{h}" for h in hs) +
        " FROM y2 WINDOW w AS (PARTITION BY project ORDER BY month ROWS UNBOUNDED PRECEDING))",
        "y4 AS (SELECT *, " + ", ".join(f"coalesce((s{h} - m * t{h} + (n - 1 - {h}) * m * m) / (n - 1), 0.0) AS c{h}" for h in hs) +
        f" FROM y3 WHERE n > {lag})",
        "v0 AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN abs(c{h}) < 1e-12 THEN 0.0 ELSE c{h} END AS c{h}" for h in hs) + ") FROM y4)",
        "w0 AS (SELECT *, c0 AS rest0 FROM v0)"]
    for h in range(1, lag + 1):
        known = "".join(f" - f{h - 1}_{j} * c{h - j}" for j in range(1, h))
        ctes.append(f"v{h} AS (SELECT *, CASE WHEN rest{h - 1} <= c0 * 1e-12 THEN 0.0 ELSE (c{h}{known}) / rest{h - 1} END AS f{h}_{h} FROM w{h - 1})")
        ctes.append(f"w{h} AS (SELECT *, " + "".join(f"f{h - 1}_{j} - f{h}_{h} * f{h - 1}_{h - j} AS f{h}_{j}, " for j in range(1, h)) +
                    f"rest{h - 1} * (1 - f{h}_{h} * f{h}_{h}) AS rest{h} FROM v{h})")
    f = [None, *[f"f{lag}_{j}" for j in range(1, lag + 1)]]
    past = [f"coalesce(d{j} - m, 0.0)" for j in range(lag)]
    ctes.append(f"x0 AS (SELECT *, p AS at0, 0.0::DOUBLE AS g0, 0.0::DOUBLE AS sp0, greatest(rest{lag}, 0.0) AS v FROM w{lag})")
    for i in range(1, k + 1):
        change = " + ".join(f"{f[j + 1]} * {past[j]}" for j in range(lag))
        shock = "1.0" if i == 1 else " + ".join(f"{f[j]} * u{i - j}" for j in range(1, min(lag, i - 1) + 1))
        ctes.append(f"z{i} AS (SELECT *, {change} AS e{i}, {shock} AS u{i} FROM x{i - 1})")
        ctes.append(f"x{i} AS (SELECT *, at{i - 1} + m + e{i} AS at{i}, g{i - 1} + u{i} AS g{i}, sp{i - 1} + (g{i - 1} + u{i}) * (g{i - 1} + u{i}) AS sp{i} FROM z{i})")
        past = [f"e{i}", *past[:-1]]
    rows = " UNION ALL ".join(
        f"SELECT project, month, {i} AS pos, {clip(f'at{i}') if i else 'p'} AS neutral, at{i} - 1.959963984540054 * sqrt(v * sp{i}) AS negative, "
        f"at{i} + 1.959963984540054 * sqrt(v * sp{i}) AS positive FROM x{k}" for i in range(k + 1))
    return with_ctes(*SMALL_SQL, FORECAST, *ctes) + (
        f"SELECT project, month, pos, round(neutral, 6) AS neutral, round(negative, 6) AS negative, round(positive, 6) AS positive FROM ({rows})")


@query("traj_ar_lags", lags_sql(3))
def traj_ar_lags(spark, sf):
    return path_rows(trajectories.traj_ar_lags(forecast(spark, sf)), ["neutral", "negative", "positive"])


@query("traj_ar_year", lags_sql(12))
def traj_ar_year(spark, sf):
    return path_rows(trajectories.traj_ar_lags(forecast(spark, sf), lag=12), ["neutral", "negative", "positive"])


@query("traj_bound", with_ctes(*SMALL_SQL, FORECAST, *AR) +
       f"SELECT project, month, pos, round({clip('negative')}, 6) AS negative, round({clip('positive')}, 6) AS positive FROM ({AR_ROWS})")
def traj_bound(spark, sf):
    out = trajectories.traj_ar(forecast(spark, sf))
    return path_rows(out.select(
        "project", "month", trajectories.bound("negative").alias("negative"),
        trajectories.bound("positive").alias("positive")), ["negative", "positive"])


@query("traj_package", with_ctes(*SMALL_SQL, FORECAST, *AR) + f"""
SELECT project, month, 'NEUTRAL' AS kind, pos, round({clip('neutral')}, 6) AS path FROM ({AR_ROWS})
UNION ALL SELECT project, month, 'NEGATIVE', pos, round({clip('negative')}, 6) FROM ({AR_ROWS})
UNION ALL SELECT project, month, 'POSITIVE', pos, round({clip('positive')}, 6) FROM ({AR_ROWS})""")
def traj_package(spark, sf):
    return path_rows(trajectories.trajectories(forecast(spark, sf), "AR"), ["path"])


@query("traj_lag_rule", with_ctes(*SMALL_SQL, FORECAST) + """
SELECT project, CAST(least(12, count(*)) AS INTEGER) AS lag FROM fc GROUP BY project""")
def traj_lag_rule(spark, sf):
    return trajectories.effective_lag(forecast(spark, sf))


@query("merge_trajectories", with_ctes(*SMALL_SQL, FORECAST, *AR) + f"""
, n AS (SELECT project, month, 'NEUTRAL' AS kind, pos, {clip('neutral')} AS path FROM ({AR_ROWS}) WHERE month > 20
  UNION ALL SELECT project, month, 'NEGATIVE', pos, {clip('negative')} FROM ({AR_ROWS}) WHERE month > 20
  UNION ALL SELECT project, month, 'POSITIVE', pos, {clip('positive')} FROM ({AR_ROWS}) WHERE month > 20),
o AS (SELECT project, month, 'NEUTRAL' AS kind, 0 AS pos, p / 3 AS path FROM fc WHERE month < 40)
SELECT project, month, kind, pos, round(path, 6) AS path FROM o
UNION ALL SELECT project, month, kind, pos, round(path, 6) FROM n WHERE NOT (kind = 'NEUTRAL' AND month < 40)""")
def merge_trajectories(spark, sf):
    rows = forecast(spark, sf)
    new = trajectories.trajectories(rows, "AR").where("month > 20")
    old = rows.where("month < 40").select(
        "project", "month", F.lit("NEUTRAL").alias("kind"), F.array(F.col("p") / 3).alias("path"))
    return path_rows(trajectories.merge_trajectories(new, old), ["path"])
