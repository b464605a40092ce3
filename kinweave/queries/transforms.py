"""Queries over panel transforms and panel statistics."""

from pyspark.sql import functions as F

from kinweave.operators import cleaning, contracts, edges, features, panel, statistics, transforms
from kinweave.queries.contracts import SOCIAL_MONTHS, TECH_MONTHS
from kinweave.queries.edges import T_EDGE
from kinweave.queries.panel import rounded, tech_feature_sql
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import SOCIAL, TECH, with_ctes
from kinweave.schemas import Logs
from kinweave.sources import views

COLS = ["t_num_dev_nodes", "t_num_file_nodes", "t_num_file_per_dev", "t_graph_density", "s_num_nodes", "st_num_dev"]


def small_panel(spark, sf):
    """Technical features, senders and shared people per month: a panel without rounds."""
    logs = Logs(views.tech_log(spark, sf), views.social_log(spark, sf))
    month = cleaning.month_index("ts")
    tech = cleaning.clean_source_files(logs.tech).withColumns(
        {"month": month, "is_bot": F.lit(0), "dev": F.col("sender")})
    social = logs.social.withColumns({"month": month, "is_bot": F.lit(0), "dev": F.col("sender")})
    t_edges, loops = edges.tech_edges(tech), edges.presence_loops(social)
    rows = (
        features.tech_features(t_edges)
        .unionByName(features.social_features(loops), allowMissingColumns=True)
        .unionByName(features.shared_devs(t_edges, loops), allowMissingColumns=True))
    last = tech.groupBy("project").agg(F.min("month").alias("_start"), F.max("month").alias("_last")).unionByName(
        social.groupBy("project").agg(F.lit(None).cast("int").alias("_start"), F.max("month").alias("_last")))
    span = last.groupBy("project").agg(F.min("_start").alias("_start"), F.max("_last").alias("_last"))
    rows = rows.join(span.select("project", "_start"), "project").withColumn(
        "month", (F.col("month") - F.col("_start")).cast("int")).where("month >= 0")
    lengths = span.select("project", (F.col("_last") - F.col("_start") + 1).alias("months"))
    return panel.densify(rows, lengths, COLS).select(F.col("project").alias("proj_name"), "month", *COLS)


SMALL_SQL = (TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS, T_EDGE, tech_feature_sql("t_edge", "ft"), """
sn AS (SELECT project, month, CAST(count(DISTINCT sender) AS BIGINT) AS s_num_nodes FROM social_m GROUP BY ALL),
sd AS (SELECT t.project, t.month, count(DISTINCT t.dev) AS st_num_dev FROM t_edge t JOIN social_m s
       ON s.project = t.project AND s.month = t.month AND s.sender = t.dev GROUP BY ALL),
slen AS (SELECT project, max(month) + 1 AS months FROM (SELECT project, month FROM tech_m UNION ALL SELECT project, month FROM social_m) GROUP BY project),
scal AS (SELECT project, CAST(unnest(range(0, months)) AS INTEGER) AS month FROM slen),
p AS (SELECT project AS proj_name, month, coalesce(t_num_dev_nodes, 0) AS t_num_dev_nodes, coalesce(t_num_file_nodes, 0) AS t_num_file_nodes,
        CAST(coalesce(t_num_file_per_dev, 0) AS DOUBLE) AS t_num_file_per_dev, CAST(coalesce(t_graph_density, 0) AS DOUBLE) AS t_graph_density,
        coalesce(s_num_nodes, 0) AS s_num_nodes, CAST(coalesce(st_num_dev, 0) AS BIGINT) AS st_num_dev
      FROM scal LEFT JOIN ft USING (project, month) LEFT JOIN sn USING (project, month) LEFT JOIN sd USING (project, month))""")


def each(template: str) -> str:
    return ", ".join(template.format(c=c) for c in COLS)


ROUND = each("round(CAST({c} AS DOUBLE), 6) AS {c}")


def as_doubles(df):
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c not in ("proj_name", "month", "base_project", "step") else F.col(c) for c in df.columns])


@query("norm_zscore", with_ctes(*SMALL_SQL) + "SELECT proj_name, month, " + each(
    "round(({c} - avg({c}) OVER w) / (stddev_samp({c}) OVER w + 1e-10), 6) AS {c}") + " FROM p WINDOW w AS (PARTITION BY proj_name)")
def norm_zscore(spark, sf):
    return rounded(transforms.normalise(small_panel(spark, sf), "zscore"))


@query("norm_minmax", with_ctes(*SMALL_SQL) + "SELECT proj_name, month, " + each(
    "round(({c} - min({c}) OVER w) / (max({c}) OVER w + 1e-10), 6) AS {c}") + " FROM p WINDOW w AS (PARTITION BY proj_name)")
def norm_minmax(spark, sf):
    return rounded(transforms.normalise(small_panel(spark, sf), "minmax"))


@query("norm_actdev", with_ctes(*SMALL_SQL) + "SELECT proj_name, month, " + each(
    "round(CAST({c} AS DOUBLE) / CASE WHEN st_num_dev = 0 THEN 1 ELSE st_num_dev END, 6) AS {c}") + " FROM p")
def norm_actdev(spark, sf):
    return rounded(transforms.normalise(small_panel(spark, sf), "actdev"))


def holed(spark, sf):
    return small_panel(spark, sf).withColumn(
        "t_graph_density", F.when(F.col("month") % 5 != 0, F.col("t_graph_density"))).withColumn(
        "s_num_nodes", F.when(F.col("month") % 7 != 3, F.col("s_num_nodes")))


@query("norm_dropna", with_ctes(*SMALL_SQL) + f"SELECT proj_name, month, {ROUND} FROM p WHERE month % 5 <> 0 AND month % 7 <> 3")
def norm_dropna(spark, sf):
    return as_doubles(transforms.drop_incomplete(holed(spark, sf)))


@query("norm_dropna_report", with_ctes(*SMALL_SQL) + """
SELECT 't_graph_density' AS feature, CAST(count(*) FILTER (month % 5 = 0) AS BIGINT) AS missing FROM p
UNION ALL SELECT 's_num_nodes', CAST(count(*) FILTER (month % 7 = 3) AS BIGINT) FROM p
UNION ALL SELECT unnest(['t_num_dev_nodes', 't_num_file_nodes', 't_num_file_per_dev', 'st_num_dev']), 0""")
def norm_dropna_report(spark, sf):
    return transforms.incomplete_report(holed(spark, sf))


CUM = "round(CAST(sum({c}) OVER (PARTITION BY proj_name ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE), 6) AS {c}"


@query("cumulate", with_ctes(*SMALL_SQL) + f"SELECT proj_name, month, {each(CUM)} FROM p")
def cumulate(spark, sf):
    return as_doubles(transforms.cumulate(small_panel(spark, sf)))


@query("cumulate_concat", with_ctes(*SMALL_SQL) + f"SELECT proj_name, month, {ROUND}, {each(CUM + '_agg')} FROM p")
def cumulate_concat(spark, sf):
    return as_doubles(transforms.cumulate(small_panel(spark, sf), concat=True))


DIFF = "round({c} - coalesce(avg({c}) OVER (PARTITION BY proj_name ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 6) AS {c}_diff"


@query("diff_lagmean", with_ctes(*SMALL_SQL) + f"""
SELECT * EXCLUDE (rn) FROM (SELECT proj_name, month, {each(DIFF)}, row_number() OVER (PARTITION BY proj_name ORDER BY month) AS rn FROM p) WHERE rn > 3""")
def diff_lagmean(spark, sf):
    return as_doubles(transforms.diff(small_panel(spark, sf)))


SPACED = """ivl AS (
  SELECT '[' || p.proj_name || ']-' || e || '-months' AS proj_name, p.month, p.proj_name AS base_project, e || '-months' AS step, p.* EXCLUDE (proj_name, month)
  FROM p JOIN (SELECT proj_name, max(month) AS m FROM p GROUP BY proj_name) x USING (proj_name), generate_series(0, 2000, 1) g(e)
  WHERE e < m AND p.month < e AND m > 1)"""


@query("interval_spaced", with_ctes(*SMALL_SQL, SPACED) + f"""
SELECT proj_name, month, base_project, step, {ROUND} FROM ivl
UNION ALL SELECT proj_name, month, proj_name, 'all', {ROUND} FROM p""")
def interval_spaced(spark, sf):
    return as_doubles(transforms.intervals(small_panel(spark, sf)))


@query("interval_spaced_window", with_ctes(*SMALL_SQL) + f"""
SELECT '[' || proj_name || ']-' || e || '-months' AS proj_name, month, proj_name AS base_project, e || '-months' AS step, {ROUND}
FROM (SELECT p.*, least(41, max(month) OVER (PARTITION BY proj_name)) AS stop FROM p) q, (SELECT unnest(range(6, 41, 4)) AS e) g
WHERE e < stop AND (stop - 6) / 4.0 > 1 AND month < e
UNION ALL SELECT proj_name, month, proj_name, 'all', {ROUND} FROM p""")
def interval_spaced_window(spark, sf):
    return as_doubles(transforms.intervals(small_panel(spark, sf), start=6, spacing=4, end=40))


CUTS = """len AS (SELECT proj_name, max(month) + 1 AS l, least(max(month) + 1, 8) AS n FROM p GROUP BY proj_name),
cut AS (SELECT proj_name, i, l, CASE WHEN i < 8 - n THEN 0 WHEN i = 7 THEN l ELSE CAST(ceil((i - (8 - n) + 1) * (l * 1.0 / n)) AS INTEGER) END AS hi
        FROM len, (SELECT unnest(range(0, 8)) AS i) g WHERE n > 1)"""


@query("interval_proportion", with_ctes(*SMALL_SQL, CUTS) + f"""
SELECT '[' || p.proj_name || ']-' || i || '-steps' AS proj_name, month, p.proj_name AS base_project, i || '-steps' AS step, {ROUND}
FROM p JOIN cut USING (proj_name) WHERE i < 7 AND month <= hi
UNION ALL SELECT proj_name, month, proj_name, 'all', {ROUND} FROM p""")
def interval_proportion(spark, sf):
    return as_doubles(transforms.proportion_intervals(small_panel(spark, sf)))


@query("interval_lag", with_ctes(*SMALL_SQL, CUTS) + f"""
, cuts AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY proj_name ORDER BY i), 0) AS lo FROM cut)
SELECT '[' || p.proj_name || ']-' || i || '-lag-steps' AS proj_name, month, p.proj_name AS base_project, i || '-lag-steps' AS step, {ROUND}
FROM p JOIN cuts USING (proj_name) WHERE month BETWEEN lo AND hi
UNION ALL SELECT proj_name, month, proj_name, 'all', {ROUND} FROM p""")
def interval_lag(spark, sf):
    return as_doubles(transforms.proportion_intervals(small_panel(spark, sf), backwards=True))


def panel_lengths(rows):
    return rows.groupBy(F.col("proj_name").alias("project")).agg((F.max("month") + 1).alias("months"))


@query("interval_check", with_ctes(*SMALL_SQL, SPACED) + """
, sz AS (SELECT base_project, step, count(*) AS n FROM ivl WHERE NOT (base_project = 'proj3' AND month = 2) GROUP BY ALL),
fnd AS (SELECT base_project, count(*) + 1 AS found, sum(CASE WHEN n <> CAST(split_part(step, '-', 1) AS BIGINT) THEN 1 ELSE 0 END) AS wrong FROM sz GROUP BY base_project),
bs AS (SELECT proj_name AS base_project, CAST(max(month) + 1 - 1 AS BIGINT) AS expected FROM p GROUP BY proj_name)
SELECT base_project, expected, CAST(coalesce(found, 0) AS BIGINT) AS found, CAST(coalesce(wrong, 0) AS BIGINT) AS wrong,
       CASE WHEN expected = found AND wrong = 0 THEN 1 ELSE 0 END AS passed FROM bs FULL JOIN fnd USING (base_project)""")
def interval_check(spark, sf):
    rows = small_panel(spark, sf)
    cut = transforms.intervals(rows).where("NOT (base_project = 'proj3' AND month = 2)")
    return transforms.check_intervals(cut, panel_lengths(rows))


@query("match_base", with_ctes(*SMALL_SQL, SPACED) + """
SELECT proj_name, CASE WHEN base_project IN ('proj0', 'proj1', 'proj2', 'proj4') THEN base_project ELSE proj_name END AS base, CAST(count(*) AS BIGINT) AS n
FROM (SELECT proj_name, base_project FROM ivl UNION ALL SELECT proj_name, proj_name FROM p) GROUP BY ALL""")
def match_base(spark, sf):
    rows = transforms.intervals(small_panel(spark, sf)).select("proj_name", "month")
    bases = views.status(spark, sf).where("project IN ('proj0', 'proj1', 'proj2', 'proj4')")
    return transforms.match_base(rows, bases).groupBy("proj_name", "base").agg(F.count(F.lit(1)).alias("n"))


def jitter_sql(tag: str, source: str) -> str:
    cells = ", ".join(
        f"round(CASE WHEN rn <= floor(n * 0.4) THEN {c} * (1 + (2 * (CAST('0x' || substr(md5('42|' || proj_name || '|' || month || '|{tag}/{c}'), 1, 8) AS BIGINT) / 4294967296.0) - 1) * 0.05) ELSE CAST({c} AS DOUBLE) END, 6) AS {c}"
        for c in COLS)
    return f"""SELECT '[' || proj_name || ']-{tag}' AS proj_name, month, {cells}
FROM (SELECT *, count(*) OVER (PARTITION BY proj_name) AS n,
        row_number() OVER (PARTITION BY proj_name ORDER BY md5('42|' || proj_name || '|' || month || '|{tag}'), month) AS rn FROM {source})"""


@query("jitter", with_ctes(*SMALL_SQL) + jitter_sql("jit", "p") + f" UNION ALL SELECT proj_name, month, {ROUND} FROM p")
def jitter(spark, sf):
    return as_doubles(transforms.jitter(small_panel(spark, sf)))


@query("jitter_cycles", with_ctes(*SMALL_SQL) + """
, few AS (SELECT proj_name FROM (SELECT DISTINCT proj_name FROM p) ORDER BY md5('42|' || proj_name), proj_name
          LIMIT (SELECT CAST(floor(count(DISTINCT proj_name) * 0.5) AS BIGINT) FROM p)),
part AS (SELECT * FROM p WHERE proj_name IN (SELECT proj_name FROM few))
""" + " UNION ALL ".join([jitter_sql("jit-0", "p"), jitter_sql("jit-1", "p"), jitter_sql("jit-3", "part")]) +
       f" UNION ALL SELECT proj_name, month, {ROUND} FROM p")
def jitter_cycles(spark, sf):
    return as_doubles(transforms.jitter(small_panel(spark, sf), cycles=2.5))


def skewed_status(spark, sf):
    return views.status(spark, sf).withColumn(
        "status", F.when(F.col("project").isin("proj1", "proj3", "proj5"), "retired").otherwise("graduated"))


@query("downsample", with_ctes(*SMALL_SQL) + f"""
, few AS (SELECT proj_name FROM (SELECT DISTINCT proj_name FROM p WHERE proj_name NOT IN ('proj1', 'proj3', 'proj5')) ORDER BY md5('42|' || proj_name), proj_name LIMIT 4)
SELECT proj_name, month, {ROUND} FROM p WHERE proj_name IN ('proj1', 'proj3', 'proj5') OR proj_name IN (SELECT proj_name FROM few)""")
def downsample(spark, sf):
    return as_doubles(transforms.downsample(small_panel(spark, sf), skewed_status(spark, sf)))


@query("upsample", with_ctes(*SMALL_SQL) + f"""
, few AS (SELECT proj_name FROM (SELECT DISTINCT proj_name FROM p WHERE proj_name IN ('proj1', 'proj3', 'proj5')) ORDER BY md5('42|' || proj_name), proj_name LIMIT 1),
src AS (SELECT * FROM p WHERE proj_name IN ('proj1', 'proj3', 'proj5')),
part AS (SELECT * FROM p WHERE proj_name IN (SELECT proj_name FROM few))
""" + jitter_sql("jit", "src") + " UNION ALL " + jitter_sql("jit-2", "part") + f" UNION ALL SELECT proj_name, month, {ROUND} FROM p")
def upsample(spark, sf):
    rows, status = small_panel(spark, sf), skewed_status(spark, sf)
    return as_doubles(transforms.upsample(rows, status.select("project"), status))


STAT = "SELECT '{c}' AS feature, {body} FROM {src}"


def describe_sql(src: str, value: str = "{c}") -> str:
    body = ("CAST(count({v}) AS BIGINT) AS count, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, "
            "round(CAST(min({v}) AS DOUBLE), 6) AS min, round(CAST(max({v}) AS DOUBLE), 6) AS max, "
            "round(quantile_cont(CAST({v} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({v} AS DOUBLE), 0.5), 6) AS q50, "
            "round(quantile_cont(CAST({v} AS DOUBLE), 0.75), 6) AS q75")
    return " UNION ALL ".join(
        STAT.format(c=c, body=body.format(v=value.format(c=c)), src=src.format(c=c)) for c in COLS)


@query("describe_projectwise", with_ctes(*SMALL_SQL) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(f"round(avg({s}), 6) AS {s}" for s in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")) +
    f""" FROM (SELECT proj_name, CAST(count({c}) AS DOUBLE) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
      quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75,
      CAST(max({c}) AS DOUBLE) AS max FROM p GROUP BY proj_name)""" for c in COLS))
def describe_projectwise(spark, sf):
    return rounded(statistics.describe_by_project(small_panel(spark, sf)))


@query("describe_overall", with_ctes(*SMALL_SQL) + describe_sql("p"))
def describe_overall(spark, sf):
    return rounded(statistics.describe(small_panel(spark, sf)))


@query("describe_overall_outliers", with_ctes(*SMALL_SQL) + describe_sql(
    "(SELECT CASE WHEN {c} <= (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.95) FROM p) THEN {c} END AS v FROM p)", "v"))
def describe_overall_outliers(spark, sf):
    return rounded(statistics.describe(small_panel(spark, sf), outlier=0.05))


CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM p"
    for i, a in enumerate(COLS) for b in COLS[:i])


@query("correlations", with_ctes(*SMALL_SQL) + CORR)
def correlations(spark, sf):
    return rounded(statistics.correlations(small_panel(spark, sf)))


@query("correlations_strong", with_ctes(*SMALL_SQL) + f"SELECT * FROM ({CORR}) WHERE abs(corr) > 0.5")
def correlations_strong(spark, sf):
    return rounded(statistics.correlations(small_panel(spark, sf), 0.5))


@query("length_distribution", """
WITH l AS (SELECT o_orderstatus AS incubator, o_custkey, CAST(datediff('month', min(o_orderdate), max(o_orderdate)) + 1 AS INTEGER) AS months
           FROM orders GROUP BY ALL)
SELECT incubator, CAST(months // 6 * 6 AS INTEGER) AS months, CAST(count(*) AS BIGINT) AS projects, max(max(months)) OVER (PARTITION BY incubator) AS longest
FROM l GROUP BY incubator, months // 6 * 6""")
def length_distribution(spark, sf):
    month = cleaning.month_index("o_orderdate")
    lengths = views.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("incubator"), "o_custkey").agg(
        (F.max(month) - F.min(month) + 1).cast("int").alias("months"))
    return statistics.length_distribution(lengths, 6)


@query("activity_series", with_ctes(*SMALL_SQL, SPACED) + """
SELECT proj_name, month, s_num_nodes + t_num_dev_nodes AS activity FROM ivl WHERE base_project = 'proj4' AND month <= 30
UNION ALL SELECT proj_name, month, s_num_nodes + t_num_dev_nodes FROM p WHERE proj_name = 'proj4' AND month <= 30""")
def activity_series(spark, sf):
    return statistics.activity(transforms.intervals(small_panel(spark, sf)), "proj4", 30)


@query("feature_subset", with_ctes(*SMALL_SQL) + f"SELECT {ROUND.replace('round(CAST(st_num_dev AS DOUBLE), 6) AS st_num_dev', 'proj_name, month')} FROM p")
def feature_subset(spark, sf):
    return as_doubles(contracts.feature_subset(small_panel(spark, sf), exclude=["st_num_dev"]))


@query("month_slice", with_ctes(*SMALL_SQL) + f"SELECT proj_name, month, {ROUND} FROM p WHERE month BETWEEN 5 AND 20")
def month_slice(spark, sf):
    return as_doubles(contracts.month_slice(small_panel(spark, sf), 5, 20))
