"""Queries over network features and the panel."""

from pyspark.sql import functions as F

from kinweave.operators import cleaning, edges, features, panel
from kinweave.queries.contracts import SOCIAL_MONTHS, TECH_MONTHS, numbered
from kinweave.queries.edges import E_EDGE, E_REPLY, T_EDGE, event_rows, tech_rows
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import EVENTS, SOCIAL, TECH, with_ctes
from kinweave.schemas import COUNT_FEATURES, FEATURES, Logs
from kinweave.session import settle
from kinweave.sources import views


def rounded(df):
    """Doubles at six places, as in the SQL twins."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def event_graph(spark, sf):
    return settle(edges.social_graph(event_rows(spark, sf)))


TECH_SQL = (TECH, TECH_MONTHS, T_EDGE)
EVENT_SQL = (EVENTS, E_REPLY, E_EDGE)


def tech_feature_sql(edge: str, name: str) -> str:
    return f"""{name} AS (
  SELECT project, month, CAST(count(DISTINCT dev) AS BIGINT) AS t_num_dev_nodes, CAST(count(DISTINCT file) AS BIGINT) AS t_num_file_nodes,
         count(*) * 1.0 / count(DISTINCT file) AS t_num_dev_per_file, count(*) * 1.0 / count(DISTINCT dev) AS t_num_file_per_dev,
         count(*) * 1.0 / (count(DISTINCT dev) * count(DISTINCT file)) AS t_graph_density
  FROM {edge} GROUP BY project, month)"""


def social_feature_sql(edge: str, name: str) -> str:
    return f"""{name} AS (
  SELECT project, month, CAST(count(DISTINCT src) AS BIGINT) AS s_num_nodes, 2.0 * sum(weight) / count(DISTINCT src) AS s_weighted_mean_degree,
         CASE WHEN count(DISTINCT src) > 1 THEN count(*) * 1.0 / (count(DISTINCT src) * (count(DISTINCT src) - 1)) ELSE 0.0 END AS s_graph_density
  FROM {edge} GROUP BY project, month)"""


def clustering_sql(edge: str, name: str) -> str:
    return f"""{name}_deg AS (SELECT project, month, src, count(*) AS k FROM {edge} WHERE src <> dst GROUP BY ALL),
{name}_tri AS (
  SELECT a.project, a.month, a.src, count(*) AS t2
  FROM {edge} a JOIN {edge} b ON b.project = a.project AND b.month = a.month AND b.src = a.src
  JOIN {edge} c ON c.project = a.project AND c.month = a.month AND c.src = a.dst AND c.dst = b.dst
  WHERE a.src <> a.dst AND b.src <> b.dst AND c.src <> c.dst AND a.dst <> b.dst GROUP BY ALL),
{name}_n AS (SELECT project, month, count(DISTINCT src) AS n FROM {edge} GROUP BY ALL),
{name} AS (
  SELECT n.project, n.month, coalesce(sum(CASE WHEN k > 1 THEN coalesce(t2, 0) * 1.0 / (k * (k - 1)) ELSE 0.0 END), 0.0) / max(n.n) AS s_avg_clustering_coef
  FROM {name}_n n LEFT JOIN {name}_deg d ON d.project = n.project AND d.month = n.month
  LEFT JOIN {name}_tri t ON t.project = d.project AND t.month = d.month AND t.src = d.src GROUP BY n.project, n.month)"""


def components_sql(edge: str, name: str) -> str:
    return f"""{name}_reach AS (
  SELECT project, month, src AS node, src AS label FROM {edge}
  UNION
  SELECT r.project, r.month, e.dst, r.label FROM {name}_reach r JOIN {edge} e ON e.project = r.project AND e.month = r.month AND e.src = r.node),
{name}_label AS (SELECT project, month, node, min(label) AS component FROM {name}_reach GROUP BY ALL),
{name}_size AS (SELECT project, month, component, count(*) AS n FROM {name}_label GROUP BY ALL),
{name} AS (SELECT project, month, CAST(count(*) AS BIGINT) AS s_num_component, CAST(max(n) AS BIGINT) AS s_largest_component FROM {name}_size GROUP BY ALL)"""


def overlap_sql(edge: str, a: str, b: str, alias: str, name: str) -> str:
    return f"""{name}_n AS (SELECT project, month, count(*) AS n FROM {edge} GROUP BY ALL),
{name}_i AS (SELECT x.project, x.month, count(*) AS i FROM {edge} x JOIN {edge} y
  ON y.project = x.project AND y.month = x.month - 1 AND y.{a} = x.{a} AND y.{b} = x.{b} GROUP BY ALL),
{name} AS (
  SELECT c.project, c.month, CASE WHEN p.n IS NULL THEN 0.0 ELSE coalesce(i, 0) * 1.0 / (c.n + p.n) END AS {alias}
  FROM {name}_n c LEFT JOIN {name}_n p ON p.project = c.project AND p.month = c.month - 1
  LEFT JOIN {name}_i s ON s.project = c.project AND s.month = c.month)"""


def shared_sql(t_edge: str, s_edge: str, name: str) -> str:
    return f"""{name} AS (
  SELECT project, month, CAST(sum(t * s) AS BIGINT) AS st_num_dev FROM (
    SELECT project, month, node, max(t) AS t, max(s) AS s FROM (
      SELECT project, month, dev AS node, 1 AS t, 0 AS s FROM {t_edge} UNION ALL SELECT project, month, src, 0, 1 FROM {s_edge}) GROUP BY ALL) GROUP BY ALL)"""


def six(*cols: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in cols)


@query("f_tech_nodes", with_ctes(*TECH_SQL, tech_feature_sql("t_edge", "f")) +
       "SELECT project, month, t_num_dev_nodes, t_num_file_nodes FROM f")
def f_tech_nodes(spark, sf):
    out = features.tech_features(edges.tech_edges(tech_rows(spark, sf)))
    return out.select("project", "month", "t_num_dev_nodes", "t_num_file_nodes")


@query("f_tech_degrees", with_ctes(*TECH_SQL, tech_feature_sql("t_edge", "f")) +
       f"SELECT project, month, {six('t_num_dev_per_file', 't_num_file_per_dev')} FROM f")
def f_tech_degrees(spark, sf):
    out = features.tech_features(edges.tech_edges(tech_rows(spark, sf)))
    return rounded(out.select("project", "month", "t_num_dev_per_file", "t_num_file_per_dev"))


@query("f_tech_density", with_ctes(*TECH_SQL, tech_feature_sql("t_edge", "f")) +
       f"SELECT project, month, {six('t_graph_density')} FROM f")
def f_tech_density(spark, sf):
    out = features.tech_features(edges.tech_edges(tech_rows(spark, sf)))
    return rounded(out.select("project", "month", "t_graph_density"))


@query("f_social_nodes", with_ctes(*EVENT_SQL, social_feature_sql("e_edge", "f")) +
       "SELECT project, month, s_num_nodes FROM f")
def f_social_nodes(spark, sf):
    return features.social_features(edges.social_graph(event_rows(spark, sf))).select("project", "month", "s_num_nodes")


@query("f_social_degree", with_ctes(*EVENT_SQL, social_feature_sql("e_edge", "f")) +
       f"SELECT project, month, {six('s_weighted_mean_degree')} FROM f")
def f_social_degree(spark, sf):
    out = features.social_features(edges.social_graph(event_rows(spark, sf)))
    return rounded(out.select("project", "month", "s_weighted_mean_degree"))


@query("f_social_density", with_ctes(*EVENT_SQL, social_feature_sql("e_edge", "f")) +
       f"SELECT project, month, {six('s_graph_density')} FROM f")
def f_social_density(spark, sf):
    out = features.social_features(edges.social_graph(event_rows(spark, sf)))
    return rounded(out.select("project", "month", "s_graph_density"))


@query("f_social_clustering", with_ctes(*EVENT_SQL, clustering_sql("e_edge", "f")) +
       f"SELECT project, month, {six('s_avg_clustering_coef')} FROM f")
def f_social_clustering(spark, sf):
    return rounded(features.clustering(event_graph(spark, sf)))


@query("f_components", with_ctes(*EVENT_SQL, components_sql("e_edge", "f"), recursive=True) + "SELECT * FROM f")
def f_components(spark, sf):
    return features.components(event_graph(spark, sf))


@query("f_components_rounds", with_ctes(*EVENT_SQL, components_sql("e_edge", "f"), recursive=True) + "SELECT * FROM f")
def f_components_rounds(spark, sf):
    """The same with every graph treated as a large one."""
    return features.components(event_graph(spark, sf), small=0)


@query("f_overlap", with_ctes(*TECH_SQL, EVENTS, E_REPLY, E_EDGE, overlap_sql("t_edge", "file", "dev", "t_net_overlap", "ft"),
                              overlap_sql("e_edge", "src", "dst", "s_net_overlap", "fs")) + """
SELECT 'tech' AS graph, project, month, round(CAST(t_net_overlap AS DOUBLE), 6) AS net_overlap FROM ft
UNION ALL SELECT 'social', project, month, round(CAST(s_net_overlap AS DOUBLE), 6) FROM fs""")
def f_overlap(spark, sf):
    t = features.overlap(edges.tech_edges(tech_rows(spark, sf)), ["file", "dev"], "net_overlap")
    s = features.overlap(edges.social_graph(event_rows(spark, sf)), ["src", "dst"], "net_overlap")
    both = t.withColumn("graph", F.lit("tech")).unionByName(s.withColumn("graph", F.lit("social")))
    return rounded(both)


def social_rows(spark, sf):
    social = numbered(spark, sf).social.withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))
    return cleaning.infer_replies(settle(social))


S_EDGE = """s_reply AS (
  SELECT *, lag(message_id) OVER (PARTITION BY project, subject ORDER BY ts, message_id) AS in_reply_to FROM social_m),
s_pair AS (
  SELECT r.project, r.month, r.sender AS dev, i.sender AS prev_dev
  FROM s_reply r JOIN s_reply i ON i.project = r.project AND i.month = r.month AND i.message_id = r.in_reply_to
  WHERE i.sender <> r.sender),
s_edge AS (
  SELECT project, month, src, dst, CAST(sum(w) AS BIGINT) AS weight FROM (
    SELECT project, month, dev AS src, prev_dev AS dst, 1 AS w FROM s_pair
    UNION ALL SELECT project, month, prev_dev, dev, 1 FROM s_pair
    UNION ALL SELECT DISTINCT project, month, sender, sender, 0 FROM social_m) GROUP BY ALL)"""


@query("f_shared_devs", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS, T_EDGE, S_EDGE, shared_sql("t_edge", "s_edge", "f")) + "SELECT * FROM f")
def f_shared_devs(spark, sf):
    return features.shared_devs(
        edges.tech_edges(tech_rows(spark, sf)), edges.social_graph(social_rows(spark, sf)))


@query("panel_calendar", with_ctes(TECH, TECH_MONTHS, T_EDGE, tech_feature_sql("t_edge", "f")) + """
, len AS (SELECT project, max(month) + 1 + (CASE WHEN project = 'proj1' THEN 3 WHEN project = 'proj2' THEN -1000 ELSE 0 END) AS months FROM tech_m GROUP BY project),
cal AS (SELECT project, CAST(unnest(range(0, months)) AS INTEGER) AS month FROM len WHERE months > 0)
SELECT c.project, c.month, coalesce(t_num_dev_nodes, 0) AS t_num_dev_nodes, coalesce(t_num_file_nodes, 0) AS t_num_file_nodes,
       round(CAST(coalesce(t_graph_density, 0) AS DOUBLE), 6) AS t_graph_density
FROM cal c LEFT JOIN f ON f.project = c.project AND f.month = c.month""")
def panel_calendar(spark, sf):
    tech = tech_rows(spark, sf)
    shift = F.when(F.col("project") == "proj1", 3).when(F.col("project") == "proj2", -1000).otherwise(0)
    lengths = cleaning.project_length(tech, tech).withColumn("months", F.greatest(F.col("months") + shift, F.lit(0)))
    rows = features.tech_features(edges.tech_edges(tech)).select(
        "project", "month", "t_num_dev_nodes", "t_num_file_nodes", "t_graph_density")
    return rounded(panel.densify(rows, lengths))


PANEL_PARTS = (
    TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS, T_EDGE, S_EDGE,
    tech_feature_sql("t_edge", "ft"), social_feature_sql("s_edge", "fs"), clustering_sql("s_edge", "fc"),
    components_sql("s_edge", "fk"), overlap_sql("t_edge", "file", "dev", "t_net_overlap", "ot"),
    overlap_sql("s_edge", "src", "dst", "s_net_overlap", "os"), shared_sql("t_edge", "s_edge", "fd"),
    """plen AS (SELECT project, max(month) + 1 AS months FROM (SELECT project, month FROM tech_m UNION ALL SELECT project, month FROM social_m) GROUP BY project),
pcal AS (SELECT project, CAST(unnest(range(0, months)) AS INTEGER) AS month FROM plen)""",
)


def _column(c: str) -> str:
    kind = "BIGINT" if c in COUNT_FEATURES else "DOUBLE"
    return f"coalesce(CAST({c} AS {kind}), 0) AS {c}"


PANEL = f"""panel AS (
  SELECT c.project AS proj_name, c.month, {', '.join(_column(c) for c in FEATURES)}
  FROM pcal c LEFT JOIN ft USING (project, month) LEFT JOIN fs USING (project, month) LEFT JOIN fc USING (project, month)
  LEFT JOIN fk USING (project, month) LEFT JOIN ot USING (project, month) LEFT JOIN os USING (project, month)
  LEFT JOIN fd USING (project, month))"""
PANEL_SQL = (*PANEL_PARTS, PANEL)
PANEL_SELECT = ", ".join(c if c in COUNT_FEATURES else f"round({c}, 6) AS {c}" for c in FEATURES)


@query("panel", with_ctes(*PANEL_SQL, recursive=True) + f"SELECT proj_name, month, {PANEL_SELECT} FROM panel")
def network_panel(spark, sf):
    logs = Logs(views.tech_log(spark, sf), views.social_log(spark, sf))
    return rounded(panel.panel_from_logs(logs))
