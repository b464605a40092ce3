"""Queries over graph construction."""

from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import cleaning, edges
from kinweave.queries.contracts import TECH_MONTHS, numbered
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import EVENTS, TECH, with_ctes
from kinweave.sources import views


def tech_rows(spark, sf):
    tech = cleaning.clean_source_files(numbered(spark, sf).tech)
    return tech.withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))


def event_rows(spark, sf):
    rows = views.event_log(spark, sf).withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))
    return cleaning.infer_replies(rows)


T_EDGE = """t_edge AS (
  SELECT project, month, split_part(file, '/', 3) AS file, sender AS dev, CAST(count(*) AS BIGINT) AS weight
  FROM tech_m WHERE file LIKE '%.java' OR file LIKE '%.py' GROUP BY ALL)"""
E_REPLY = """e_reply AS (
  SELECT *, lag(message_id) OVER (PARTITION BY project, subject ORDER BY ts, message_id) AS in_reply_to FROM event_log),
e_pair AS (
  SELECT r.project, r.month, r.message_id, r.sender AS dev, r.ts, r.in_reply_to AS reference, i.sender AS prev_dev, i.ts AS prev_ts
  FROM e_reply r JOIN e_reply i ON i.project = r.project AND i.month = r.month AND i.message_id = r.in_reply_to
  WHERE i.sender <> r.sender)"""
E_EDGE = """e_edge AS (
  SELECT project, month, src, dst, CAST(sum(w) AS BIGINT) AS weight FROM (
    SELECT project, month, dev AS src, prev_dev AS dst, 1 AS w FROM e_pair
    UNION ALL SELECT project, month, prev_dev, dev, 1 FROM e_pair
    UNION ALL SELECT DISTINCT project, month, sender, sender, 0 FROM event_log) GROUP BY ALL)"""


@query("tech_edges", with_ctes(TECH, TECH_MONTHS, T_EDGE) + "SELECT * FROM t_edge")
def tech_edges(spark, sf):
    return edges.tech_edges(tech_rows(spark, sf))


@query("message_index", with_ctes(EVENTS) + """
SELECT project, month, 'm' || (CAST(substr(message_id, 2, length(message_id) - 2) AS BIGINT) % 97) AS reference,
       arg_max(sender, (ts, sender)) AS prev_dev, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS prev_ts
FROM event_log GROUP BY ALL""")
def message_index(spark, sf):
    rows = event_rows(spark, sf)
    shared = F.concat(F.lit(" m"), (F.regexp_extract("message_id", "([0-9]+)", 1).cast("long") % 97).cast("string"))
    index = edges.message_index(rows.withColumn("message_id", shared))
    return index.withColumn("prev_ts", F.date_format("prev_ts", "yyyy-MM-dd HH:mm:ss"))


@query("reference_tokens", """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '<' || o_orderkey || '>'
    WHEN 1 THEN '<' || o_orderkey || chr(10) || 'x>' || ' <y' || o_orderkey || '>'
    WHEN 2 THEN 'none ' || o_orderkey ELSE '<a' || o_orderkey || '> ' || chr(9) || '<b c>' END AS t FROM orders),
w AS (SELECT k, list_filter(string_split_regex(t, '[\n\t ]'), lambda x: x <> '') AS w FROM r)
SELECT k, w[i] || w[i + 1] AS token FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM w)
WHERE contains(w[i], '<') AND NOT contains(w[i], '>') AND NOT contains(w[i + 1], '<') AND contains(w[i + 1], '>')
UNION ALL
SELECT k, x FROM (SELECT k, unnest(w) AS x FROM w) WHERE contains(x, '<') AND contains(x, '>')""")
def reference_tokens(spark, sf):
    key = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 4
    field = (
        F.when(k == 0, F.concat(F.lit("<"), key, F.lit(">")))
        .when(k == 1, F.concat(F.lit("<"), key, F.lit("\nx> <y"), key, F.lit(">")))
        .when(k == 2, F.concat(F.lit("none "), key))
        .otherwise(F.concat(F.lit("<a"), key, F.lit("> \t<b c>"))))
    rows = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), field.alias("t"))
    return rows.select("k", F.explode(text.reference_tokens(F.col("t"))).alias("token"))


@query("reply_pairs", with_ctes(EVENTS, E_REPLY) + """
SELECT project, month, message_id, dev, reference, prev_dev, CAST(1 AS BIGINT) AS n FROM e_pair""")
def reply_pairs(spark, sf):
    return edges.reply_pairs(event_rows(spark, sf)).select(
        "project", "month", "message_id", "dev", "reference", "prev_dev", "n")


@query("reply_pairs_cross_month", with_ctes(EVENTS, E_REPLY) + """
SELECT r.project, r.month, r.message_id, r.sender AS dev, r.in_reply_to AS reference, i.sender AS prev_dev, CAST(1 AS BIGINT) AS n
FROM e_reply r JOIN e_reply i ON i.project = r.project AND i.message_id = r.in_reply_to WHERE i.sender <> r.sender""")
def reply_pairs_cross_month(spark, sf):
    return edges.reply_pairs(event_rows(spark, sf), cross_month=True).select(
        "project", "month", "message_id", "dev", "reference", "prev_dev", "n")


@query("social_edges", with_ctes(EVENTS, E_REPLY, E_EDGE) + "SELECT * FROM e_edge WHERE src <> dst")
def social_edges(spark, sf):
    return edges.social_edges(edges.reply_pairs(event_rows(spark, sf)))


@query("presence_loops", with_ctes(EVENTS) + """
SELECT DISTINCT project, month, sender AS src, sender AS dst, CAST(0 AS BIGINT) AS weight FROM event_log""")
def presence_loops(spark, sf):
    rows = views.event_log(spark, sf).withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))
    return edges.presence_loops(rows)


@query("interaction_map", with_ctes(EVENTS, E_REPLY) + """
SELECT project, message_id, dev AS sender, prev_dev AS receiver, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 0 AS broadcast FROM e_pair
UNION ALL
SELECT project, reference, prev_dev, dev, strftime(prev_ts, '%Y-%m-%d %H:%M:%S'), 1 FROM e_pair""")
def interaction_map(spark, sf):
    out = edges.interaction_map(edges.reply_pairs(event_rows(spark, sf)))
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("vis_tech", with_ctes(TECH, TECH_MONTHS, T_EDGE) + """
SELECT project, month, dev, split_part(file, '.', -1) AS kind, CAST(sum(weight) AS BIGINT) AS weight FROM t_edge GROUP BY ALL""")
def vis_tech(spark, sf):
    return edges.vis_tech(edges.tech_edges(tech_rows(spark, sf)))


@query("vis_social", with_ctes(EVENTS, E_REPLY, E_EDGE) + "SELECT * FROM e_edge")
def vis_social(spark, sf):
    return edges.vis_social(edges.social_graph(event_rows(spark, sf)))


PAGED = """rows AS (
  SELECT project, 'tech' AS graph, month, dev AS a, split_part(file, '.', -1) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM t_edge GROUP BY ALL
  UNION ALL SELECT project, 'social', month, src, dst, weight FROM e_edge),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project, graph, month ORDER BY a, b) AS rn FROM rows)"""


@query("vis_package", with_ctes(TECH, TECH_MONTHS, T_EDGE, EVENTS, E_REPLY, E_EDGE, PAGED) + """
SELECT project, graph, month, CAST((rn - 1) // 25 AS INTEGER) AS page,
       CAST(count(*) OVER (PARTITION BY project, graph, month, (rn - 1) // 25) AS BIGINT) AS rows, a AS "from", b AS "to", weight FROM ranked""")
def vis_package(spark, sf):
    """The pages, with their JSON read back into rows."""
    pages = edges.vis_package(
        edges.tech_edges(tech_rows(spark, sf)), edges.social_graph(event_rows(spark, sf)), page_rows=25)
    cells = F.explode(F.from_json("edges", "array<struct<from:string,to:string,weight:long>>"))
    return pages.select("project", "graph", "month", "page", "rows", cells.alias("e")).select(
        "project", "graph", "month", "page", "rows", "e.from", "e.to", "e.weight")
