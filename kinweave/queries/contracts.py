"""Queries over schema contracts, projections and profiles."""

from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import cleaning, contracts
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import EVENTS, SOCIAL, TECH, with_ctes
from kinweave.schemas import Logs
from kinweave.sources import views


def incoming(spark, sf):
    """The canonical logs under the field names of an incoming request."""
    tech = views.tech_log(spark, sf).select(
        F.col("project"), F.lit("2020-01-01").alias("start_date"), F.lit("2024-01-01").alias("end_date"),
        F.lit("graduated").alias("status"), F.col("commit_id").alias("commit_sha"),
        F.concat("sender", F.lit("@example.org")).alias("email"), F.col("sender").alias("name"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("added").alias("timestamp"),
        F.col("file").alias("filename"), F.lit("M").alias("change_type"),
        F.col("added").alias("lines_added"), F.col("deleted").alias("lines_deleted"),
        F.lit("m").alias("commit_message"), F.lit("u").alias("commit_url"),
    )
    social = views.social_log(spark, sf).select(
        F.lit("issue").alias("type"), F.col("subject").alias("issue_url"), F.lit("c").alias("comment_url"),
        F.col("project").alias("repo_name"), F.col("message_id").alias("id"),
        F.col("subject").alias("title"), F.lit("b").alias("body"), F.col("sender").alias("user_login"),
        F.col("sender").alias("user_id"), F.col("sender").alias("user_name"),
        F.concat("sender", F.lit("@example.org")).alias("user_email"),
        F.date_format("ts", "yyyy-MM-dd").alias("created_at"),
    )
    return tech, social


TECH_MONTHS = """tech_m AS (
  SELECT *, CAST((year(ts) * 12 + month(ts)) - min(year(ts) * 12 + month(ts)) OVER (PARTITION BY project) AS INTEGER) AS month
  FROM tech_log)"""
SOCIAL_MONTHS = """tech_start AS (SELECT project, min(year(ts) * 12 + month(ts)) AS s FROM tech_log GROUP BY project),
social_m AS (
  SELECT l.*, CAST((year(ts) * 12 + month(ts)) - s AS INTEGER) AS month
  FROM social_log l JOIN tech_start USING (project) WHERE (year(ts) * 12 + month(ts)) >= s)"""


def numbered(spark, sf) -> Logs:
    return cleaning.impute_months(Logs(views.tech_log(spark, sf), views.social_log(spark, sf)))


@query("translate_schema", with_ctes(TECH, SOCIAL) + """
SELECT 'tech' AS log, project AS project_name, sender AS sender_name, sender || '@example.org' AS sender_email,
       strftime(ts, '%Y-%m-%d') AS date, file AS item, CAST(added AS VARCHAR) AS extra FROM tech_log
UNION ALL
SELECT 'social', project, sender, sender || '@example.org', strftime(ts, '%Y-%m-%d'), subject, message_id FROM social_log""")
def translate_schema(spark, sf):
    logs = contracts.translate(*incoming(spark, sf))
    tech = logs.tech.select(
        F.lit("tech").alias("log"), "project_name", "sender_name", "sender_email", "date",
        F.col("file_name").alias("item"), F.col("added").cast("string").alias("extra"))
    social = logs.social.select(
        F.lit("social").alias("log"), "project_name", "sender_name", "sender_email", "date",
        F.col("subject").alias("item"), F.col("comment_id").alias("extra"))
    return tech.unionByName(social)


@query("ensure_columns", with_ctes(TECH, SOCIAL) + """
SELECT 'tech' AS log, project AS project_name, 0 AS month, 0 AS is_bot, '0' AS filled, '' AS author, CAST(count(*) AS BIGINT) AS n
FROM tech_log GROUP BY project
UNION ALL
SELECT 'social', project, 0, 0, '', '', CAST(count(*) AS BIGINT) FROM social_log GROUP BY project""")
def ensure_columns(spark, sf):
    logs = contracts.ensure(contracts.translate(*incoming(spark, sf)))
    keys = ["project_name", "month", "is_bot", "filled", "author"]
    tech = logs.tech.withColumn("filled", F.col("is_coding").cast("string")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n")).withColumn("log", F.lit("tech"))
    social = logs.social.withColumn("filled", F.concat("in_reply_to", "message_id")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n")).withColumn("log", F.lit("social"))
    return tech.unionByName(social)


@query("enforce_cols", """
SELECT conv_id, turn, role AS sender_name, role AS author, 0 AS is_bot, '' AS in_reply_to,
       CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS BIGINT) AS message_id
FROM conversations""")
def enforce_cols(spark, sf):
    raw = views.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("sender_name"), F.col("text").alias("body"),
        F.lit(1).alias("[IGNORE]1"))
    return contracts.enforce(raw, "social", order=["conv_id", "turn"])


@query("rebase_months", with_ctes(TECH) + """
, m AS (SELECT project, sender, year(ts) * 12 + month(ts) - 1 AS mi FROM tech_log)
SELECT project, sender, CAST(mi - min(mi) OVER (PARTITION BY project) AS INTEGER) AS month FROM m""")
def rebase_months(spark, sf):
    log = views.tech_log(spark, sf).select("project", "sender", cleaning.month_index("ts").alias("month"))
    out = contracts.rebase_months(log)
    return out.select("project", "sender", F.col("month").cast("int").alias("month"))


@query("require_tech", with_ctes(TECH, EVENTS) + """
SELECT 'proj' || subject AS project, sender, message_id FROM event_log
WHERE 'proj' || subject IN (SELECT project FROM tech_log WHERE file LIKE '%/f1.%' OR project IN ('proj0', 'proj3'))""")
def require_tech(spark, sf):
    social = views.event_log(spark, sf).select(
        F.concat(F.lit("proj"), "subject").alias("project"), "sender", "message_id")
    tech = views.tech_log(spark, sf).where(
        F.col("file").contains("/f1.") | F.col("project").isin("proj0", "proj3"))
    return contracts.require_tech(social, tech)


@query("missing_profile", """
WITH r AS (SELECT nullif(c_mktsegment, 'BUILDING') AS c_mktsegment,
                  CASE WHEN c_custkey % 50 = 0 THEN '' ELSE c_name END AS c_name, c_acctbal FROM customer),
p AS (
  SELECT 'c_mktsegment' AS column_name, count(*) AS t, sum(CASE WHEN c_mktsegment IS NULL OR c_mktsegment = '' THEN 1 ELSE 0 END) AS m FROM r
  UNION ALL SELECT 'c_name', count(*), sum(CASE WHEN c_name IS NULL OR c_name = '' THEN 1 ELSE 0 END) FROM r
  UNION ALL SELECT 'c_acctbal', count(*), sum(CASE WHEN c_acctbal IS NULL THEN 1 ELSE 0 END) FROM r)
SELECT column_name, CAST(t AS BIGINT) AS total, CAST(m AS BIGINT) AS missing,
       CASE WHEN m * 1.0 / greatest(t, 1) > 0.05 THEN 1 ELSE 0 END AS over_threshold FROM p""")
def missing_profile(spark, sf):
    rows = views.table(spark, sf, "customer").select(
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 50 == 0, "").otherwise(F.col("c_name")).alias("c_name"), "c_acctbal")
    return contracts.missing_profile(rows)


@query("clean_strings", r"""
SELECT doc_id, regexp_replace(replace(text, '#', ''), '\r\n|\r|\n', '. ', 'g') AS text FROM documents""")
def clean_strings(spark, sf):
    return contracts.clean_strings(views.table(spark, sf, "documents").select("doc_id", "text"), ["text"])


@query("clean_strings_changed", r"""
WITH c AS (SELECT text, source, regexp_replace(replace(text, '#', ''), '\r\n|\r|\n', '. ', 'g') AS t FROM documents)
SELECT CAST(count(*) AS BIGINT) AS changed_rows FROM (SELECT DISTINCT t, source FROM c WHERE t IS DISTINCT FROM text)""")
def clean_strings_changed(spark, sf):
    return contracts.count_cleaned(views.table(spark, sf, "documents").select("text", "source"), ["text"])


@query("clean_lines", r"""
SELECT conv_id, turn, regexp_replace(replace(text, chr(10), '_nl_'), '\r|_nl_', '. ', 'g') AS text FROM conversations""")
def clean_lines(spark, sf):
    raw = views.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.replace("text", F.lit("\n"), F.lit("_nl_")).alias("text"))
    return contracts.clean_lines(raw, "text")


LONG_NAME = "' ' || upper(p_name) || ' (' || p_brand || ') / ' || p_type || CASE p_partkey % 3 WHEN 0 THEN '-beta' WHEN 1 THEN ': x y' ELSE ' ' END"


@query("clean_project_name", f"""
WITH n AS (SELECT p_partkey, {LONG_NAME} AS name FROM part),
c AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(name), '\\s*\\([^()]*\\)\\s*', '', 'g'), '[-:].*$', '') AS c FROM n)
SELECT p_partkey, replace(trim(replace(c, '/', '-')), ' ', '-') AS project FROM c""")
def clean_project_name(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, "-beta").when(F.col("p_partkey") % 3 == 1, ": x y").otherwise(" ")
    raw = views.table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit(" "), F.upper("p_name"), F.lit(" ("), "p_brand", F.lit(") / "), "p_type", tail).alias("project"))
    return contracts.clean_project_name(raw)


def nation_groups(spark, sf):
    """Regions as parents, nations as children, grouped once more as technologies."""
    nation = views.table(spark, sf, "nation")
    region = views.table(spark, sf, "region")
    pairs = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(
        F.collect_list("n_name").alias("children"))
    return pairs.select(F.lit("all").alias("technology"), F.col("r_name").alias("parent"), "children")


@query("rollup_projects", """
SELECT coalesce(replace(lower(r_name), ' ', '-'), 'other') AS project, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 20
LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def rollup_projects(spark, sf):
    groups = contracts.flatten_groups(nation_groups(spark, sf))
    customer = views.table(spark, sf, "customer")
    nation = views.table(spark, sf, "nation").where("n_nationkey < 20")
    rows = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.coalesce("n_name", F.lit("other")).alias("project"), "c_custkey")
    return contracts.rollup(rows, groups).groupBy("project").agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("key_sum"))


@query("rollup_status", """
WITH s AS (SELECT r_regionkey AS parent, CASE s_suppkey % 7 WHEN 0 THEN 'graduated' WHEN 1 THEN 'retired' ELSE 'incubating' END AS status, s_suppkey
           FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT 'area' || ((s_suppkey // 10) % 40) AS project,
       CASE WHEN max(CASE WHEN status = 'graduated' THEN 1 ELSE 0 END) = 1 THEN 'graduated'
            WHEN max(CASE WHEN status = 'retired' THEN 1 ELSE 0 END) = 1 THEN 'retired' ELSE 'incubating' END AS status
FROM s GROUP BY 1""")
def rollup_status(spark, sf):
    supplier = views.table(spark, sf, "supplier")
    status = supplier.select(
        F.col("s_name").alias("project"),
        F.when(F.col("s_suppkey") % 7 == 0, "graduated").when(F.col("s_suppkey") % 7 == 1, "retired")
        .otherwise("incubating").alias("status"))
    groups = supplier.select(F.col("s_name").alias("project"), F.concat(
        F.lit("area"), (F.floor(F.col("s_suppkey") / 10) % 40).cast("string")).alias("parent"))
    return contracts.rollup_status(status, groups)


@query("email_threads_clean", r"""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'email' ELSE 'issue' END AS type,
                  '#' || role || '@example.org' AS s, 'Re:' || text AS title, role AS subject FROM conversations)
SELECT conv_id, turn, replace(split_part(s, '@', 1), '#', '') AS sender_name, replace(split_part(s, '@', 1), '#', '') AS author,
       CASE WHEN type = 'email' THEN replace(title, 'Re:', '') ELSE title END AS title,
       CASE WHEN type = 'email' THEN regexp_replace(replace(title, 'Re:', ''), '\s+', '', 'g') ELSE subject END AS subject, type
FROM r""")
def email_threads_clean(spark, sf):
    raw = views.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "email").otherwise("issue").alias("type"),
        F.concat(F.lit("#"), "role", F.lit("@example.org")).alias("sender_name"),
        F.concat(F.lit("Re:"), "text").alias("title"), F.col("role").alias("subject"))
    return contracts.clean_threads(raw)


@query("infer_end_month", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
SELECT t.project, CAST(least(t.m, s.m) AS INTEGER) AS end_month
FROM (SELECT project, max(month) AS m FROM tech_m GROUP BY project) t
FULL JOIN (SELECT project, max(month) AS m FROM social_m GROUP BY project) s ON s.project = t.project""")
def infer_end_month(spark, sf):
    logs = numbered(spark, sf)
    return contracts.infer_end(logs.tech, logs.social)


@query("cache_coverage", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
, e AS (SELECT t.project, least(t.m, s.m) AS end_month
  FROM (SELECT project, max(month) AS m FROM tech_m GROUP BY project) t
  JOIN (SELECT project, max(month) AS m FROM social_m GROUP BY project) s ON s.project = t.project),
p AS (SELECT project, 'vis' AS product, month FROM tech_m UNION SELECT project, 'forecast', month FROM social_m WHERE sender <> 'dev1')
SELECT p.project, product, CAST(max(month) AS INTEGER) AS last_month, CAST(count(DISTINCT month) AS BIGINT) AS months,
       CASE WHEN product = 'vis' THEN CAST(max(month) >= max(end_month) AS INTEGER)
            ELSE CAST(count(DISTINCT month) >= max(end_month) + 1 AS INTEGER) END AS covered
FROM p JOIN e USING (project) GROUP BY p.project, product""")
def cache_coverage(spark, sf):
    logs = numbered(spark, sf)
    products = logs.tech.select("project", F.lit("vis").alias("product"), "month").unionByName(
        logs.social.where("sender <> 'dev1'").select("project", F.lit("forecast").alias("product"), "month"))
    return contracts.cache_coverage(products, contracts.infer_end(logs.tech, logs.social))
