"""Queries over log cleaning and imputation."""

from pyspark.sql import functions as F

from kinweave.operators import cleaning
from kinweave.queries.contracts import SOCIAL_MONTHS, TECH_MONTHS, numbered
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import EVENTS, SOCIAL, TECH, with_ctes
from kinweave.schemas import Logs
from kinweave.session import settle
from kinweave.sources import views


def copied():
    """Every third path with the note of a copy in front."""
    return F.when(
        F.col("commit_id").cast("long") % 3 == 0,
        F.concat(F.lit("  - copied, changed from r"), "commit_id", F.lit(", "), "file"),
    ).otherwise(F.col("file"))


COPIED_SQL = """raw AS (SELECT project, commit_id, CASE WHEN CAST(commit_id AS BIGINT) % 3 = 0
  THEN '  - copied, changed from r' || commit_id || ', ' || file ELSE file END AS file FROM tech_log)"""


@query("clean_file_paths", with_ctes(TECH, COPIED_SQL) + r"""
SELECT project, commit_id, regexp_replace(file, '^  - copied, (changed|unchanged) from r\d*, ', '') AS file FROM raw""")
def clean_file_paths(spark, sf):
    raw = views.tech_log(spark, sf).select("project", "commit_id", copied().alias("file"))
    return cleaning.clean_file_paths(raw)


@query("clean_file_paths_changed", with_ctes(TECH, COPIED_SQL) + r"""
SELECT CAST(count(*) AS BIGINT) AS changed_paths FROM raw
WHERE regexp_replace(file, '^  - copied, (changed|unchanged) from r\d*, ', '') <> file""")
def clean_file_paths_changed(spark, sf):
    raw = views.tech_log(spark, sf).select(copied().alias("file"))
    return cleaning.count_changed_paths(raw)


@query("clean_sender_names", r"""
WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '## ' || c_name || ' #' WHEN 1 THEN 'a' || chr(10) || c_mktsegment
                              WHEN 2 THEN ' ' || c_mktsegment ELSE c_name END AS sender FROM customer)
SELECT c_custkey, sender, replace(CASE WHEN contains(sender, '#') THEN trim(trim(sender, '#')) ELSE sender END, chr(10), ' ') AS dev FROM r""")
def clean_sender_names(spark, sf):
    k = F.col("c_custkey") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("## "), "c_name", F.lit(" #")))
        .when(k == 1, F.concat(F.lit("a\n"), "c_mktsegment"))
        .when(k == 2, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.col("c_name")))
    raw = views.table(spark, sf, "customer").select("c_custkey", name.alias("sender"))
    return cleaning.clean_sender_names(raw)


@query("impute_months", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
SELECT 'tech' AS log, project, sender, commit_id AS id, month FROM tech_m
UNION ALL SELECT 'social', project, sender, message_id, month FROM social_m""")
def impute_months(spark, sf):
    logs = numbered(spark, sf)
    tech = logs.tech.select(F.lit("tech").alias("log"), "project", "sender", F.col("commit_id").alias("id"), "month")
    social = logs.social.select(F.lit("social").alias("log"), "project", "sender", F.col("message_id").alias("id"), "month")
    return tech.unionByName(social)


@query("impute_months_day", with_ctes(SOCIAL, EVENTS) + """
, u AS (SELECT project, ts, message_id FROM social_log UNION ALL SELECT project, ts, message_id FROM event_log)
SELECT project, message_id,
       CAST(floor(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY project)) / 86400000000.0) / 30) AS INTEGER) AS month FROM u""")
def impute_months_day(spark, sf):
    both = views.social_log(spark, sf).select("project", "ts", "message_id").unionByName(
        views.event_log(spark, sf).select("project", "ts", "message_id"))
    return cleaning.impute_months(Logs(both, both), "day").social.select("project", "message_id", "month")


@query("start_date_upsert", with_ctes(TECH, SOCIAL) + """
, known AS (SELECT DISTINCT 'proj' || (s_suppkey % 5) AS project, TIMESTAMP '1994-06-01 00:00:00' AS start FROM supplier)
SELECT project, strftime(start, '%Y-%m-%d') AS start FROM known
UNION ALL
SELECT project, strftime(min(ts), '%Y-%m-%d') FROM tech_log WHERE project NOT IN (SELECT project FROM known) GROUP BY project""")
def start_date_upsert(spark, sf):
    known = views.table(spark, sf, "supplier").select(
        F.concat(F.lit("proj"), (F.col("s_suppkey") % 5).cast("string")).alias("project"),
        F.lit("1994-06-01 00:00:00").cast("timestamp_ntz").alias("start")).distinct()
    starts = cleaning.project_starts(Logs(views.tech_log(spark, sf), views.social_log(spark, sf)))
    out = cleaning.upsert_start_dates(starts, known)
    return out.select("project", F.date_format("start", "yyyy-MM-dd").alias("start"))


@query("impute_message_id", with_ctes(SOCIAL, EVENTS) + """
, u AS (SELECT * FROM social_log UNION ALL SELECT project, ts, sender, subject, message_id FROM event_log)
SELECT project, sender, replace('<' || strftime(ts, '%Y-%m-%d %H:%M:%S')
   || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00=' || project || '@' || sender || '>', ' ', '') AS message_id
FROM u""")
def impute_message_id(spark, sf):
    both = views.social_log(spark, sf).unionByName(views.event_log(spark, sf).drop("month"))
    return cleaning.impute_message_id(both).select("project", "sender", "message_id")


@query("infer_replies", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
SELECT project, month, subject, sender, message_id,
       lag(message_id) OVER (PARTITION BY project, subject ORDER BY ts, message_id) AS in_reply_to FROM social_m""")
def infer_replies(spark, sf):
    logs = numbered(spark, sf)
    return cleaning.infer_replies(settle(logs.social)).select(
        "project", "month", "subject", "sender", "message_id", "in_reply_to")


@query("infer_replies_guard", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
SELECT round(t.x, 6) AS threaded, round(f.x, 6) AS filled, CAST(t.x > f.x AND f.x <= 0.95 AS INTEGER) AS infer
FROM (SELECT avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END) AS x FROM (SELECT count(*) AS n FROM social_m GROUP BY project, month, subject)) t,
     (SELECT CAST(count(DISTINCT sender) AS DOUBLE) / count(*) AS x FROM social_m) f""")
def infer_replies_guard(spark, sf):
    logs = numbered(spark, sf)
    out = cleaning.reply_guard(logs.social.withColumn("in_reply_to", F.col("sender")))
    return out.select(F.round("threaded", 6).alias("threaded"), F.round("filled", 6).alias("filled"), "infer")


@query("clean_source_files", with_ctes(TECH) + r"""
SELECT project, commit_id, file, CASE WHEN lower(regexp_extract(file, '(\.[^.]*)$', 1)) IN ('.java', '.py', '.mdtext') THEN 1 ELSE 0 END AS is_coding
FROM tech_log""")
def clean_source_files(spark, sf):
    tech = views.tech_log(spark, sf).select("project", "commit_id", "file")
    return cleaning.clean_source_files(tech)


BOT_PARTS, BOT_NAMES, BOT_SHARE = ["v1", "v2"], ["DEV3"], 0.04
BOT_REPORT_SQL = """rep AS (
  SELECT log, project, sender, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY log, project) AS share
  FROM (SELECT 'tech' AS log, project, sender FROM tech_log UNION ALL SELECT 'social', project, sender FROM social_log)
  GROUP BY log, project, sender),
flag AS (SELECT *, CASE WHEN contains(lower(sender), 'v1') OR contains(lower(sender), 'v2') THEN 1 ELSE 0 END AS substring,
    CASE WHEN share > 0.04 THEN 1 ELSE 0 END AS outlier FROM rep),
bots AS (SELECT *, CASE WHEN lower(sender) = 'dev3' OR (substring = 1 AND outlier = 1) THEN 1 ELSE 0 END AS is_bot FROM flag)"""


@query("removed_bots_report", with_ctes(TECH, SOCIAL, BOT_REPORT_SQL) + """
SELECT log, project, sender, CAST(n AS BIGINT) AS n, substring, outlier, round(CAST(share AS DOUBLE), 6) AS share, is_bot FROM bots""")
def removed_bots_report(spark, sf):
    parts = [
        cleaning.bots_report(df, BOT_PARTS, BOT_NAMES, BOT_SHARE).withColumn("log", F.lit(name))
        for name, df in (("tech", views.tech_log(spark, sf)), ("social", views.social_log(spark, sf)))
    ]
    return parts[0].unionByName(parts[1]).withColumn("share", F.round("share", 6))


@query("infer_bots", with_ctes(TECH, SOCIAL, BOT_REPORT_SQL) + """
, names AS (SELECT DISTINCT log, sender FROM bots WHERE is_bot = 1)
SELECT 'tech' AS log, project, t.sender, commit_id AS id, CASE WHEN n.sender IS NULL THEN 0 ELSE 1 END AS is_bot
FROM tech_log t LEFT JOIN names n ON n.log = 'tech' AND n.sender = t.sender
UNION ALL
SELECT 'social', project, t.sender, message_id, CASE WHEN n.sender IS NULL THEN 0 ELSE 1 END
FROM social_log t LEFT JOIN names n ON n.log = 'social' AND n.sender = t.sender""")
def infer_bots(spark, sf):
    logs = cleaning.infer_bots(
        Logs(views.tech_log(spark, sf), views.social_log(spark, sf)), BOT_PARTS, BOT_NAMES, BOT_SHARE)
    tech = logs.tech.select(F.lit("tech").alias("log"), "project", "sender", F.col("commit_id").alias("id"), "is_bot")
    return tech.unionByName(logs.social.select(
        F.lit("social").alias("log"), "project", "sender", F.col("message_id").alias("id"), "is_bot"))


@query("project_length", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
SELECT project, CAST(max(month) + 1 AS INTEGER) AS months
FROM (SELECT project, month FROM tech_m UNION ALL SELECT project, month FROM social_m) GROUP BY project""")
def project_length(spark, sf):
    logs = numbered(spark, sf)
    return cleaning.project_length(logs.tech, logs.social)


# Mean lifecycle ratios of two incubators.
LIFECYCLE = {"apache": 1.0, "github": 4.1507782252508845}


@query("relative_time", with_ctes(TECH, TECH_MONTHS) + """
SELECT project, incubator, commit_id, CAST(floor((1.0::DOUBLE / CASE incubator WHEN 'github' THEN 4.1507782252508845::DOUBLE ELSE 1.0::DOUBLE END) * month) AS INTEGER) AS month
FROM (SELECT *, CASE WHEN project IN ('proj1', 'proj3', 'proj5') THEN 'github' ELSE 'apache' END AS incubator FROM tech_m)""")
def relative_time(spark, sf):
    tech = numbered(spark, sf).tech.withColumn(
        "incubator", F.when(F.col("project").isin("proj1", "proj3", "proj5"), "github").otherwise("apache"))
    return cleaning.relative_time(tech, "static", "apache", LIFECYCLE).select(
        "project", "incubator", "commit_id", "month")


@query("segment_months", with_ctes(TECH, TECH_MONTHS) + """
SELECT project, month, CAST(count(*) AS BIGINT) AS n FROM tech_m WHERE sender <> 'dev7' GROUP BY project, month""")
def segment_months(spark, sf):
    tech = numbered(spark, sf).tech.withColumn("dev", F.nullif("sender", F.lit("dev7")))
    return cleaning.segment_months(tech).groupBy("project", "month").agg(F.count(F.lit(1)).alias("n"))


@query("passthrough_author", with_ctes(TECH, SOCIAL) + """
SELECT 'tech' AS log, project, sender AS dev, CAST(count(*) AS BIGINT) AS n FROM tech_log GROUP BY project, sender
UNION ALL SELECT 'social', project, sender, CAST(count(*) AS BIGINT) FROM social_log GROUP BY project, sender""")
def passthrough_author(spark, sf):
    logs = cleaning.passthrough_author(Logs(views.tech_log(spark, sf), views.social_log(spark, sf)))
    count = lambda df, name: df.groupBy("project", "dev").agg(F.count(F.lit(1)).alias("n")).withColumn("log", F.lit(name))
    return count(logs.tech, "tech").unionByName(count(logs.social, "social"))


@query("process_chain", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
, s AS (SELECT project, month, sender, lag(message_id) OVER (PARTITION BY project, subject ORDER BY ts, message_id) AS r FROM social_m)
SELECT 'tech' AS log, project, month, sender AS dev, CASE WHEN file LIKE '%.java' OR file LIKE '%.py' THEN 1 ELSE 0 END AS flag, CAST(count(*) AS BIGINT) AS n
FROM tech_m GROUP BY project, month, sender, flag
UNION ALL
SELECT 'social', project, month, sender, CASE WHEN r IS NULL THEN 0 ELSE 1 END AS flag, CAST(count(*) AS BIGINT) FROM s GROUP BY project, month, sender, flag""")
def process_chain(spark, sf):
    logs = cleaning.process(
        Logs(views.tech_log(spark, sf), views.social_log(spark, sf)),
        ["files", "months", "replies", "sources", "bots", "names"])
    count = lambda df, flag, name: df.withColumn("flag", flag).groupBy("project", "month", "dev", "flag").agg(
        F.count(F.lit(1)).alias("n")).withColumn("log", F.lit(name))
    return count(logs.tech, F.col("is_coding"), "tech").unionByName(
        count(logs.social, F.col("in_reply_to").isNotNull().cast("int"), "social"))
