"""Queries over incremental and streaming work."""

from pyspark.sql import functions as F

from kinweave.operators import cleaning, edges, panel as panel_ops
from kinweave.plans import jobs
from kinweave.queries.contracts import SOCIAL_MONTHS, TECH_MONTHS, incoming, numbered
from kinweave.queries.panel import PANEL_SELECT, PANEL_SQL, rounded
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import EVENTS, SOCIAL, TECH, with_ctes
from kinweave.schemas import Logs
from kinweave.session import settle, work_path
from kinweave.sources import views
from kinweave.streaming import delta, ingest, months, panel_store

CUT = 40


def cleaned(spark, sf) -> Logs:
    logs = numbered(spark, sf)
    people = lambda df: df.withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))
    return Logs(
        settle(people(cleaning.clean_source_files(logs.tech))),
        settle(cleaning.infer_replies(settle(people(logs.social)))))


def early_panel(logs: Logs):
    tech, social = logs.tech.where(f"month < {CUT}"), logs.social.where(f"month < {CUT}")
    lengths = cleaning.project_length(tech, social)
    return settle(panel_ops.build_panel(
        settle(edges.tech_edges(tech)), settle(edges.social_graph(social)), lengths))


@query("delta_panel", with_ctes(*PANEL_SQL, recursive=True) + f"SELECT proj_name, month, {PANEL_SELECT} FROM panel")
def delta_panel(spark, sf):
    """A panel stored up to a month, continued: equal to the panel of one run."""
    logs = cleaned(spark, sf)
    return rounded(delta.delta_panel(logs, early_panel(logs)))


def dated(spark, sf) -> Logs:
    """Project, time and month of both logs; the technical one is joined once, what follows reads its table."""
    tech, social = views.tech_log(spark, sf), views.social_log(spark, sf)
    return cleaning.impute_months(Logs(settle(tech.select("project", "ts")), settle(social.select("project", "ts"))))


@query("delta_late_rows", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
, nxt AS (SELECT project, CASE WHEN project = 'proj9' THEN 0 ELSE 10 + CAST(substr(project, 5) AS INTEGER) END AS n FROM (SELECT DISTINCT project FROM tech_m))
SELECT 'tech' AS log, project, month, CAST(count(*) AS BIGINT) AS n FROM tech_m JOIN nxt USING (project) WHERE month >= nxt.n GROUP BY project, month
UNION ALL SELECT 'social', project, month, CAST(count(*) AS BIGINT) FROM social_m JOIN nxt USING (project) WHERE month >= nxt.n GROUP BY project, month""")
def delta_late_rows(spark, sf):
    logs = dated(spark, sf)
    months = logs.tech.select("project").distinct().where("project <> 'proj9'").select(
        "project", (F.substr("project", F.lit(5)).cast("int") + 10).alias("next"))
    kept = delta.drop_late(logs, months)
    count = lambda df, name: df.groupBy("project", "month").agg(F.count(F.lit(1)).alias("n")).withColumn("log", F.lit(name))
    return count(kept.tech, "tech").unionByName(count(kept.social, "social"))


@query("delta_length", with_ctes(TECH, SOCIAL, TECH_MONTHS, SOCIAL_MONTHS) + """
SELECT project, CAST(max(month) - CASE WHEN project IN ('proj1', 'proj2') THEN 12 ELSE 0 END + 1 AS INTEGER) AS months
FROM (SELECT project, month FROM tech_m UNION ALL SELECT project, month FROM social_m) GROUP BY project""")
def delta_length(spark, sf):
    logs = dated(spark, sf)
    months = logs.tech.where("project IN ('proj1', 'proj2')").select("project").distinct().withColumn("next", F.lit(12))
    return delta.new_length(logs.tech, logs.social, months)


@query("delta_vis", with_ctes(EVENTS) + """
SELECT project, month, CAST(count(*) FILTER (month >= 5) AS BIGINT) + CASE WHEN month < 5 THEN CAST(100 AS BIGINT) ELSE 0 END AS n
FROM event_log WHERE month <= 25 OR month >= 5 GROUP BY project, month""")
def delta_vis(spark, sf):
    counts = views.event_log(spark, sf).groupBy("project", "month").agg(F.count(F.lit(1)).alias("n"))
    new = counts.where("month >= 5")
    old = counts.where("month <= 25").withColumn("n", F.lit(100).cast("long"))
    return delta.merge_vis(new, old, ["project", "month"])


def event_stream(spark, sf, files: int = 4):
    """The event log as a folder of files in time order, read as a stream of micro-batches."""
    folder = work_path(spark, "events")
    log = views.event_log(spark, sf).withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))
    log.repartitionByRange(files, "ts").write.parquet(folder)
    return ingest.read_log_stream(spark, folder, log.schema, files_per_batch=1)


@query("stream_tech_edges", with_ctes(EVENTS) + """
SELECT project, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS month, subject AS file, sender AS dev, CAST(count(*) AS BIGINT) AS weight FROM event_log GROUP BY ALL""")
def stream_tech_edges(spark, sf):
    base, keys = work_path(spark, "stream"), ["project", "day", "file", "dev"]
    log = event_stream(spark, sf).withColumn("file", F.col("subject"))
    months.keep_months(ingest.stream_edges(log), base, f"{base}-state", keys, ingest.monthly_edges).awaitTermination()
    return months.months_so_far(spark, base, keys, ingest.monthly_edges)


@query("stream_activity", with_ctes(EVENTS) + """
SELECT project, strftime(ts, '%Y-%m-%d') AS day, CAST(count(DISTINCT sender) AS BIGINT) AS people, CAST(count(*) AS BIGINT) AS messages FROM event_log GROUP BY ALL""")
def stream_activity(spark, sf):
    base, keys = work_path(spark, "stream"), ["project", "day", "dev"]
    rows = ingest.stream_activity(event_stream(spark, sf))
    months.keep_months(rows, base, f"{base}-state", keys, ingest.active_people).awaitTermination()
    return months.months_so_far(spark, base, keys, ingest.active_people).withColumn("day", F.col("day").cast("string"))


@query("stream_closed_months", with_ctes(SOCIAL) + """
SELECT project, CAST(year(ts) * 12 + month(ts) - 1 AS INTEGER) AS month, subject AS file, sender AS dev, CAST(count(*) AS BIGINT) AS weight FROM social_log GROUP BY ALL""")
def stream_closed_months(spark, sf):
    """Years of messages in order: nearly all months are closed and summed up before the stream ends."""
    base, folder, keys = work_path(spark, "stream"), work_path(spark, "messages"), ["project", "day", "file", "dev"]
    log = views.social_log(spark, sf).select("project", F.col("ts").cast("timestamp").alias("ts"), F.col("sender").alias("dev"),
                                             F.col("subject").alias("file"))
    for first, last in ((0, 1994), (1994, 1996), (1996, 9999)):  # one span after the other, since older rows would be late
        log.where((F.year("ts") >= first) & (F.year("ts") < last)).write.mode("append").parquet(folder)
        stream = ingest.read_log_stream(spark, folder, log.schema)  # goes on from the checkpoint with the files of this span
        months.keep_months(ingest.stream_edges(stream), base, f"{base}-state", keys, ingest.monthly_edges).awaitTermination()
    return months.months_so_far(spark, base, keys, ingest.monthly_edges)


@query("stream_social_graph", with_ctes(EVENTS, """m_reply AS (
  SELECT *, lag(message_id) OVER (PARTITION BY project, month, subject ORDER BY ts, message_id) AS in_reply_to FROM event_log),
m_pair AS (SELECT r.project, r.month, r.sender AS dev, i.sender AS prev_dev FROM m_reply r
  JOIN m_reply i ON i.project = r.project AND i.month = r.month AND i.message_id = r.in_reply_to WHERE i.sender <> r.sender)""") + """
SELECT project, month, src, dst, CAST(sum(w) AS BIGINT) AS weight FROM (
  SELECT project, month, dev AS src, prev_dev AS dst, 1 AS w FROM m_pair UNION ALL SELECT project, month, prev_dev, dev, 1 FROM m_pair
  UNION ALL SELECT DISTINCT project, month, sender, sender, 0 FROM event_log) GROUP BY ALL""")
def stream_social_graph(spark, sf):
    """Social graphs kept by micro-batches equal those of one batch run."""
    base = work_path(spark, "ingest")
    ingest.ingest_social(event_stream(spark, sf), base, f"{base}/state").awaitTermination()
    return ingest.current_graph(spark, base).select("project", F.col("month").cast("int").alias("month"), "src", "dst", "weight")


def log_stream(spark, sf, files: int = 3):
    """Both logs as a folder of files in time order, read as micro-batches; one row in twenty comes some 400 days late."""
    folder = work_path(spark, "logs")
    people = lambda df: df.withColumn("is_bot", F.lit(0)).withColumn("dev", F.col("sender"))
    tech = people(cleaning.clean_source_files(cleaning.clean_file_paths(views.tech_log(spark, sf))))
    rows = panel_store.as_rows(tech, people(views.social_log(spark, sf)))
    late = F.when(F.pmod(F.xxhash64("ts", "dev", "file", "message_id"), F.lit(20)) == 0, 400).otherwise(0)
    rows.withColumn("_due", F.date_add(F.to_date("ts"), late)).repartitionByRange(files, "_due").drop("_due").write.parquet(folder)
    return ingest.read_log_stream(spark, folder, rows.schema, files_per_batch=1)


@query("stream_ingest", with_ctes(*PANEL_SQL, recursive=True) + f"SELECT proj_name, month, {PANEL_SELECT} FROM panel")
def stream_ingest(spark, sf):
    """The panel kept by micro-batches, late rows among them, equals that of one run."""
    base = work_path(spark, "ingest")
    panel_store.ingest_logs(log_stream(spark, sf), base, f"{base}-state").awaitTermination()
    return rounded(panel_store.current_panel(spark, base))


@query("compute_job", with_ctes(*PANEL_SQL, recursive=True) + f"""
SELECT proj_name, month, {PANEL_SELECT} FROM panel JOIN (SELECT t.project, least(t.m, s.m) AS m
  FROM (SELECT project, max(month) AS m FROM tech_m GROUP BY project) t JOIN (SELECT project, max(month) AS m FROM social_m GROUP BY project) s ON s.project = t.project) e
  ON e.project = proj_name WHERE month BETWEEN 3 AND e.m""")
def compute_job(spark, sf):
    """Request-shaped logs to the panel of a month range."""
    steps = ["files", "months", "replies", "sources", "names"]
    return rounded(jobs.compute(*incoming(spark, sf), ["net-gen"], (3, -1), steps=steps)["net-gen"])
