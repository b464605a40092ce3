"""Queries that write to the shared folder and read back."""

from pyspark.sql import functions as F

from kinweave.operators import cleaning, edges
from kinweave.queries.contracts import TECH_MONTHS, numbered
from kinweave.queries.edges import E_EDGE, E_REPLY, T_EDGE, event_rows, tech_rows
from kinweave.queries.modelling import FORECAST, clip, forecast
from kinweave.queries.panel import rounded
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import EVENTS, SOCIAL, STATUS, TECH, with_ctes
from kinweave.queries.transforms import COLS, ROUND, SMALL_SQL, as_doubles, small_panel
from kinweave.queries.trials import ROW, STORE, store
from kinweave.schemas import FEATURES, Logs, PANEL_COLUMNS
from kinweave.session import settle, work_path
from kinweave.sources import dims, logs, products, views


def text_logs(spark, sf) -> Logs:
    tech = views.tech_log(spark, sf).select("project", "sender", "file", "added", "commit_id")
    social = views.social_log(spark, sf).select("project", "sender", "subject", "message_id")
    return Logs(tech, social)


TWO_LOGS = """SELECT 'tech' AS log, project, sender, file AS item, CAST(count(*) AS BIGINT) AS n FROM tech_log GROUP BY ALL
UNION ALL SELECT 'social', project, sender, subject, CAST(count(*) AS BIGINT) FROM social_log GROUP BY ALL"""


def counted(both: Logs, extra=()):
    count = lambda df, name, item: df.groupBy(
        *extra, "project", "sender", F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n")).withColumn("log", F.lit(name))
    return count(both.tech, "tech", "file").unionByName(count(both.social, "social", "subject"))


@query("src_versioned", with_ctes(TECH, SOCIAL) + TWO_LOGS)
def src_versioned(spark, sf):
    """CSV logs of a version, converted to parquet on first use and read again."""
    base, versions = work_path(spark, "logs"), {"tech": "1", "social": "1"}
    both = text_logs(spark, sf)
    for kind, df in (("tech", both.tech), ("social", both.social)):
        df.write.option("header", True).csv(logs.log_path(base, "apache", kind, "1", "csv"))
    schemas = {"tech": both.tech.schema, "social": both.social.schema}
    logs.load_logs(spark, base, "apache", versions, schemas)
    return counted(logs.load_logs(spark, base, "apache", versions))


@query("snk_versioned", with_ctes(TECH, SOCIAL) + TWO_LOGS)
def snk_versioned(spark, sf):
    base, versions = work_path(spark, "logs"), {"tech": "3", "social": "4"}
    logs.save_logs(text_logs(spark, sf), base, "github", versions)
    return counted(logs.load_logs(spark, base, "github", versions))


@query("src_all_incubators", with_ctes(TECH, SOCIAL) + f"SELECT 'github' AS incubator, * FROM ({TWO_LOGS}) UNION ALL SELECT 'eclipse', * FROM ({TWO_LOGS}) WHERE project IN ('proj1', 'proj2')")
def src_all_incubators(spark, sf):
    base, both = work_path(spark, "logs"), text_logs(spark, sf)
    few = F.col("project").isin("proj1", "proj2")
    logs.save_logs(both, base, "github", {"tech": "3", "social": "4"})
    logs.save_logs(Logs(both.tech.where(few), both.social.where(few)), base, "eclipse", {"tech": "1", "social": "1"})
    many = logs.load_many(spark, base, {"github": {"tech": "3", "social": "4"}, "eclipse": {"tech": "1", "social": "1"}})
    return counted(many, ["incubator"])


@query("src_tech_dir", with_ctes(TECH) + """
SELECT replace(project, 'proj', 'p') AS project_name, commit_id, file AS file_name, sender AS sender_name, sender AS author, 0 AS is_bot, 1 AS is_coding FROM tech_log""")
def src_tech_dir(spark, sf):
    """Headerless files, one folder of them per project; the folder name stands for the file stem."""
    path = work_path(spark, "tech")
    rows = views.tech_log(spark, sf).select(
        F.replace("project", F.lit("proj"), F.lit("p")).alias("proj"),
        F.concat(F.lit("#"), "commit_id").alias("commit_id"), "file", "sender")
    rows.write.partitionBy("proj").option("header", False).option("escape", '"').csv(path)
    folder = F.regexp_extract("_metadata.file_path", "proj=([^/]+)", 1)
    return logs.combine_tech(spark, path, ["commit_id", "file_name", "sender_name"], project=folder)


@query("src_social_dir", r"""
SELECT conv_id AS id, replace(regexp_replace(replace(text, '#', ''), '\r\n|\r|\n', '. ', 'g'), '_nl_', '. ') AS title, role AS sender_name, role AS author, 0 AS is_bot, '' AS in_reply_to
FROM (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS conv_id, text, role FROM conversations)""")
def src_social_dir(spark, sf):
    path = work_path(spark, "social")
    rows = views.table(spark, sf, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("Id"),
        F.col("text").alias("Title"), F.col("role").alias("Sender Name"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    out = logs.combine_social(spark, path, {"Id": "id", "Title": "title", "Sender Name": "sender_name"})
    return out.drop("project_name", "message_id")


@query("src_dims", with_ctes(STATUS, TECH, TECH_MONTHS) + """
SELECT 'status' AS dim, project AS key, status AS value FROM status
UNION ALL SELECT 'length', project, CAST(max(month) + 1 AS VARCHAR) FROM tech_m GROUP BY project
UNION ALL SELECT 'start', s_name, '20' || lpad(CAST(10 + s_nationkey AS VARCHAR), 2, '0') || '-03-04 05:06:07' FROM supplier
UNION ALL SELECT 'alias', 'proj' || (p_partkey % 10) || '/' || p_partkey, p_name FROM part
UNION ALL SELECT 'cluster', 'proj' || (p_partkey % 10) || '/' || p_brand || '-' || (p_partkey % 10), p_brand || '-' || (p_partkey % 10) || '-' || p_partkey FROM part
UNION ALL SELECT DISTINCT 'bot', CASE WHEN c_nationkey % 2 = 0 THEN 'part' ELSE 'whole' END, c_mktsegment || c_nationkey FROM customer
UNION ALL SELECT 'ratio', n_name, CAST(round(n_nationkey / 4.0, 6) AS VARCHAR) FROM nation""")
def src_dims(spark, sf):
    """All lookup tables written as folders of JSON objects and loaded as tables."""
    base = work_path(spark, "dims")
    part, customer = views.table(spark, sf, "part"), views.table(spark, sf, "customer")
    project = F.concat(F.lit("proj"), (F.col("p_partkey") % 10).cast("string"))
    of = lambda rows, dim, key, value: rows.select(F.lit(dim).alias("dim"), key.alias("key"), value.cast("string").alias("value"))
    dims.save_lists(views.status(spark, sf), f"{base}/status", "status", "project", bucket_rows=4)
    dims.save_objects(cleaning.project_length(*[numbered(spark, sf).tech] * 2), f"{base}/lengths", "project", "months", bucket_rows=4)
    year = F.concat(F.lit("20"), F.lpad((F.col("s_nationkey") + 10).cast("string"), 2, "0"), F.lit("-03-04 05:06:07"))
    dims.save_objects(views.table(spark, sf, "supplier").select("s_name", year.alias("start")), f"{base}/starts", "s_name", "start", bucket_rows=50)
    dims.save_maps(part.select(project.alias("project"), F.col("p_partkey").cast("string").alias("alias"), "p_name"),
                   f"{base}/aliases", "project", "alias", "p_name", bucket_rows=200)
    group = F.concat("p_brand", F.lit("-"), (F.col("p_partkey") % 10).cast("string"))
    member = F.concat(group, F.lit("-"), F.col("p_partkey").cast("string"))
    clusters = part.groupBy(project.alias("project"), group.alias("c")).agg(F.collect_list(member).alias("names"))
    dims.save_lists(clusters, f"{base}/clusters", "project", "names", bucket_rows=20)
    bots = customer.select(F.when(F.col("c_nationkey") % 2 == 0, "substring-bots").otherwise("project-bots").alias("kind"),
                           F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name")).distinct()
    dims.save_lists(bots, f"{base}/bots", "kind", "name", bucket_rows=30)
    ratio = F.struct((F.col("n_nationkey") / 4).alias("ratio"), F.lit(1.0).alias("tech"), F.lit(1.0).alias("social"))
    nations = views.table(spark, sf, "nation").select(F.lit("prof").alias("profile"), "n_name", ratio.alias("r"))
    dims.save_maps(nations, f"{base}/ratios", "profile", "n_name", "r", bucket_rows=10)
    loaded = [
        of(dims.load_status(spark, f"{base}/status"), "status", F.col("project"), F.col("status")),
        of(dims.load_lengths(spark, f"{base}/lengths"), "length", F.col("project"), F.col("months")),
        of(dims.load_starts(spark, f"{base}/starts"), "start", F.col("project"), F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
        of(dims.load_aliases(spark, f"{base}/aliases"), "alias", F.concat_ws("/", "project", "name"), F.col("full_name")),
        of(dims.load_clusters(spark, f"{base}/clusters"), "cluster", F.concat(
            "project", F.lit("/"), F.regexp_replace("cluster", "-[0-9]+$", "")), F.col("name")),
        of(spark.createDataFrame([(k, n) for k, names in zip(("part", "whole"), dims.load_bot_names(spark, f"{base}/bots")) for n in names],
                                 "kind string, name string"), "bot", F.col("kind"), F.col("name")),
        of(spark.createDataFrame(list(dims.load_ratios(spark, f"{base}/ratios", "prof").items()), "n string, r double"),
           "ratio", F.col("n"), F.round("r", 6)),
    ]
    out = loaded[0]
    for rows in loaded[1:]:
        out = out.unionByName(rows)
    return out


@query("snk_month_slices", with_ctes(TECH, TECH_MONTHS) + """
SELECT project, CAST(month - 2 AS INTEGER) AS month, CAST(count(*) AS BIGINT) AS n FROM tech_m WHERE sender <> 'dev7' AND month >= 2 GROUP BY ALL""")
def snk_month_slices(spark, sf):
    path = work_path(spark, "slices")
    tech = numbered(spark, sf).tech.withColumn("dev", F.nullif("sender", F.lit("dev7"))).where("month >= 2")
    products.write_slices(tech, path, start=2)
    return spark.read.parquet(path).groupBy("project", F.col("month").cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@query("src_edges", with_ctes(TECH, TECH_MONTHS, T_EDGE, EVENTS, E_REPLY, E_EDGE) + """
SELECT 'tech' AS graph, project, month, file AS a, dev AS b, weight FROM t_edge UNION ALL SELECT 'social', project, month, src, dst, weight FROM e_edge""")
def src_edges(spark, sf):
    base = work_path(spark, "edges")
    products.write_edges(edges.tech_edges(tech_rows(spark, sf)), f"{base}/t")
    products.write_edges(edges.social_graph(event_rows(spark, sf)), f"{base}/s")
    t = products.read_edges(spark, f"{base}/t").select(
        F.lit("tech").alias("graph"), "project", "month", F.col("file").alias("a"), F.col("dev").alias("b"), "weight")
    s = products.read_edges(spark, f"{base}/s", "social").select(
        F.lit("social").alias("graph"), "project", "month", F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    return t.unionByName(s).unionByName(products.read_edges(spark, f"{base}/none").select(
        F.lit("tech").alias("graph"), "project", "month", F.col("file").alias("a"), F.col("dev").alias("b"), "weight"))


@query("snk_mapping", with_ctes(EVENTS, E_REPLY) + """
SELECT project, message_id, dev AS sender, prev_dev AS receiver, 0 AS broadcast FROM e_pair
UNION ALL SELECT project, reference, prev_dev, dev, 1 FROM e_pair""")
def snk_mapping(spark, sf):
    path = work_path(spark, "mapping")
    products.write_interactions(edges.interaction_map(edges.reply_pairs(event_rows(spark, sf))), path)
    schema = "project string, message_id string, sender string, receiver string, ts string, broadcast int"
    return spark.read.csv(path, schema=schema, header=True).drop("ts")


def full_width(spark, sf):
    """The small panel with the features it lacks set to 0."""
    rows = small_panel(spark, sf)
    missing = {c: F.lit(0.0) for c in FEATURES if c not in rows.columns}
    return rows.withColumns(missing).select(*[
        F.col(c).cast(products.panel_schema()[c].dataType) for c in PANEL_COLUMNS])


@query("src_panel", with_ctes(*SMALL_SQL) + f"""
SELECT 'clean' AS kind, proj_name, month, {ROUND} FROM p
UNION ALL SELECT 'late' AS kind, proj_name, month, {ROUND} FROM p WHERE month >= 40""")
def src_panel(spark, sf):
    """A panel stored as clean, and a derived one that is built from it when first asked for."""
    path = work_path(spark, "panel")
    products.write_panel(full_width(spark, sf), path, "apache", "clean", "1-1")
    clean = products.read_panel(spark, path, "apache", "clean", "1-1")
    late = products.read_panel(spark, path, "apache", "late", "1-1", build=lambda p: p.where("month >= 40"))
    pick = lambda df, name: as_doubles(df.select("proj_name", "month", *COLS)).withColumn("kind", F.lit(name))
    return pick(clean, "clean").unionByName(pick(late, "late"))


@query("src_cached_panel", with_ctes(*SMALL_SQL) + f"""
SELECT proj_name, month, {ROUND} FROM p WHERE (proj_name IN ('proj1', 'proj2') AND month < 20) OR (proj_name NOT IN ('proj1', 'proj2') AND month < 10)""")
def src_cached_panel(spark, sf):
    path, rows = work_path(spark, "cache"), full_width(spark, sf)
    products.save_cached(rows.where("month < 10"), path)
    products.save_cached(rows.where("month < 20 AND proj_name IN ('proj1', 'proj2')"), path)
    return as_doubles(products.load_cached(spark, path).select("proj_name", "month", *COLS))


VIS = """vis AS (SELECT project, month, dev AS a, split_part(file, '.', -1) AS b, CAST(sum(weight) AS BIGINT) AS weight FROM t_edge GROUP BY ALL)"""
TRAJ = f"""path AS (SELECT project, month, {clip('p')} AS p FROM fc WHERE month % 2 = 0)"""


@query("snk_json_products", with_ctes(*SMALL_SQL, FORECAST, *[c for c in (TECH, TECH_MONTHS, T_EDGE) if c not in SMALL_SQL], VIS, TRAJ) + """
SELECT 'forecast' AS product, project, month, '' AS a, '' AS b, round(CASE WHEN project IN ('proj1', 'proj4') THEN p / 2 ELSE p END, 6) AS value
FROM fc WHERE project NOT IN ('proj1', 'proj4') OR month < 30
UNION ALL SELECT 'vis', project, month, a, b, round(CAST(weight * CASE WHEN project IN ('proj1', 'proj4') THEN 2 ELSE 1 END AS DOUBLE), 6) FROM vis
UNION ALL SELECT 'trajectory', project, month, '', '', round(p, 6) FROM path""")
def snk_json_products(spark, sf):
    """Forecast, graphs and paths of all projects saved, then those of two projects anew, which share buckets with others."""
    path = work_path(spark, "products")
    two = F.col("project").isin("proj1", "proj4")
    scores = settle(forecast(spark, sf))
    pages = settle(edges.vis_tech(edges.tech_edges(tech_rows(spark, sf))))
    near = F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0))
    paths = scores.where("month % 2 = 0").select("project", "month", F.array(near).alias("path"))
    first = {"forecast": scores, "vis": pages, "trajectory": paths}
    products.write_products(first, path, buckets=3)
    again = {"forecast": scores.where(two & (F.col("month") < 30)).withColumn("p", F.col("p") / 2),
             "vis": pages.where(two).withColumn("weight", F.col("weight") * 2), "trajectory": paths.where(two)}
    products.write_products(again, path, number=1)
    products.write_products(again, path, number=1)  # a repeated save changes nothing
    read = lambda name, schema: products.read_product(spark, path, name, f"project string, month int, {schema}").withColumn(
        "product", F.lit(name))
    cells = lambda rows, a, b, value: rows.select("product", "project", "month", a.alias("a"), b.alias("b"), F.round(value, 6).alias("value"))
    none = F.lit("")
    return cells(read("forecast", "p double"), none, none, F.col("p")).unionByName(
        cells(read("vis", "dev string, kind string, weight long"), F.col("dev"), F.col("kind"), F.col("weight").cast("double"))).unionByName(
        cells(read("trajectory", "path array<double>"), none, none, F.col("path")[0]))


@query("snk_forecast_csv", with_ctes(*SMALL_SQL, FORECAST) + "SELECT project, month, round(p, 6) AS close FROM fc")
def snk_forecast_csv(spark, sf):
    path, rows = work_path(spark, "forecast"), forecast(spark, sf)
    products.write_forecast(rows.where("project <> 'proj2' OR month < 10"), path, buckets=2)
    products.write_forecast(rows.where("project = 'proj2'"), path)
    return products.read_forecast(spark, path).select("project", "month", F.round("close", 6).alias("close"))


@query("src_trials", with_ctes(*STORE) + f"SELECT date, {ROW} FROM store")
def src_trials(spark, sf):
    path = work_path(spark, "trials")
    rows = products.load_trials(spark, path).unionByName(store(spark, sf))
    late = F.col("date") >= "2024"
    products.export_trials(rows.where(~late), path)
    products.export_trials(rows.where(late), path)
    return rounded(products.load_trials(spark, path))
