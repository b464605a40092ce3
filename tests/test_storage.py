import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from kinweave.operators import edges, panel as panel_ops
from kinweave.schemas import PANEL_COLUMNS, Logs
from kinweave.sources import dims, logs, products, store
from kinweave.streaming import delta, ingest, months, panel_store


def test_project_folder(spark, tmp_path, rows):
    (tmp_path / "alpha.csv").write_text('c1,"a/b#.py","fix\r_nl_more",ann\nc2,x.py,m,bob\n')
    (tmp_path / "blank.csv").write_text("\n")
    out = logs.combine_tech(spark, str(tmp_path), ["commit_id", "file_name", "commit_msg", "sender_name"])
    assert rows(out, "project_name", "commit_id", "file_name", "author", "is_coding") == [
        ("alpha", "c1", "a/b.py", "ann", 1), ("alpha", "c2", "x.py", "bob", 1)]
    files = logs.project_files(spark, str(tmp_path))
    assert rows(logs.missing_projects(out, files)) == [("blank",)]


def test_social_folder(spark, tmp_path, rows):
    (tmp_path / "beta.csv").write_text('Type,URL,Title,Sender Name,Date,Status\nemail,u,"a #b\nc",ann,2024-01-01,x\n')
    fields = {"Type": "type", "URL": "subject", "Title": "title", "Sender Name": "sender_name", "Date": "date", "Status": "[IGNORE]1"}
    out = logs.combine_social(spark, str(tmp_path), fields)
    row = out.first()
    assert (row["project_name"], row["title"], row["author"], row["message_id"]) == ("beta", "a b. c", "ann", 0)
    assert "[IGNORE]1" not in out.columns


def test_dims(spark, tmp_path, rows):
    write = lambda name, value: (tmp_path / name).write_text(json.dumps(value, indent=2)) and str(tmp_path / name)
    assert rows(dims.load_status(spark, write("s", {"graduated": ["a"], "retired": ["b", "c"]}))) == [
        ("a", "graduated"), ("b", "retired"), ("c", "retired")]
    assert rows(dims.load_lengths(spark, write("l", {"a": 3, "b": 0}))) == [("a", 3), ("b", 0)]
    assert rows(dims.load_aliases(spark, write("a", {"p": {"x": "X Y"}}))) == [("p", "x", "X Y")]
    assert rows(dims.load_clusters(spark, write("c", {"p": [["b", "a"]]}))) == [("p", "a", "a"), ("p", "a", "b")]
    assert dims.load_bot_names(spark, write("b", {"substring-bots": ["bot"], "project-bots": ["gh"]})) == (["bot"], ["gh"])
    ratios = {"prof": {"apache": {"ratio": 1.0, "tech": 1, "social": 1}, "github": {"ratio": 4.5, "tech": 1, "social": 1}}}
    assert dims.load_ratios(spark, write("r", ratios), "prof") == {"apache": 1.0, "github": 4.5}
    langs = [{"type": "programming", "extensions": [".py"]}, {"type": "data", "extensions": [".json"]}, {"type": "markup"}]
    assert dims.load_extensions(spark, write("x", langs)) == [".py"]
    assert dims.load_starts(spark, write("d", {"a": "2024-01-02 03:04:05+00:00"})).first()["start"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def panel_rows(spark, *keys):
    return spark.createDataFrame([(p, m) for p, m in keys], "proj_name string, month int").select(*[
        F.col(c) if c in ("proj_name", "month") else F.lit(1).cast(products.panel_schema()[c].dataType).alias(c)
        for c in PANEL_COLUMNS])


def test_panel_cache(spark, tmp_path, rows):
    path = str(tmp_path / "cache")
    assert products.load_cached(spark, path).count() == 0
    products.save_cached(panel_rows(spark, ("a", 0), ("a", 1), ("b", 0)), path)
    products.save_cached(panel_rows(spark, ("a", 0), ("c", 0)), path)
    assert rows(products.load_cached(spark, path), "proj_name", "month") == [("a", 0), ("b", 0), ("c", 0)]
    assert products.load_cached(spark, path, "c").count() == 1


def test_store_replaces_keys_and_keeps_the_rest(spark, tmp_path, rows):
    path, kind = str(tmp_path / "t"), "k string, n int, v double"
    frame = lambda *r: spark.createDataFrame(list(r), kind)
    assert store.load(spark, path, kind).count() == 0
    for fmt in ("parquet", "json", "csv"):
        at = f"{path}-{fmt}"
        assert store.save(frame(("a", 1, 0.5), ("b", 1, None), (None, 1, 1.0)), at, ["k"], fmt, buckets=2) == 0
        assert store.save(frame(("a", 2, 0.5), ("c", 1, 2.0)), at, ["k"], fmt) == 1
        want = [("a", 2, 0.5), ("b", 1, None), ("c", 1, 2.0), (None, 1, 1.0)]
        assert rows(store.load(spark, at, kind, fmt)) == want
        for _ in range(2):  # save 2 and save 2 again
            store.save(frame((None, 7, 7.0), ("b", 3, 3.0)), at, ["k"], fmt, number=2)
            assert rows(store.load(spark, at, kind, fmt)) == [("a", 2, 0.5), ("b", 3, 3.0), ("c", 1, 2.0), (None, 7, 7.0)]
        assert rows(store.load(spark, at, kind, fmt, k="c")) == [("c", 1, 2.0)]
        with pytest.raises(ValueError):
            store.save(frame(("a", 1, 1.0)), at, ["k"], fmt, number=1)


def test_store_ignores_a_save_that_broke_off(spark, tmp_path, rows):
    path, kind = str(tmp_path / "t"), "k string, n int"
    store.save(spark.createDataFrame([("a", 1), ("b", 1)], kind), path, ["k"], buckets=1)
    store.save(spark.createDataFrame([("a", 2)], kind), path, ["k"])
    (tmp_path / "t" / "save-00000001-1" / "_SUCCESS").unlink()
    assert rows(store.load(spark, path, kind)) == [("a", 1), ("b", 1)]
    store.save(spark.createDataFrame([("b", 5)], kind), path, ["k"])
    assert rows(store.load(spark, path, kind)) == [("a", 1), ("b", 5)]


def test_store_grows_and_forgets(spark, tmp_path, rows):
    """Buckets follow the rows; after many saves only the folders of two states are left."""
    path, kind = tmp_path / "t", "k string, n int"
    for i in range(6):
        some = [(f"k{j}", i) for j in range(40 * i, 40 * i + 40)] + [("k0", i)]
        store.save(spark.createDataFrame(some, kind), str(path), ["k"], buckets=1, bucket_rows=10)
    now = store.state(spark, str(path))
    assert now.buckets >= 20 and store.load(spark, str(path), kind).count() == 240
    assert rows(store.load(spark, str(path), kind, k="k0")) == [("k0", 5)]
    assert len([f for f in path.glob("save-*/bucket=*")]) <= 2 * now.buckets + 1


def test_products_of_other_projects_stay(spark, tmp_path, rows):
    """proj1 and proj28 share a bucket."""
    path, kind = str(tmp_path / "p"), "project string, month int, p double"
    one = lambda name, p: spark.createDataFrame([(name, 0, p)], kind)
    products.write_products({"forecast": one("proj1", 0.1), "vis": one("proj1", 1.0)}, path)
    products.write_products({"forecast": one("proj28", 0.2)}, path)
    assert rows(products.read_product(spark, path, "forecast", kind)) == [("proj1", 0, 0.1), ("proj28", 0, 0.2)]
    products.write_products({"forecast": one("proj1", 0.3)}, path)
    assert rows(products.read_product(spark, path, "forecast", kind, project="proj1")) == [("proj1", 0, 0.3)]
    assert rows(products.read_product(spark, path, "vis", kind)) == [("proj1", 0, 1.0)]
    products.write_forecast(one("x", 0.5), str(tmp_path / "f"))
    products.write_forecast(one("y", 0.6), str(tmp_path / "f"))
    assert rows(products.read_forecast(spark, str(tmp_path / "f"))) == [("x", 0, 0.5), ("y", 0, 0.6)]


def test_panel_versions(spark, tmp_path):
    path = str(tmp_path / "panel")
    products.write_panel(panel_rows(spark, ("a", 0), ("a", 1)), path, "apache", "clean", "1-1")
    built = products.read_panel(spark, path, "apache", "late", "1-1", build=lambda p: p.where("month = 1"))
    assert built.count() == 1 and products.read_panel(spark, path, "apache", "clean", "1-1").count() == 2
    assert products.read_panel(spark, path, "apache", "none", "1-1").count() == 0


def test_missing_edges(spark, tmp_path):
    assert products.read_edges(spark, str(tmp_path / "none"), "social").count() == 0
    assert products.load_trials(spark, str(tmp_path / "none")).count() == 0


@pytest.fixture(scope="module")
def history(spark):
    """Two projects over six months, with authors, flags and replies."""
    tech, social = [], []
    for p in "pq":
        for m in range(6):
            for i in range(4):
                tech.append((p, m, f"d{(i * m + i) % 5}", f"f{(i + m) % 4}.py", 0, 1))
                reply = f"<{p}{m}{i - 1}>" if i else None
                social.append((p, m, f"d{(i + m) % 3}", f"<{p}{m}{i}>", dt.datetime(2024, 1 + m, 1 + i), reply, 0))
    t = spark.createDataFrame(tech, "project string, month int, dev string, file string, is_bot int, is_coding int")
    s = spark.createDataFrame(social, "project string, month int, dev string, message_id string, ts timestamp_ntz, in_reply_to string, is_bot int")
    return Logs(t, s)


def full_panel(spark, log, months):
    lengths = spark.createDataFrame([(p, months) for p in "pq"], "project string, months int")
    return panel_ops.build_panel(edges.tech_edges(log.tech), edges.social_graph(log.social), lengths)


@pytest.mark.parametrize("stored,last", [(3, None), (5, 2), (0, None)])
def test_delta_equals_batch(spark, rows, history, stored, last):
    early = Logs(history.tech.where(f"month < {stored}"), history.social.where(f"month < {stored}"))
    cached = full_panel(spark, early, stored)
    assert rows(delta.delta_panel(history, cached, last)) == rows(full_panel(spark, history, 6))


def test_late_rows_are_dropped(spark, history):
    months = spark.createDataFrame([("p", 4)], "project string, next int")
    kept = delta.drop_late(history, months)
    assert kept.tech.where("project = 'p'").agg(F.min("month")).first()[0] == 4
    assert kept.tech.where("project = 'q'").count() == 24


def test_stream_equals_batch(spark, tmp_path, rows, history):
    folder = str(tmp_path / "in")
    log = history.social.withColumn("subject", F.lit("s")).drop("in_reply_to")
    log.repartitionByRange(3, "ts").write.parquet(folder)
    stream = ingest.read_log_stream(spark, folder, log.schema, files_per_batch=1)
    ingest.ingest_social(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = ingest.current_graph(spark, str(tmp_path / "out"))
    assert rows(got, "project", "month", "src", "dst", "weight") == rows(
        edges.social_graph(history.social), "project", "month", "src", "dst", "weight")


def test_repeated_batch_changes_nothing(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    for batch, weight in ((0, 1), (1, 5), (1, 5)):
        spark.createDataFrame([("k", weight)], "k string, w int").write.mode("overwrite").parquet(f"{path}/batch={batch}")
    assert rows(ingest.latest(spark, path, ["k"])) == [("k", 5)]


def test_logs_laid_out_by_hand(spark, tmp_path):
    """Folders have the names of the versions, not their numbers; a damaged table is reported, not replaced."""
    from pyspark.errors import AnalysisException

    from kinweave.sources import logs

    folder = tmp_path / "apache_data"
    folder.mkdir()
    (folder / "commits.csv").write_text("project,sender\np,ann\n")
    (folder / "emails.csv").write_text("project,sender\np,bob\nq,eve\n")
    schemas = {"tech": "project string, sender string", "social": "project string, sender string"}
    both = logs.load_logs(spark, str(tmp_path), "apache", {"tech": "1", "social": "1"}, schemas)
    assert both.tech.count() == 1 and both.social.count() == 2
    assert (folder / "commits.parquet").is_dir() and (folder / "emails.parquet").is_dir()
    damaged = tmp_path / "eclipse_data" / "commits.parquet"
    damaged.mkdir(parents=True)
    (damaged / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception):
        logs.load_logs(spark, str(tmp_path), "eclipse", {"tech": "1", "social": "1"}, schemas)
    assert (damaged / "part-0.parquet").read_text() == "not a table"
    with pytest.raises(AnalysisException):
        logs.load_logs(spark, str(tmp_path / "none"), "apache", {"tech": "1", "social": "1"})
    assert logs.log_path("/d", "apache", "tech", "7") == "/d/apache_data/commits7.parquet"


def test_closed_months_are_summed_up_once(spark, tmp_path, rows):
    """Fifty batches over three years: open rows stay few, each month is closed once, repeated batches change nothing."""
    path, keys = str(tmp_path / "m"), ["project", "day", "file", "dev"]
    kind, day = "project string, day date, file string, dev string, weight long", lambda n: dt.date(2021, 1, 1) + dt.timedelta(days=n)
    want, closed, most = {}, [], 0
    for number in range(50):
        # Running counts: today's key is new, yesterday's batch gets its last value.
        rows_of = [("p", day(22 * number), "f", f"d{number % 3}", number + 1), ("p", day(max(0, 22 * (number - 1))), "f", f"d{(number - 1) % 3}", 7)]
        batch = spark.createDataFrame(rows_of[: 1 if number == 0 else 2], kind)
        for _ in range(2 if number % 10 == 3 else 1):
            over = months.add_batch(batch, number, path, keys, ingest.monthly_edges, 31)
            closed += over
        want |= {(r[1], r[3]): r[4] for r in rows_of[: 1 if number == 0 else 2]}
        left = list((tmp_path / "m" / "open").glob("month=*/batch=*"))
        most = max(most, len(left))
    assert most <= 8 and len(closed) == len(set(closed)) >= 30
    assert len(list((tmp_path / "m" / "seen").glob("batch=*"))) <= 2
    sums = {}
    for (d, dev), weight in want.items():
        sums[d.year * 12 + d.month - 1, dev] = sums.get((d.year * 12 + d.month - 1, dev), 0) + weight
    assert rows(months.months_so_far(spark, path, keys, ingest.monthly_edges), "month", "dev", "weight") == sorted(
        (m, dev, w) for (m, dev), w in sums.items())


def test_a_month_half_deleted_stays_closed(spark, tmp_path, rows):
    path, keys, kind = str(tmp_path / "m"), ["project", "day", "dev"], "project string, day date, dev string, messages long"
    frame = lambda *r: spark.createDataFrame(list(r), kind)
    months.add_batch(frame(("p", dt.date(2024, 1, 3), "a", 2), ("p", dt.date(2024, 1, 3), "b", 1)), 0, path, keys, ingest.active_people, 10)
    months.add_batch(frame(("p", dt.date(2024, 3, 3), "a", 1)), 1, path, keys, ingest.active_people, 10)
    assert months.add_batch(frame(("p", dt.date(2024, 3, 4), "a", 1)), 2, path, keys, ingest.active_people, 10) == [2024 * 12]
    frame(("p", dt.date(2024, 1, 3), "b", 1)).withColumn("batch", F.lit(0)).write.partitionBy("batch").parquet(f"{path}/open/month={2024 * 12}")
    want = [("p", dt.date(2024, 1, 3), 2, 3), ("p", dt.date(2024, 3, 3), 1, 1), ("p", dt.date(2024, 3, 4), 1, 1)]
    for _ in range(2):
        assert rows(months.months_so_far(spark, path, keys, ingest.active_people), "project", "day", "people", "messages") == want
        months.add_batch(frame(("p", dt.date(2024, 3, 4), "a", 1)), 3, path, keys, ingest.active_people, 10)


def test_kept_panel_equals_batch(spark, tmp_path, rows):
    """Graphs and panel after batches out of order, late rows and a batch run twice equal those of one run."""
    tech, social = [], []
    for p in "pq":
        for m in range(5):
            for i in range(5):
                at = dt.datetime(2024, 1 + m, 2 + i)
                tech.append((p, at, f"d{(i * m + i) % 4}", f"src/f{(i + m) % 3}.py"))
                if not (p == "q" and m == 2):
                    social.append((p, at, f"d{(i + m) % 3}", f"s{i % 2}", f"<{p}{m}{i}>"))
    t = spark.createDataFrame(tech, "project string, ts timestamp, sender string, file string")
    s = spark.createDataFrame([*social, ("q", dt.datetime(2023, 12, 5), "d9", "s0", "<early>")],
                              "project string, ts timestamp, sender string, subject string, message_id string")
    want = panel_ops.panel_from_logs(Logs(t, s))
    flagged = t.withColumns({"dev": F.col("sender"), "is_bot": F.lit(0), "is_coding": F.lit(1)})
    every = panel_store.as_rows(flagged, s.withColumns({"dev": F.col("sender"), "is_bot": F.lit(0)})).collect()
    path = str(tmp_path / "k")
    for number, part in enumerate([every[10:40], every[:5] + every[60:], [], every[5:10], every[40:60]]):
        for _ in range(2 if number in (1, 4) else 1):
            panel_store.add_batch(spark.createDataFrame(part, panel_store.LOG), number, path)
    assert rows(panel_store.current_panel(spark, path)) == rows(want)
    month = lambda df: df.withColumn("month", F.year("ts") * 12 + F.month("ts") - 1)
    graph = edges.tech_edges(month(flagged).withColumn("file", F.col("file")))
    assert rows(panel_store.current_edges(spark, path, "tech"), "project", "month", "file", "dev", "weight") == rows(
        graph, "project", "month", "file", "dev", "weight")
    assert panel_store.current_edges(spark, path, "social").where("project = 'q' AND src = 'd9'").count() == 1
    assert len(list((tmp_path / "k" / "panel").glob("*-*"))) <= 3


def test_a_task_writes_few_rows_of_a_batch(spark):
    """One file of one large month and some small ones is dealt to tasks of about so many rows, months together."""
    rows = spark.range(0, 20_000, 1, 1).select(F.when(F.col("id") < 18_000, 7).otherwise(F.col("id") % 5).alias("month"), F.lit("same").alias("dev"))
    dealt = panel_store._deal(rows, 20_000, 1000).withColumn("task", F.spark_partition_id())
    tasks = dealt.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.collect_set("month").alias("months")).collect()
    assert sum(r["n"] for r in tasks) == 20_000 and max(r["n"] for r in tasks) < 3000
    assert len(tasks) >= 10 and sum(len(r["months"]) for r in tasks) <= len(tasks) + 6
    assert panel_store._deal(rows, 20_000, 20_000) is rows


def test_a_batch_is_evaluated_once(spark, tmp_path, rows):
    """The last day of a batch is read from what is stored, not by running the stream's aggregation once more."""
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    path, keys = str(tmp_path / "m"), ["project", "day", "file", "dev"]
    kind = "project string, day date, file string, dev string, weight long"
    counted = F.udf(count, "long")
    for number, day in enumerate([dt.date(2024, 1, 30), dt.date(2024, 5, 2), dt.date(2024, 5, 3)]):
        batch = spark.createDataFrame([("p", day, "f", "d", 1), ("p", day - dt.timedelta(days=31), "f", "d", 2)], kind)
        over = months.add_batch(batch.withColumn("weight", counted("weight")), number, path, keys, ingest.monthly_edges, 31)
    assert seen.value == 6 and over == [2023 * 12 + 11, 2024 * 12]
    assert spark.read.parquet(f"{path}/seen/batch=2").first()["day"] == dt.date(2024, 5, 3)
    assert months.add_batch(spark.createDataFrame([], kind), 3, path, keys, ingest.monthly_edges, 31) == []
    assert spark.read.parquet(f"{path}/seen/batch=3").first()["day"] == dt.date(2024, 5, 3)
