import datetime as dt

import pytest
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.operators import cleaning, contracts
from kinweave.plans import jobs
from kinweave.schemas import SOCIAL_FIELDS, TECH_FIELDS, Logs


def one(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, text.project_name, "Foo Bar (old) ", "a/b-c", "X: y") == ["foo-bar", "a-b", "x"]
    assert one(spark, text.sender_name, "#ann# ", "a#b", " x", "a\nb") == ["ann#", "a#b", " x", "a b"]
    assert one(spark, text.sender_name, "##ann ##", None) == ["ann", None]
    assert one(spark, text.file_path, "  - copied, changed from r12, a/b", "a/b") == ["a/b", "a/b"]
    assert one(spark, text.extension, "a.b/c", "x.PY", "none", "a.tar.gz") == [".b/c", ".py", "", ".gz"]
    assert one(spark, text.person_key, "ann lee (x) [y]", "a.b@c.d", "J0hn") == ["ann lee", "ab", "Jhn"]
    assert one(spark, text.capitalised, "mcDONALD o-neil", "a  b") == ["Mcdonald O-neil", "A  B"]
    assert one(spark, text.free_text, "a#\r\nb\rc\nd") == ["a. b. c. d"]
    assert one(spark, text.raw_lines, "a\rb_nl_c") == ["a. b. c"]
    assert one(spark, text.reference_tokens, "<a b> <c>", "<a\n b>", "x <d>", "none", "") == [
        ["<ab>", "<c>"], ["<ab>"], ["<d>"], [], []]


def logs(spark):
    d = dt.datetime
    tech = spark.createDataFrame(
        [("p", d(2024, 3, 17), "ann", "a.py"), ("p", d(2024, 4, 1), "build-bot", "b.md"), ("q", d(2024, 1, 31), "cat", "c.PY")],
        "project string, ts timestamp_ntz, sender string, file string")
    social = spark.createDataFrame(
        [("p", d(2024, 2, 1), "ann", "s", "<0>"), ("p", d(2024, 5, 2), "bob", "s", "<1>"), ("r", d(2023, 12, 31), "dan", "t", "<2>"),
         ("r", d(2024, 1, 1), "eve", "t", "<3>")],
        "project string, ts timestamp_ntz, sender string, subject string, message_id string")
    return Logs(tech, social)


def test_calendar_months(spark, rows):
    out = cleaning.impute_months(logs(spark))
    assert rows(out.tech, "project", "sender", "month") == [("p", "ann", 0), ("p", "build-bot", 1), ("q", "cat", 0)]
    # ann wrote before the first commit of p; r has no commits, its first message counts
    assert rows(out.social, "project", "sender", "month") == [("p", "bob", 2), ("r", "dan", 0), ("r", "eve", 1)]


def test_known_start_is_kept(spark, rows):
    known = spark.createDataFrame([("p", dt.datetime(2024, 1, 1))], "project string, start timestamp_ntz")
    out = cleaning.impute_months(logs(spark), known=known)
    assert rows(out.social.where("project = 'p'"), "sender", "month") == [("ann", 1), ("bob", 4)]
    starts = cleaning.upsert_start_dates(cleaning.project_starts(logs(spark)), known)
    assert {r["project"]: r["start"].month for r in starts.collect()} == {"p": 1, "q": 1, "r": 12}


def test_fixed_steps(spark, rows):
    out = cleaning.impute_months(logs(spark), "day")
    assert rows(out.social.where("project = 'p'"), "sender", "month") == [("ann", 0), ("bob", 3)]
    with pytest.raises(ValueError):
        cleaning.impute_months(logs(spark), "week")


def test_bots(spark, rows):
    data = [("p", "ann")] * 90 + [("p", "Bot x")] * 10 + [("q", "ann")] * 99 + [("q", "Bot x")] + [("q", "GitHub")]
    df = spark.createDataFrame(data, "project string, sender string")
    out = cleaning.infer_bots(Logs(df, df.where("project = 'q'")))
    assert rows(out.tech.where("is_bot = 1").select("project", "sender").distinct()) == [
        ("p", "Bot x"), ("q", "Bot x"), ("q", "GitHub")]
    # in the other log the same name stays below the share
    assert rows(out.social.where("is_bot = 1").select("sender").distinct()) == [("GitHub",)]


def test_reply_guard(spark):
    df = logs(spark).social.withColumn("month", F.lit(0))
    filled = df.withColumn("in_reply_to", F.col("message_id"))
    assert cleaning.infer_replies(filled).where("in_reply_to <> message_id").count() == 0
    assert cleaning.infer_replies(df).where("in_reply_to = '<2>'").count() == 1


def test_steps(spark, caplog):
    out = cleaning.process(logs(spark), ["months", "nonsense", "sources"])
    assert "nonsense" in caplog.text
    assert {r["file"]: r["is_coding"] for r in out.tech.collect()} == {"a.py": 1, "b.md": 0, "c.PY": 1}


def test_rebase_and_require(spark, rows):
    df = spark.createDataFrame([("p", 3), ("p", 5), ("q", -1), ("r", 0)], "project string, month int")
    assert rows(contracts.rebase_months(df)) == [("p", 0), ("p", 2), ("q", -1), ("r", 0)]
    tech = spark.createDataFrame([("p",)], "project string")
    assert rows(contracts.require_tech(df, tech), "month") == [(3,), (5,)]


def frames(spark):
    tech = spark.createDataFrame([["2024-01-05" if c == "date" else "p" if c == "project" else "a.py" for c in TECH_FIELDS]], list(TECH_FIELDS))
    social = spark.createDataFrame([["2024-01-06" if c == "created_at" else "p" if c == "repo_name" else "x" for c in SOCIAL_FIELDS]], list(SOCIAL_FIELDS))
    return tech, social


def test_translate(spark):
    tech, social = frames(spark)
    with pytest.raises(ValueError):
        contracts.translate(None, None)
    with pytest.raises(ValueError, match="filename"):
        contracts.translate(tech.drop("filename"), social)
    only = contracts.translate(tech, None)
    assert only.social.count() == 0 and only.social.columns == list(SOCIAL_FIELDS.values())
    with pytest.raises(ValueError, match="file_name"):
        contracts.ensure(Logs(only.tech.drop("file_name"), only.social))
    full = contracts.ensure(only)
    assert {"month", "is_bot", "is_coding", "author"} <= set(full.tech.columns)


def test_one_sided_job(spark):
    tech, _ = frames(spark)
    out = jobs.compute(tech, None, ["net-gen"], (0, 5), steps=["months", "sources", "names"])["net-gen"]
    row = out.first()
    assert (row["proj_name"], row["month"], row["t_num_dev_nodes"], row["s_num_nodes"]) == ("p", 0, 1, 0)
    with pytest.raises(ValueError):
        jobs.compute(tech, None, ["nonsense"])


def test_profile_and_enforce(spark, rows):
    df = spark.createDataFrame([("a", None), ("", "x"), ("c", "y")], "u string, w string")
    assert rows(contracts.missing_profile(df)) == [(3, "u", 1, 1), (3, "w", 1, 1)]
    raw = spark.createDataFrame([("ann", "t", "b", "z"), ("bob", "s", "b", "z")], ["sender_name", "title", "body", "[IGNORE]1"])
    out = contracts.enforce(raw, "social", order=["title"])
    assert set(out.columns) == {"sender_name", "title", "author", "is_bot", "in_reply_to", "message_id"}
    assert rows(out, "sender_name", "message_id") == [("ann", 1), ("bob", 0)]


def test_groups(spark, rows):
    groups = spark.createDataFrame(
        [("t", "Big (x)", ["one", "two"]), ("t", "Empty", [])], "technology string, parent string, children array<string>")
    flat = contracts.flatten_groups(groups)
    assert rows(flat) == [("big", "big"), ("one", "big"), ("two", "big")]
    status = spark.createDataFrame([("one", "retired"), ("two", "graduated"), ("z", "incubating")], "project string, status string")
    assert rows(contracts.rollup_status(status, flat)) == [("big", "graduated"), ("z", "incubating")]


def test_relative_time(spark, rows):
    df = spark.createDataFrame([("github", 10), ("apache", 10)], "incubator string, month int")
    assert rows(cleaning.relative_time(df, "static", ratios={"apache": 1.0, "github": 4.0})) == [("apache", 10), ("github", 2)]
    assert rows(cleaning.relative_time(df)) == [("apache", 10), ("github", 10)]
