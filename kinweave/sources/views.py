"""Canonical logs derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def tech_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file touched: line items with the customer of their order as developer."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ext = (
        F.when(F.col("l_partkey") % 4 == 0, ".java")
        .when(F.col("l_partkey") % 4 == 1, ".py")
        .when(F.col("l_partkey") % 4 == 2, ".md")
        .otherwise(".json")
    )
    path = F.concat(
        _tag("src/m", F.col("l_partkey") % 7), _tag("/f", F.col("l_partkey") % 50), ext
    )
    return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        _tag("proj", F.col("l_suppkey") % 10).alias("project"),
        F.col("l_shipdate").alias("ts"),
        _tag("dev", F.col("o_custkey") % 25).alias("sender"),
        path.alias("file"),
        F.col("l_quantity").cast("int").alias("added"),
        F.col("l_linenumber").cast("int").alias("deleted"),
        F.col("l_orderkey").cast("string").alias("commit_id"),
    )


def social_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: orders, with the priority as thread."""
    return table(spark, sf_dir, "orders").select(
        _tag("proj", F.col("o_orderkey") % 10).alias("project"),
        F.col("o_orderdate").alias("ts"),
        _tag("dev", F.col("o_custkey") % 25).alias("sender"),
        F.col("o_orderpriority").alias("subject"),
        F.concat(F.lit("<"), F.col("o_orderkey").cast("string"), F.lit(">")).alias("message_id"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of the event stream; a day counts as a month."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("project"),
        F.col("ts"),
        _tag("user", F.col("user_id") % 30).alias("sender"),
        (F.get_json_object("props", "$.k").cast("int") % 5).cast("string").alias("subject"),
        F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit(">")).alias("message_id"),
        F.datediff(F.col("ts"), F.to_date(F.lit("2024-01-01"))).alias("month"),
    )


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even projects graduated, odd ones retired."""
    project = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") % 10).alias("n")
    ).distinct()
    return project.select(
        _tag("proj", F.col("n")).alias("project"),
        F.when(F.col("n") % 2 == 0, "graduated").otherwise("retired").alias("status"),
    )


def member_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as a project with a status, for work that needs many projects."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("project"),
        F.when(F.col("s_nationkey") % 3 == 0, "retired")
        .when(F.col("s_nationkey") % 3 == 1, "graduated")
        .when(F.col("s_nationkey") % 6 == 2, "graduated")
        .otherwise("incubating").alias("status"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as person names in several spellings, ten projects."""
    k = F.col("p_partkey") % 5
    name = (
        F.when(k == 0, F.col("p_name"))
        .when(k == 1, F.concat("p_name", F.lit("s")))
        .when(k == 2, F.concat("p_name", F.lit("@example.org")))
        .when(k == 3, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
        .otherwise(F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)), F.lit("er")))
    )
    project = _tag("proj", F.floor(F.col("p_partkey") / 5) % 10)
    return table(spark, sf_dir, "part").select(
        project.alias("project"), name.alias("name"), "p_partkey", "p_size")


# Strategies the trial records are spread over, by number of their source.
STRATEGIES = [
    "Acbn^ --> Acn^^",
    "Ecbn --> Acn",
    "Acbn^ + Ecbn --> Acn^^",
    "A-1-1cbn --> E-1-1cn",
    "Ecbn^ --> Ecn^^",
    "A-1-1cbn + E-1-1cbn^ --> E-1-1cn^^*",
    "Acbna --> Gcn",
    "E-1-1cbnd --> G-3-4cn",
]


def predictions(spark: SparkSession, sf_dir: str, cut: int = 800) -> DataFrame:
    """Binary predictions with their truth: documents longer than `cut` are predicted good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    number = F.substr("source", F.lit(4)).cast("int") % len(STRATEGIES)
    step = F.col("doc_id") % 5
    return docs.join(labels, "doc_id").select(
        F.col("doc_id"),
        F.array(*[F.lit(x) for x in STRATEGIES])[number].alias("transfer_strategy"),
        F.col("lang").alias("model_arch"),
        F.when(step == 0, "all").otherwise(F.concat(step.cast("string"), F.lit("-months"))).alias("month"),
        (F.col("n_chars") > cut).cast("int").alias("pred"),
        F.col("quality").alias("target"),
    )


def trial_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored model files: one per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    part = lambda k: ((F.col("doc_id") * k) % 101) / F.lit(100.0)
    return docs.select(
        F.col("doc_id").alias("trial"), F.col("source").alias("transfer_strategy"),
        F.col("lang").alias("model_arch"), part(7).alias("acc"), part(13).alias("f1"), part(17).alias("prec"),
        part(29).alias("rec"), F.col("n_chars").alias("size"))


def people_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many names as customers: three spellings for each person, half of them in one project."""
    number = F.col("c_custkey")
    digest = F.translate(F.md5((number - number % 3).cast("string").cast("binary")), "0123456789", "ghijklmnop")
    first, last = F.substring(digest, 1, 6), F.substring(digest, 7, 7)
    name = (
        F.when(number % 3 == 1, F.concat(first, F.lit(" "), F.substring(last, 1, 6)))
        .when(number % 3 == 2, F.concat(F.substring(first, 1, 1), first, F.lit(" "), last))
        .otherwise(F.concat(first, F.lit(" "), last)))
    project = F.when(F.floor(number / 3) % 2 == 0, F.lit("hot")).otherwise(_tag("proj", F.floor(number / 3) % 11))
    return table(spark, sf_dir, "customer").select(project.alias("project"), name.alias("name"))


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long sparse graph per group: the orders of a customer in a row, under shuffled names."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    row = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    linked = orders.withColumn("after", F.lead("o_orderkey").over(row)).where("after IS NOT NULL")
    name = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    return linked.select(
        _tag("g", F.col("o_custkey") % 7).alias("project"), name("o_orderkey").alias("src"), name("after").alias("dst"))
