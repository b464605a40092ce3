"""Reading and writing the logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import text
from kinweave.operators.contracts import clean_strings, enforce
from kinweave.schemas import Logs

# File name of each log by incubator and version, as data folders have them.
LOG_NAMES = {
    "apache": {"tech": {"1": "commits"}, "social": {"1": "emails"}},
    "github": {"tech": {"3": "commits"}, "social": {"4": "issues"}},
    "eclipse": {"tech": {"1": "commits"}, "social": {"1": "issues"}},
    "ospos": {"tech": {"0": "commits"}, "social": {"0": "issues"}},
}
DEFAULT_NAMES = {"tech": "commits", "social": "issues"}


def log_path(base: str, incubator: str, kind: str, version: str, ext: str = "parquet") -> str:
    """`<base>/<incubator>_data/<name>.<ext>` with the name that stands for the version.

    A version without a name has the default name followed by the version, and
    version 0 the default name alone.
    """
    name = LOG_NAMES.get(incubator, {}).get(kind, {}).get(str(version))
    if name is None:
        name = DEFAULT_NAMES[kind] + ("" if str(version) == "0" else str(version))
    return f"{base.rstrip('/')}/{incubator}_data/{name}.{ext}"


def load_logs(spark: SparkSession, base: str, incubator: str, versions: dict[str, str],
              schemas: dict[str, T.StructType | str] | None = None) -> Logs:
    """Both logs of a version: parquet where it exists, else CSV, then kept as parquet beside it."""
    loaded = {}
    for kind in ("tech", "social"):
        path = log_path(base, incubator, kind, versions[kind])
        try:
            loaded[kind] = spark.read.parquet(path)
        except AnalysisException as error:
            if not schemas or error.getCondition() != "PATH_NOT_FOUND":
                raise
            source = log_path(base, incubator, kind, versions[kind], "csv")
            rows = spark.read.csv(source, schema=schemas[kind], header=True, multiLine=True, escape='"')
            rows.write.mode("overwrite").parquet(path)
            loaded[kind] = spark.read.parquet(path)
    return Logs(loaded["tech"], loaded["social"])


def save_logs(logs: Logs, base: str, incubator: str, versions: dict[str, str]) -> None:
    for kind, rows in (("tech", logs.tech), ("social", logs.social)):
        rows.write.mode("overwrite").parquet(log_path(base, incubator, kind, versions[kind]))


def load_many(spark: SparkSession, base: str, incubators: dict[str, dict[str, str]]) -> Logs:
    """The logs of several incubators below each other, with an `incubator` column."""
    out = None
    for name, versions in incubators.items():
        logs = load_logs(spark, base, name, versions)
        logs = Logs(*[df.withColumn("incubator", F.lit(name)) for df in (logs.tech, logs.social)])
        out = logs if out is None else Logs(
            out.tech.unionByName(logs.tech, allowMissingColumns=True),
            out.social.unionByName(logs.social, allowMissingColumns=True))
    return out


def _stem(path) -> F.Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Projects that have a file in the folder.

    Scans never see files of no bytes at all; where those matter, take the
    expected projects from a status table instead.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.select(F.url_decode(_stem(F.col("path"))).alias("project_name"), "length")


def missing_projects(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected projects without rows."""
    return expected.select("project_name").join(rows.select("project_name").distinct(), "project_name", "left_anti")


def combine_tech(spark: SparkSession, folder: str, columns: list[str],
                 clean: tuple[str, ...] = ("commit_id", "file_name", "commit_msg"), project=None) -> DataFrame:
    """All headerless files of a folder; the file name, or `project` from its path, is the project."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(folder, schema=schema, header=False, escape='"', lineSep="\n")
    ended = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"\r$", "") if c == columns[-1] else F.col(f"`{c}`")
    rows = rows.select(
        *[text.raw_lines(ended(c)).alias(c) for c in columns if c != "project_name"],
        (_stem(F.col("_metadata.file_name")) if project is None else project).alias("project_name"))
    return enforce(clean_strings(rows, [c for c in clean if c in columns]), "tech")


def combine_social(spark: SparkSession, folder: str, fields: dict[str, str],
                   clean: tuple[str, ...] = ("subject", "title")) -> DataFrame:
    """All per-project files with a header, renamed by the field map; quoted line breaks are kept whole."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fields])
    rows = spark.read.csv(folder, schema=schema, header=True, multiLine=True, lineSep="\n", escape='"')
    rows = rows.select(
        *[text.raw_lines(F.col(f"`{src}`")).alias(dst) for src, dst in fields.items()],
        _stem(F.col("_metadata.file_name")).alias("project_name"))
    order = ["project_name", *[d for d in fields.values() if "[IGNORE]" not in d]]
    return enforce(clean_strings(rows, [c for c in clean if c in rows.columns]), "social", order=order)
