"""Windows over the panel, the classifier, and what its predictions say."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.transforms import feature_columns
from kinweave.session import settle

NOT_FEATURES = {"label", "role", "dataset"}


@dataclass
class LinearModel:
    """A logistic model given by its coefficients; scored as one column expression."""

    weights: dict[str, float]
    constant: float = 0.0

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-reduce(add, [F.col(c) * F.lit(w) for c, w in self.weights.items()], F.lit(self.constant))))


Model = PipelineModel | LinearModel


def _span(lag: int | None):
    first = Window.unboundedPreceding if lag is None else -(lag - 1)
    return Window.partitionBy("proj_name").orderBy("month").rowsBetween(first, 0)


def model_features(panel: DataFrame) -> list[str]:
    return [c for c in feature_columns(panel) if c not in NOT_FEATURES]


def windows(panel: DataFrame, lag: int | None = 12) -> DataFrame:
    """For each month the vectors of the last `lag` months, or of all months so far."""
    cols = model_features(panel)
    vector = F.struct("month", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    return panel.select("proj_name", "month", F.collect_list(vector).over(_span(lag)).alias("steps"))


def window_features(panel: DataFrame, lag: int | None = 12) -> DataFrame:
    """Last value, mean and slope of each feature over its window; one shuffle by series."""
    w = _span(lag)
    out = {}
    for c in model_features(panel):
        x = F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))
        out[f"{c}_last"] = x
        out[f"{c}_mean"] = F.avg(x).over(w)
        out[f"{c}_slope"] = F.coalesce(F.regr_slope(x, F.col("month").cast("double")).over(w), F.lit(0.0))
    keep = [c for c in ("proj_name", "month", "label") if c in panel.columns]
    return panel.select(*keep, *[v.alias(k) for k, v in out.items()])


def fit(train: DataFrame, kind: str = "logistic", lag: int | None = 12) -> PipelineModel:
    """Binary model of labelled panel rows, trained on the distributed window features."""
    data = settle(window_features(train, lag))  # read once per round of the optimiser
    inputs = [c for c in data.columns if c not in ("proj_name", "month", "label")]
    last = {
        "logistic": lambda: LogisticRegression(labelCol="label", featuresCol="scaled", maxIter=10, regParam=0.01),
        "trees": lambda: GBTClassifier(labelCol="label", featuresCol="scaled", maxIter=10, seed=42),
    }
    stages = [
        VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="skip"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        last[kind](),
    ]
    return Pipeline(stages=stages).fit(data)


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """Window features with the probability `p` and the predicted class `pred`."""
    if isinstance(model, LinearModel):
        return rows.withColumn("p", model.probability()).withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return model.transform(rows).withColumns({
        "p": vector_to_array("probability")[1], "pred": F.col("prediction").cast("int")})


def score_months(panel: DataFrame, model: Model, lag: int | None = 12) -> DataFrame:
    """Probability of the positive class for every month of every series."""
    return _scored(window_features(panel, lag), model).select(F.col("proj_name").alias("project"), "month", "p")


def predict_labels(panel: DataFrame, model: Model, lag: int | None = None) -> DataFrame:
    """Predicted class of each labelled series at its last month, and whether it is missed."""
    scored = _scored(window_features(panel, lag), model).select("proj_name", "month", "label", "pred")
    last = scored.groupBy("proj_name").agg(
        F.max_by(F.struct("label", "pred"), "month").alias("_l"), F.max("month").alias("month"))
    return last.select(
        "proj_name", "month", F.col("_l.label").alias("label"), F.col("_l.pred").alias("pred"),
        (F.col("_l.label") != F.col("_l.pred")).cast("int").alias("missed"))


def soft_labels(prefixes: DataFrame, model: Model, lag: int | None = None) -> DataFrame:
    """Replace the label of each training series by the model's probability for all of it."""
    scores = score_months(prefixes, model, lag)
    last = scores.groupBy("project").agg(F.max_by("p", "month").alias("soft_label"))
    return prefixes.join(last.withColumnRenamed("project", "proj_name"), "proj_name")


def confusion_sets(forecast: DataFrame, status: DataFrame, cut: float = 0.5) -> DataFrame:
    """Each project with the last forecast month's verdict against its status.

    One row per project instead of one list per outcome, so no outcome has to
    fit a single row.
    """
    last = forecast.groupBy("project").agg(F.max_by("p", "month").alias("p"))
    yes = F.col("p") >= cut
    outcome = (
        F.when((F.col("status") == "graduated") & yes, "true-positive")
        .when(F.col("status") == "graduated", "false-negative")
        .when((F.col("status") == "retired") & yes, "false-positive")
        .when(F.col("status") == "retired", "true-negative")
        .otherwise("incubating"))
    return last.join(status, "project", "left").select("project", "p", outcome.alias("outcome"))


def confusion_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("outcome").agg(F.count(F.lit(1)).alias("projects"))


def hard_labels(forecast: DataFrame, cut: float = 0.5) -> DataFrame:
    """Class of every month."""
    return forecast.withColumn("pred", (F.col("p") >= cut).cast("int"))


def merge_keyed(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; the row of `first` wins where both have one."""
    values = [c for c in first.columns if c not in keys]
    both = first.select(*keys, F.lit(1).alias("_o"), F.struct(*values).alias("_v")).unionByName(
        second.select(*keys, F.lit(0).alias("_o"), F.struct(*values).alias("_v")))
    kept = both.groupBy(*keys).agg(F.max_by("_v", "_o").alias("_v"))
    return kept.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def merge_forecasts(new: DataFrame, cached: DataFrame) -> DataFrame:
    """New and stored forecasts; a stored value is kept."""
    return merge_keyed(cached, new, ["project", "month"])
