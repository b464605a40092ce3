"""Queries over the trial store."""



from itertools import permutations

from pyspark.sql import functions as F

from kinweave.operators import trials
from kinweave.queries.panel import rounded
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import predictions_sql, with_ctes
from kinweave.sources import views

KEYS = ["transfer_strategy", "model_arch"]


def report_sql(src: str, keys: list[str], name: str) -> str:
    k = ", ".join(keys)
    parts = []
    for i, label in enumerate(trials.CLASSES):
        for metric, value in (
            ("precision", f"CASE WHEN pp{i} > 0 THEN tp{i} * 1.0 / pp{i} ELSE 0.0 END"),
            ("recall", f"CASE WHEN s{i} > 0 THEN tp{i} * 1.0 / s{i} ELSE 0.0 END"),
            ("f1-score", f"CASE WHEN pp{i} + s{i} > 0 THEN 2.0 * tp{i} / (pp{i} + s{i}) ELSE 0.0 END"),
        ):
            parts.append((label, metric, value, f"s{i}"))
    for metric in ("precision", "recall", "f1-score"):
        zero, one = [v for l, m, v, s in parts if m == metric and l in trials.CLASSES]
        parts.append(("weighted avg", metric, f"(({zero}) * s0 + ({one}) * s1) / n", "n"))
        parts.append(("macro avg", metric, f"(({zero}) + ({one})) / 2", "n"))
    parts.append(("accuracy", "accuracy", "ok * 1.0 / n", "n"))
    rows = " UNION ALL ".join(
        f"SELECT {k}, '{l}' AS label, '{m}' AS metric, CAST({v} AS DOUBLE) AS perf, CAST({s} AS BIGINT) AS support FROM {name}_c WHERE {s} > 0"
        for l, m, v, s in parts)
    sums = ", ".join(
        f"sum(CASE WHEN pred = {i} AND target = {i} THEN 1 ELSE 0 END) AS tp{i}, sum(CASE WHEN pred = {i} THEN 1 ELSE 0 END) AS pp{i}, "
        f"sum(CASE WHEN target = {i} THEN 1 ELSE 0 END) AS s{i}" for i in range(2))
    return f"""{name}_c AS (SELECT {k}, count(*) AS n, sum(CASE WHEN pred = target THEN 1 ELSE 0 END) AS ok, {sums} FROM {src} GROUP BY {k}),
{name} AS ({rows})"""


DATES = {"2023-12-31 23:00:00": 300, "2024-01-01 00:00:00": 800, "2024-01-01 00:00:03": 2000}


def store(spark, sf):
    """Three runs of the same strategies; two of them within seconds."""
    out = None
    for date, cut in DATES.items():
        report = trials.class_report(views.predictions(spark, sf, cut), [*KEYS, "month"])
        out = trials.append(out, report, date)
    return out


STORE_PARTS = []
for _i, (_d, _c) in enumerate(DATES.items()):
    STORE_PARTS += [predictions_sql(f"pr{_i}", _c), report_sql(f"pr{_i}", [*KEYS, "month"], f"rep{_i}")]
STORE = (*STORE_PARTS, "store AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS date, transfer_strategy, model_arch, month, label, metric, perf, support FROM rep{i}" for i, d in enumerate(DATES)) + ")")
ROW = "transfer_strategy, model_arch, month, label, metric, round(perf, 6) AS perf, support"


@query("class_report", with_ctes(predictions_sql(), report_sql("predictions", KEYS, "rep")) +
       "SELECT transfer_strategy, model_arch, label, metric, round(perf, 6) AS perf, support FROM rep")
def class_report(spark, sf):
    return rounded(trials.class_report(views.predictions(spark, sf), KEYS))


@query("class_report_by_step", with_ctes(predictions_sql(), report_sql("predictions", [*KEYS, "month"], "rep")) + f"SELECT {ROW} FROM rep")
def class_report_by_step(spark, sf):
    return rounded(trials.class_report(views.predictions(spark, sf), [*KEYS, "month"]))


@query("trials_append", with_ctes(*STORE) + f"SELECT date, {ROW} FROM store")
def trials_append(spark, sf):
    return rounded(store(spark, sf))


@query("trials_remove", with_ctes(*STORE) + f"SELECT date, {ROW} FROM store WHERE NOT (model_arch = 'en' AND month = 'all' AND label = 'retired')")
def trials_remove(spark, sf):
    return rounded(trials.remove(store(spark, sf), {"model_arch": "en", "month": "all", "label": "retired"}))


def summary_sql(where: str) -> str:
    stats = ", ".join(
        f"round(CAST(max({c}) AS DOUBLE), 6) AS {c}_max, round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, CAST(count({c}) AS BIGINT) AS {c}_count"
        for c in ("perf", "support"))
    return with_ctes(*STORE) + f"""SELECT transfer_strategy, model_arch, month, label, metric, {stats} FROM store
WHERE {where} GROUP BY transfer_strategy, model_arch, month, label, metric"""


def as_double_max(df):
    return rounded(df.withColumn("support_max", F.col("support_max").cast("double")))


@query("trials_summary", summary_sql("label IN ('macro avg', 'accuracy') AND metric IN ('accuracy', 'f1-score')"))
def trials_summary(spark, sf):
    return as_double_max(trials.summary(store(spark, sf), ["accuracy", "f1-score"]))


@query("trials_summary_final", summary_sql("label IN ('weighted avg', 'accuracy') AND metric = 'accuracy' AND month = 'all'"))
def trials_summary_final(spark, sf):
    return as_double_max(trials.summary(store(spark, sf), full=False, average="weighted"))


def dataset_text_sql(token: str) -> str:
    name = f"CASE regexp_extract({token}, '^\\s*([a-zA-Z])', 1) WHEN 'A' THEN 'apache' WHEN 'G' THEN 'github' WHEN 'E' THEN 'eclipse' END"
    tech = f"CASE {name} WHEN 'apache' THEN 'filepaths cleaned commits data' WHEN 'github' THEN 'source imputation, bot-free, dealiased commits data' ELSE 'dealiased w/ source files & bots commits data, now aggregated by project' END"
    social = f"CASE {name} WHEN 'apache' THEN 'sender name cleaned emails data' WHEN 'github' THEN 'reply imputed, m-id imputed, bot-free, de-aliased issues data' ELSE 'deliased w/ reply & bots issues data' END"
    return f"({name}) || ', ' || ({tech}) || ', ' || ({social})"


def side_sql(n: int) -> str:
    return f"array_to_string(list_transform(string_split_regex(split_part(transfer_strategy, '-->', {n}), '\\s*\\+\\s*'), lambda t: {dataset_text_sql('t')}), ',')"


@query("strategy_text", with_ctes(predictions_sql()) + f"""
SELECT transfer_strategy, '[' || transfer_strategy || '] -- trained w/ {{' || {side_sql(1)} || '}}; tested w/ {{' || {side_sql(2)} || '}}' AS text, CAST(count(*) AS BIGINT) AS n
FROM predictions GROUP BY ALL""")
def strategy_text(spark, sf):
    rows = views.predictions(spark, sf).groupBy("transfer_strategy").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("text", trials.describe_strategy("transfer_strategy"))


def compare_sql(field: str, where: str = "true") -> str:
    return f"SELECT {field} AS f, round(avg(perf), 6) AS mean, round(stddev_samp(perf), 6) AS std FROM store WHERE metric = 'accuracy' AND {where} GROUP BY 1"


@query("trials_compare", with_ctes(*STORE) + " UNION ALL ".join([
    compare_sql("model_arch"), compare_sql("month"),
    compare_sql("array_to_string(list_transform(string_split(transfer_strategy, '-->'), lambda t: regexp_replace(t, '[0-9-]', '', 'g')), ' --> ')",
                "NOT contains(transfer_strategy, '*')")]))
def trials_compare(spark, sf):
    rows = store(spark, sf)
    parts = [trials.compare(rows, f).withColumnRenamed(f, "f") for f in ("model_arch", "month", "transfer_strategy")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def breakdown_sql(where: str, metrics, agg: str = "avg", extra: str = "") -> str:
    cols = ", ".join(
        f"{agg}(perf) FILTER (label = '{l}' AND metric = '{m}') AS \"{trials.metric_column(l, m)}\"" for l, m in metrics)
    l, m = metrics[0]
    pairs = " OR ".join(f"(label = '{a}' AND metric = '{b}')" for a, b in metrics)
    return f"""SELECT {extra}transfer_strategy AS strat, {cols}, CAST({agg}(support) FILTER (label = '{l}' AND metric = '{m}') AS DOUBLE) AS support
FROM store WHERE ({where}) AND ({pairs}) GROUP BY ALL"""


def six_places(metrics, src: str, extra: str = "") -> str:
    cols = ", ".join(f'round("{trials.metric_column(l, m)}", 6) AS "{trials.metric_column(l, m)}"' for l, m in metrics)
    return f"SELECT {extra}strat, {cols}, round(support, 6) AS support FROM {src}"


ANY_ORDER = "|".join("".join(p) for p in permutations("cbn"))
OTHERS = "[*%ljmzadu]"
STRICT = f"regexp_matches(transfer_strategy, '[cbn]') AND NOT regexp_matches(transfer_strategy, '{OTHERS}') AND regexp_matches(transfer_strategy, '{ANY_ORDER}')"


def rounded_plain(df):
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query("subset_breakdown", with_ctes(*STORE, "b AS (" + breakdown_sql(STRICT, trials.BEST_METRICS) + ")") + six_places(trials.BEST_METRICS, "b"))
def subset_breakdown(spark, sf):
    return rounded_plain(trials.breakdown(store(spark, sf), options=trials.PRESETS["exp1"], metrics=trials.BEST_METRICS))


@query("subset_breakdown_regex", with_ctes(*STORE, "b AS (" + breakdown_sql("starts_with(transfer_strategy, 'A')", trials.DEFAULT_METRICS, "median") + ")") +
       six_places(trials.DEFAULT_METRICS, "b"))
def subset_breakdown_regex(spark, sf):
    return rounded_plain(trials.breakdown(store(spark, sf), pattern="A", agg="median"))


@query("breakdown_melt", with_ctes(*STORE, "b AS (" + breakdown_sql("regexp_matches(transfer_strategy, '[cb]')", trials.DEFAULT_METRICS) + ")",
       'top AS (SELECT * FROM b ORDER BY accuracy DESC, "macro-f1" DESC, "weighted-f1" DESC, support DESC, strat LIMIT 10)') + """
SELECT strat, 'accuracy' AS metric, round(accuracy, 6) AS value FROM top
UNION ALL SELECT strat, 'macro-f1', round("macro-f1", 6) FROM top UNION ALL SELECT strat, 'weighted-f1', round("weighted-f1", 6) FROM top""")
def breakdown_melt(spark, sf):
    return rounded(trials.melt_top(trials.breakdown(store(spark, sf), options="cb", strict=False)))


def families_sql(any_options: bool, by: str = "") -> str:
    values = ", ".join("('" + f + "', '^(?:" + p.replace("\\ ", " ").replace("\\-", "-").replace("\\>", ">") + ")')"
                       for f, p in trials.family_patterns(any_options).items())
    inner = breakdown_sql("true", trials.BEST_METRICS, "median", f"family, {by}").replace(
        "FROM store", f"FROM store JOIN (VALUES {values}) AS fam(family, pattern) ON regexp_matches(transfer_strategy, pattern)")
    order = ", ".join(f'"{trials.metric_column(l, m)}" DESC' for l, m in trials.BEST_METRICS)
    return with_ctes(*STORE, f"b AS ({inner})", f"""
w AS (SELECT *, row_number() OVER (PARTITION BY family{', ' + by.rstrip(', ') if by else ''} ORDER BY {order}, support DESC, strat) AS rn FROM b)""") + \
        six_places(trials.BEST_METRICS, "w WHERE rn = 1", f"family, {by}")


@query("best_perfs", families_sql(True))
def best_perfs(spark, sf):
    return rounded_plain(trials.best(store(spark, sf)))


@query("best_perfs_exact", families_sql(False))
def best_perfs_exact(spark, sf):
    return rounded_plain(trials.best(store(spark, sf), any_options=False))


@query("best_by_arch", families_sql(False, "model_arch, "))
def best_by_arch(spark, sf):
    return rounded_plain(trials.best(store(spark, sf), any_options=False, by=["model_arch"]))


STRATEGY, ARCH = "Acbn^ --> Acn^^", "en"
LAST = f"""last AS (SELECT *, CAST(date AS TIMESTAMP) AS t FROM store WHERE transfer_strategy = '{STRATEGY}' AND model_arch = '{ARCH}'
  AND label IN ('retired', 'graduated') AND metric IN ('f1-score', 'precision', 'recall')),
run AS (SELECT * FROM last WHERE t >= (SELECT max(t) FROM last) - INTERVAL 5 SECOND)"""


@query("perf_over_steps", with_ctes(*STORE, LAST) + """
SELECT month, round(avg(perf) FILTER (metric = 'f1-score'), 6) AS "f1-score", round(avg(perf) FILTER (metric = 'precision'), 6) AS "precision",
       round(avg(perf) FILTER (metric = 'recall'), 6) AS "recall", CAST(sum(support) FILTER (metric = 'f1-score') AS BIGINT) AS support FROM run GROUP BY month""")
def perf_over_steps(spark, sf):
    return rounded_plain(trials.over_steps(store(spark, sf), STRATEGY, ARCH))


@query("perf_over_steps_plot", with_ctes(*STORE, LAST) + """
, m AS (SELECT transfer_strategy || '-' || label AS label, TRY_CAST(split_part(month, '-', 1) AS DOUBLE) AS step, avg(perf) AS value
  FROM run WHERE metric = 'f1-score' GROUP BY ALL)
SELECT label, coalesce(step, (SELECT max(step) + 1 FROM m)) AS step, round(value, 6) AS value FROM m WHERE coalesce(step, (SELECT max(step) + 1 FROM m)) <= 250""")
def perf_over_steps_plot(spark, sf):
    return rounded(trials.plot_table(store(spark, sf), STRATEGY, ARCH))


@query("best_trial_per_arch", """
WITH r AS (SELECT doc_id AS trial, source AS transfer_strategy, lang AS model_arch, (doc_id * 7 % 101) / 100.0::DOUBLE AS acc, (doc_id * 13 % 101) / 100.0::DOUBLE AS f1,
             (doc_id * 17 % 101) / 100.0::DOUBLE AS prec, (doc_id * 29 % 101) / 100.0::DOUBLE AS rec, n_chars AS size FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY transfer_strategy, model_arch ORDER BY acc DESC, f1 DESC, prec DESC, rec DESC, trial DESC) AS rn,
        count(*) OVER (PARTITION BY transfer_strategy, model_arch) AS n, sum(size) OVER (PARTITION BY transfer_strategy, model_arch) AS t FROM r)
SELECT transfer_strategy, model_arch, trial, acc, f1, prec, rec, CAST(n - 1 AS BIGINT) AS others, CAST(t - size AS BIGINT) AS others_size FROM k WHERE rn = 1""")
def best_trial_per_arch(spark, sf):
    return trials.best_trial(views.trial_records(spark, sf))
