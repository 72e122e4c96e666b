"""Sources and sinks: every file is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide import specs
from ebbtide.functions import scalars as S
from ebbtide.operators import metrics, summaries
from ebbtide.operators.sampling import hash_sample
from ebbtide.plans import learning
from ebbtide.plans.base import Tables, fragment, query, r6, sql_bucket
from ebbtide.plans.panels import FULL
from ebbtide.plans.scored import class_fragments, scored
from ebbtide.plans.shape import names, portable, rounded, sql_cols
from ebbtide.session import scratch_path
from ebbtide.sources import readers, runs, sinks, store

fragment("document_reviews", """
SELECT doc_id::VARCHAR AS "ProductId", o_custkey::VARCHAR AS "UserId",
  try_cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS "Score", epoch(o_orderdate)::BIGINT AS "Time",
  substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS "Summary", text AS "Text"
FROM documents JOIN orders ON doc_id = o_orderkey""")


def document_reviews(t: Tables):
    """One review per document, with its whole text."""
    heads = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    joined = t["documents"].select("doc_id", "text").join(heads, F.col("doc_id") == F.col("o_orderkey"))
    return joined.select(
        F.col("doc_id").cast("string").alias("ProductId"), F.col("o_custkey").cast("string").alias("UserId"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("Score"),
        S.unix_from_timestamp(F.col("o_orderdate")).alias("Time"),
        F.get(F.split("o_orderpriority", "-", 2), F.lit(1)).alias("Summary"), F.col("text").alias("Text"),
    )


@query("s1_read_reviews_csv", """
SELECT "ProductId", "UserId", "Score"::BIGINT AS "Score", "Time", "Summary", md5("Text") AS digest FROM document_reviews""")
def _(t: Tables):
    path = sinks.write_csv(document_reviews(t), scratch_path(t.spark, "reviews"))
    df = readers.read_log(t.spark, "reviews", path)
    return portable(df.select("ProductId", "UserId", "Score", "Time", "Summary", F.md5("Text").alias("digest")))


_SALES_SUM = ("SELECT \"StockCode\", count(*) AS n_rows, " + r6('sum("Quantity")', 4) + " AS quantity, "
              "strftime(max(\"InvoiceDate\"), '%Y-%m-%d') AS last_day FROM sales_log GROUP BY ALL")


@query("s2_stacked_sales_parts", _SALES_SUM)
def _(t: Tables):
    log = t.sales_log()
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    parts = []
    for name, part in (("early", log.where(F.col("InvoiceDate") < cut)), ("late", log.where(F.col("InvoiceDate") >= cut))):
        path = sinks.write_csv(part, scratch_path(t.spark, f"sales-{name}"))
        parts.append(readers.read_log(t.spark, "sales", path, multiLine=False))
    return readers.stack(parts).groupBy("StockCode").agg(
        F.count("*").alias("n_rows"), rounded(F.sum("Quantity"), 4).alias("quantity"),
        F.date_format(F.max("InvoiceDate"), "yyyy-MM-dd").alias("last_day"),
    )


def usage_csv(t: Tables, rows, name: str) -> str:
    out = rows.select(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss 'UTC'").alias("event_time"), "event_type", "product_id",
        F.lit(None).cast("bigint").alias("category_id"), F.lit(None).cast("string").alias("category_code"),
        F.lit(None).cast("string").alias("brand"), F.col("price").cast("float").alias("price"),
        F.col("user_id").cast("int").alias("user_id"), "user_session",
    )
    return sinks.write_csv(out, scratch_path(t.spark, name))


@query("s3_sampled_typed_read", f"""
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM usage_log
WHERE {sql_bucket('user_session', 1000)} < 100 GROUP BY ALL""")
def _(t: Tables):
    path = usage_csv(t, t.usage_log(), "usage")
    df = readers.read_log(t.spark, "usage", path, multiLine=False)
    return hash_sample(df, "user_session", 0.10).groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users")
    )


@query("s4_combined_event_files", """
SELECT event_type, count(*) AS n_rows, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_moment FROM usage_log GROUP BY ALL""")
def _(t: Tables):
    log = t.usage_log()
    paths = [
        usage_csv(t, log.where(F.dayofmonth("event_time") <= 15), "first-half"),
        usage_csv(t, log.where(F.dayofmonth("event_time") > 15), "second-half"),
    ]
    df = readers.read_log(t.spark, "usage", paths, multiLine=False)
    moment = S.naive_timestamp(F.col("event_time"))
    return portable(df.groupBy("event_type").agg(F.count("*").alias("n_rows"), F.max(moment).alias("last_moment")))


def _write_panels(t: Tables) -> str:
    folder = scratch_path(t.spark, "processed")
    for source in ("reviews", "sales"):
        sinks.write_panel(t.labelled(source, "brand").select(*names(FULL[source])), folder, source)
    return folder


def _panel_schema(source: str) -> str:
    kinds = {"s": "string", "t": "string", "m": "timestamp_ntz", "d": "double", "i": "bigint"}
    return ", ".join(f"`{w.split(':')[1]}` {kinds[w[0]]}" for w in FULL[source].split())


@query("s5_panel_discovery", """
SELECT 'reviews' AS source, count(*) AS n_rows FROM brand_reviews_panel UNION ALL SELECT 'sales', count(*) FROM brand_sales_panel""")
def _(t: Tables):
    found = readers.find_panels(t.spark, _write_panels(t))
    parts = [
        readers.read_panel(t.spark, path, _panel_schema(s)).agg(F.count("*").alias("n_rows")).select(
            F.lit(s).alias("source"), "n_rows"
        )
        for s, path in found.items()
    ]
    return readers.stack(parts)


@query("s6_panel_read_back", f"SELECT {sql_cols(FULL['sales'])} FROM brand_sales_panel")
def _(t: Tables):
    df = readers.read_panel(t.spark, readers.find_panels(t.spark, _write_panels(t))["sales"], _panel_schema("sales"))
    return portable(df, names(FULL["sales"]))


_LAYER = ("StockCode", "month", "revenue_total", "fatigue_label")
_LAYER_SQL = f"SELECT \"StockCode\", strftime(month, '%Y-%m-%d') AS month, {r6('revenue_total', 4)} AS revenue_total, fatigue_label FROM brand_sales_panel"


@query("s7_feature_layer_or_csv", _LAYER_SQL)
def _(t: Tables):
    base = scratch_path(t.spark, "layer")
    sinks.write_csv(t.labelled("sales", "brand").select(*_LAYER), f"{base}.csv")
    schema = "StockCode string, month date, revenue_total double, fatigue_label string"
    return portable(readers.read_features(t.spark, base, schema), digits=4)


@query("s8_partitioned_feature_layer", _LAYER_SQL)
def _(t: Tables):
    base = scratch_path(t.spark, "features")
    sinks.write_features(t.labelled("sales", "brand").select(*_LAYER), base)
    df = readers.read_features(t.spark, base)
    return portable(df.select(*_LAYER), digits=4)


@query("s9_panel_csv_export", """
SELECT "ProductId", strftime(month, '%Y-%m') AS month, review_count, fatigue_label FROM brand_reviews_panel""")
def _(t: Tables):
    folder = scratch_path(t.spark, "export")
    path = sinks.write_panel(t.labelled("reviews", "brand").select(*names(FULL["reviews"])), folder, "reviews")
    df = t.spark.read.schema(_panel_schema("reviews")).option("header", True).csv(path)
    return df.select("ProductId", "month", "review_count", "fatigue_label")


@query("s10_summary_export", f"""
SELECT 'Sales' AS dataset, {', '.join(r6(f"avg((fatigue_label = '{c}')::INT) * 100") + f' AS {n}' for n, c in (
    ('high_rate', specs.HIGH), ('moderate_rate', specs.MODERATE), ('healthy_rate', specs.HEALTHY)))} FROM brand_sales_panel""")
def _(t: Tables):
    rates = summaries.class_rates(t.labelled("sales", "brand")).select(F.lit("Sales").alias("dataset"), "*")
    path = sinks.write_summary(rates, scratch_path(t.spark, "rates"))
    schema = "dataset string, high_rate double, moderate_rate double, healthy_rate double"
    return portable(t.spark.read.schema(schema).option("header", True).csv(path))


@query("s11_event_sample_export", f"""
SELECT event_id, event_type FROM (SELECT event_id, event_type FROM events
  ORDER BY {sql_bucket('event_id', 4294967296)}, event_id LIMIT 100000)""")
def _(t: Tables):
    path = scratch_path(t.spark, "sample")
    sinks.export_event_sample(t["events"].select("event_id", "event_type"), ["event_id"], path)
    return t.spark.read.schema("event_id bigint, event_type string").option("header", True).csv(path)


@query("s12_combined_sample_export", f"""
SELECT event_id, event_type, {r6('value')} AS value FROM events WHERE {sql_bucket('event_id', 1000)} < 100""")
def _(t: Tables):
    path = scratch_path(t.spark, "fraction")
    sinks.export_fraction(t["events"].select("event_id", "event_type", "value"), "event_id", path)
    return portable(t.spark.read.schema("event_id bigint, event_type string, value double").option("header", True).csv(path))


_METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "balanced_accuracy")


@query("s13_metrics_json", "SELECT n, " + ", ".join(f"{r6(c)} AS {c}" for c in _METRICS) + " FROM usage_scored_report")
def _(t: Tables):
    path = sinks.write_metrics(metrics.evaluate(scored(t, "usage")), scratch_path(t.spark, "metrics"))
    schema = "n bigint, " + ", ".join(f"{c} double" for c in _METRICS)
    return portable(t.spark.read.schema(schema).json(path))


fragment("monthly_runs_scored", "SELECT *, strftime(month, '%Y-%m-%d') AS run FROM brand_sales_scored")


def monthly_runs(t: Tables):
    """Evaluation of the pseudo-probabilities in every month, in run-log shape."""
    df = scored(t, "sales", "brand").withColumn("timestamp", F.date_format("month", "yyyy-MM-dd"))
    table = metrics.evaluate(df, ["timestamp", "lifecycle_stage"])
    kinds = dict(specs.RUN_LOG_COLUMNS)
    known = {
        "modality": F.lit("sales"), "model": F.col("lifecycle_stage"), "n_test": F.col("n"),
        "test_f1": F.col("f1_macro"), "balanced_accuracy": F.col("balanced_accuracy"),
        "macro_recall": F.col("recall_macro"), "timestamp": F.col("timestamp"),
    }
    return table.select(*[
        known.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in runs.COLUMNS
    ])


def run_log(t: Tables):
    path = scratch_path(t.spark, "runs")
    log = monthly_runs(t)
    old = log.where(F.col("timestamp") < "1999-01-01").drop("calibrated_ece", "raw_ece")
    runs.append(old, path)
    runs.append(log.where(F.col("timestamp") >= "1999-01-01"), path)
    return runs.read(t.spark, path)


class_fragments("monthly_runs_scored", "run, lifecycle_stage")


@query("s14_run_log", f"""
SELECT run AS timestamp, lifecycle_stage AS model, n AS n_test, {r6('f1_macro')} AS test_f1, {r6('balanced_accuracy')} AS balanced_accuracy
FROM monthly_runs_scored_report""")
def _(t: Tables):
    return portable(run_log(t).select("timestamp", "model", "n_test", "test_f1", "balanced_accuracy"))


_COMPARE = f"""
SELECT timestamp, model, {r6('test_f1')} AS test_f1, test_f1 = max(test_f1) OVER (PARTITION BY model) AS is_best FROM (
  SELECT run AS timestamp, lifecycle_stage AS model, round(f1_macro, 9) AS test_f1 FROM monthly_runs_scored_report
  ORDER BY timestamp DESC, model LIMIT {{n}})"""


@query("w13_best_run_marker", _COMPARE.format(n=100))
def _(t: Tables):
    log = monthly_runs(t).withColumn("test_f1", F.round("test_f1", 9))
    return portable(runs.compare(log, 100).select("timestamp", "model", "test_f1", "is_best"))


@query("r14_run_comparison", _COMPARE.format(n=30))
def _(t: Tables):
    log = run_log(t).withColumn("test_f1", F.round("test_f1", 9))
    return portable(runs.compare(log, 30).select("timestamp", "model", "test_f1", "is_best"))


def training_log(t: Tables):
    """The runs of the training and fusion queries, each committed once."""
    path = learning.kept(t, "run-log", lambda: scratch_path(t.spark, "training-runs"))
    p = learning.prepared(t)
    size = {"n_features": len(p.features), "n_train": p.train.count(), "n_test": p.test.count()}
    for row in learning.trained(t)[1].collect():
        run = {
            "modality": "sales", "model": row["model"], "cv_f1": row["cv_f1"], "test_f1": row["test_f1"],
            "balanced_accuracy": row["balanced_accuracy"], "macro_recall": row["macro_recall"], "best_params": {"params": row["params"]}, **size,
        }
        runs.append(runs.run_rows(t.spark, [run]), path, f"sales-{row['model']}")
    for kind, score in learning.fused(t).cv_f1.items():
        runs.append(runs.run_rows(t.spark, [{"modality": "fusion", "model": kind, "cv_f1": float(score)}]), path, f"fusion-{kind}")
    return runs.read(t.spark, path)


@query("s14_logged_training_runs")
def _(t: Tables):
    return portable(training_log(t).select("modality", "model", "n_features", "n_train", "n_test", "cv_f1", "test_f1", "cv_test_gap", "balanced_accuracy"))


@query("r14_compared_training_runs")
def _(t: Tables):
    return portable(runs.compare(training_log(t), 30, "model").select("modality", "model", "cv_f1", "test_f1", "is_best"))


@query("x23_model_status")
def _(t: Tables):
    return portable(runs.status(training_log(t)))


@query("s16_model_store")
def _(t: Tables):
    p = learning.prepared(t)
    base = scratch_path(t.spark, "models")
    scorer = learning.scorer(t)
    store.save_classifier(t.spark, scorer.classifier, f"{base}/sales")
    store.save_calibrator(t.spark, scorer.calibrator, f"{base}/calibrated")
    store.save_fusion(t.spark, learning.fused(t), f"{base}/fusion")
    loaded = store.load_classifier(t.spark, f"{base}/sales", len(p.features))
    calibrator = store.load_calibrator(t.spark, f"{base}/calibrated")
    again = calibrator.apply(loaded.predict(p.test))
    fused = store.load_fusion(t.spark, f"{base}/fusion").predict(learning.fusion_table(t))
    fused = fused.agg(F.count("*")).scalar()
    return portable(again.groupBy("pred").agg(
        F.count("*").alias("n_rows"), F.avg(F.get("calibrated", F.lit(0))).alias("mean_probability"),
    ).withColumn("n_fused", fused))


@query("s3_chunked_stream_ingest", """
SELECT event_type, count(*) AS n_rows, sum(product_id)::BIGINT AS product_total FROM usage_valid GROUP BY ALL""")
def _(t: Tables):
    from ebbtide.streaming import ingest

    path = usage_csv(t, t.usage_log(), "stream-in")
    target = scratch_path(t.spark, "stream-out")
    wide = T.StructType([
        T.StructField(f.name, T.DoubleType() if f.name == "price" else f.dataType) for f in readers.USAGE_SCHEMA
    ])
    events = ingest.read_event_files(t.spark, path, wide, files_per_batch=3)
    ingest.ingest(events, target, scratch_path(t.spark, "stream-state")).awaitTermination()
    return t.spark.read.parquet(target).groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.sum("product_id").alias("product_total")
    )

