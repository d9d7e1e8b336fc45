"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads whole test tables through the fixture views and runs library
operators; the DuckDB twin of each lives in ``oracle.SQL`` under the same name.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import temporal as T
from ..functions import text as X
from ..operators import audit, dedupe, sampling
from ..streaming import ingest as sstream
from ..operators import (autolabel, compare, evaluate, features, forest, knn, knn_index, kpi, quality, ranking,
                         reference, temporal)
from ..session import shared_dir, written
from ..sinks import report
from ..sources.tables import table
from ..sources import fixtures as fx
from ..sources import ingest, store
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    """Register a query. The wrapper pins the session time zone to UTC: week and
    month keys and elapsed days are defined on UTC wall-clock time."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# ---- periods ---------------------------------------------------------------
@register("monthly_counts")
def q_monthly_counts(spark, sf):
    return temporal.monthly_counts(fx.complaints(spark, sf))


@register("monthly_counts_report")
def q_monthly_counts_report(spark, sf):
    return temporal.monthly_counts(fx.complaints(spark, sf), keep_null=True)


@register("weekly_counts")
def q_weekly_counts(spark, sf):
    return temporal.weekly_counts(fx.complaints(spark, sf))


@register("monthly_change")
def q_monthly_change(spark, sf):
    return temporal.monthly_change(fx.complaints(spark, sf))


@register("last_two_months")
def q_last_two_months(spark, sf):
    return temporal.last_two_months(fx.complaints(spark, sf))


@register("last_two_weeks")
def q_last_two_weeks(spark, sf):
    return temporal.last_two_weeks(fx.complaints(spark, sf))


@register("top5_weekly")
def q_top5_weekly(spark, sf):
    return temporal.top5_weekly(fx.complaints(spark, sf))


@register("top5_monthly_steps")
def q_top5_monthly_steps(spark, sf):
    return temporal.top5_monthly_steps(fx.complaints(spark, sf))


@register("period_top5_nested")
def q_period_top5_nested(spark, sf):
    return temporal.period_top5_nested(fx.complaints(spark, sf))


@register("peak_weeks")
def q_peak_weeks(spark, sf):
    return temporal.peak_weeks(fx.complaints(spark, sf))


# ---- rankings ----------------------------------------------------------------
@register("category_ranking")
def q_category_ranking(spark, sf):
    return ranking.category_ranking(fx.complaints(spark, sf))


@register("category_ranking_specific")
def q_category_ranking_specific(spark, sf):
    return ranking.category_ranking(fx.complaints(spark, sf), drop_generic=True)


@register("subcategory_ranking")
def q_subcategory_ranking(spark, sf):
    return ranking.subcategory_ranking(fx.complaints(spark, sf))


@register("subcategory_ranking_specific")
def q_subcategory_ranking_specific(spark, sf):
    return ranking.subcategory_ranking(fx.complaints(spark, sf), drop_generic=True)


@register("subcategory_top10")
def q_subcategory_top10(spark, sf):
    return ranking.subcategory_ranking(fx.complaints(spark, sf), top=10)


@register("branch_ranking")
def q_branch_ranking(spark, sf):
    return ranking.branch_ranking(fx.complaints(spark, sf))


@register("operator_ranking")
def q_operator_ranking(spark, sf):
    return ranking.operator_ranking(fx.complaints(spark, sf))


# ---- key figures ---------------------------------------------------------------
@register("kpi_row")
def q_kpi_row(spark, sf):
    return kpi.kpi_row(fx.complaints(spark, sf))


@register("kpi_row_filtered")
def q_kpi_row_filtered(spark, sf):
    df = kpi.date_filter(fx.complaints(spark, sf), dt.date.fromisoformat(oracle.KPI_FILTER_START),
                         dt.date.fromisoformat(oracle.KPI_FILTER_END))
    df = kpi.membership_filter(df, branches=oracle.KPI_FILTER_BRANCHES)
    return kpi.kpi_row(df)


@register("kpi_row_partitioned")
def q_kpi_row_partitioned(spark, sf):
    """F1 + A7 on complaints stored by month."""
    t = fx.complaints(spark, sf)
    path = shared_dir(spark, f"months-{uuid.uuid4().hex}")
    store.write_months(t, path)
    return kpi.kpi_row(store.read_months(spark, path, t.schema, dt.date.fromisoformat(oracle.KPI_FILTER_START),
                                         dt.date.fromisoformat(oracle.KPI_FILTER_END)))


@register("unclassified_counters")
def q_unclassified_counters(spark, sf):
    return kpi.unclassified_counters(fx.complaints(spark, sf))


@register("classification_stats")
def q_classification_stats(spark, sf):
    return kpi.classification_stats(fx.complaints(spark, sf))


# ---- ingest and quality ------------------------------------------------------------
def _sources(spark, sf):
    return fx.complaint_sources(spark, sf)


@register("dedupe_keep_first")
def q_dedupe_keep_first(spark, sf):
    return ingest.ingest(_sources(spark, sf))


@register("ingest_stats")
def q_ingest_stats(spark, sf):
    return ingest.ingest_stats(_sources(spark, sf))


@register("quality_issues")
def q_quality_issues(spark, sf):
    return quality.quality_issues(ingest.concat_sources(_sources(spark, sf)))


@register("training_profile")
def q_training_profile(spark, sf):
    return quality.training_profile(fx.complaints(spark, sf))


@register("date_coercion")
def q_date_coercion(spark, sf):
    d = fx.date_strings(spark, sf)
    return d.select(S.KEY, F.col(S.REGISTERED_AT).alias("raw"),
                    T.parse_timestamp(S.REGISTERED_AT).alias(S.REGISTERED_AT))


# ---- nearest-neighbour labelling on vectors ------------------------------------------
SWEEP = [0.26, 0.30, 0.33, 0.35, 0.38, 0.40, 0.45]
FILL_THRESHOLD = 0.35
PARTIAL_N = 40
SAMPLE_TOTAL = 5000
AUDIT_HOURS = 24


def _knn(spark, sf, k=5):
    v = fx.vectors(spark, sf)
    q = v.where("is_test")
    r = v.where("NOT is_test")
    return v, knn.similarity_topk(q, r, k=k, query_id="vec_id", query_vec="embedding",
                                  ref_id="vec_id", ref_vec="embedding", ref_label="label")


def _predictions(spark, sf):
    v, top = _knn(spark, sf)
    votes = knn.vote(top, FILL_THRESHOLD)
    truth = v.where("is_test").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"))
    return truth.join(votes, "query_id", "left")


@register("knn_topk")
def q_knn_topk(spark, sf):
    _, top = _knn(spark, sf)
    return top.withColumn("similarity", F.round("similarity", 6))


@register("knn_vote")
def q_knn_vote(spark, sf):
    _, top = _knn(spark, sf)
    return knn.vote(top, FILL_THRESHOLD).select(
        "query_id", "predicted", F.round("score", 6).alias("score"), "votes",
        F.round("confidence", 6).alias("confidence"), "accepted", "method")


@register("knn_fill")
def q_knn_fill(spark, sf):
    v, top = _knn(spark, sf)
    hidden = v.select("vec_id", F.when(F.col("is_test"), F.lit(None)).otherwise(F.col("label")).alias("label"),
                      "is_test")
    return autolabel.write_back(
        hidden,
        knn.vote(top, FILL_THRESHOLD).withColumnRenamed("query_id", "vec_id"),
        key="vec_id", label="label", needs=F.col("is_test")).drop("is_test")


@register("knn_nearest")
def q_knn_nearest(spark, sf):
    _, top = _knn(spark, sf, k=1)
    return knn.nearest(top, FILL_THRESHOLD).withColumn("confidence", F.round("confidence", 6))


@register("knn_run_counts")
def q_knn_run_counts(spark, sf):
    _, top = _knn(spark, sf)
    return knn.run_counts(knn.vote(top, FILL_THRESHOLD))


@register("threshold_accuracy")
def q_threshold_accuracy(spark, sf):
    return evaluate.threshold_accuracy(_predictions(spark, sf), SWEEP)


@register("confusion_pairs")
def q_confusion_pairs(spark, sf):
    return evaluate.confusion_pairs(_predictions(spark, sf), FILL_THRESHOLD)


@register("best_threshold")
def q_best_threshold(spark, sf):
    return evaluate.best_threshold(evaluate.threshold_accuracy(_predictions(spark, sf), SWEEP))


@register("split_80_20")
def q_split_80_20(spark, sf):
    return fx.vectors(spark, sf).select("vec_id", "label", "is_test")


@register("partial_relabel_topn")
def q_partial_relabel_topn(spark, sf):
    v, top = _knn(spark, sf)
    hidden = v.select("vec_id", F.when(F.col("is_test"), F.lit(None)).otherwise(F.col("label")).alias("label"))
    pred = knn.vote(top, FILL_THRESHOLD).select(F.col("query_id").alias("vec_id"), "predicted",
                                                 F.round("confidence", 6).alias("confidence"))
    return forest.relabel(hidden, pred, key="vec_id", label="label", top_n=PARTIAL_N)


@register("partial_relabel_firstn")
def q_partial_relabel_firstn(spark, sf):
    """k = 3; the reference's threshold is 0.50, which these vectors never reach."""
    v, top = _knn(spark, sf, k=3)
    hidden = v.select("vec_id", F.when(F.col("is_test"), F.lit(None)).otherwise(F.col("label")).alias("label"))
    pred = knn.vote(top, FILL_THRESHOLD).select(F.col("query_id").alias("vec_id"), "predicted",
                                                 F.round("confidence", 6).alias("confidence"), "accepted")
    return forest.relabel(hidden, pred, key="vec_id", label="label", first_n=PARTIAL_N)


# ---- before / after ----------------------------------------------------------------------
def _snapshots(spark, sf):
    return fx.complaints_before(spark, sf), fx.complaints_after(spark, sf)


@register("before_after")
def q_before_after(spark, sf):
    b, a = _snapshots(spark, sf)
    return compare.before_after(b, a)


@register("before_after_totals")
def q_before_after_totals(spark, sf):
    b, a = _snapshots(spark, sf)
    return compare.before_after_totals(compare.before_after(b, a))


@register("reclassified_distribution")
def q_reclassified_distribution(spark, sf):
    b, a = _snapshots(spark, sf)
    return compare.reclassified_distribution(b, a)


@register("remaining_outros")
def q_remaining_outros(spark, sf):
    b, a = _snapshots(spark, sf)
    return compare.remaining_outros({"before": b, "after": a})


@register("outros_variants")
def q_outros_variants(spark, sf):
    return compare.outros_variants(fx.complaints_before(spark, sf))


# ---- text ---------------------------------------------------------------------------------
@register("composite_text")
def q_composite_text(spark, sf):
    t = fx.complaint_texts(spark, sf)
    txt = X.composite_text(t.columns)
    return t.select(S.KEY, txt.alias("texto"), X.enough_text(txt).alias("enough_text"))


@register("label_normalised")
def q_label_normalised(spark, sf):
    c = fx.complaints(spark, sf)
    return c.select(S.KEY, S.CATEGORY, X.normalize_label(S.CATEGORY).alias("normalised"))


@register("needs_flags")
def q_needs_flags(spark, sf):
    return quality.needs_flags(fx.complaints(spark, sf))


@register("tfidf_terms")
def q_tfidf_terms(spark, sf):
    t = fx.complaint_texts(spark, sf)
    train, _ = forest.split_for_training(t, S.SUBCATEGORY)
    docs = train.select("row_id", X.forest_text(t.columns).alias("_text"))
    return features.tfidf_vocabulary(docs, "_text", "row_id").withColumn("idf", F.round("idf", 6))


# ---- encoders, reference sets, labelling ----------------------------------------------------
# The md5 encoder's buckets can be computed by the twin's engine as well. Dimensions and the number
# of references are the operators' own.
LABEL_THRESHOLD = 0.5


def _reference(spark, sf, sub=False, name="reference"):
    t = fx.complaint_texts(spark, sf)
    path = shared_dir(spark, f"{name}-{uuid.uuid4().hex}")
    return reference.build_reference_set(t, S.SUBCATEGORY if sub else S.CATEGORY, path,
                                         features.Md5Encoder(), sub=sub)


@register("tfidf_vectors")
def q_tfidf_vectors(spark, sf):
    t = fx.complaint_texts(spark, sf)
    train, _ = forest.split_for_training(t, S.SUBCATEGORY)
    docs = train.select("row_id", X.forest_text(t.columns).alias("_text"))
    v = features.tfidf_vectors(docs, "_text", "row_id", features.tfidf_vocabulary(docs, "_text", "row_id"))
    return v.withColumn("weight", F.round("weight", 6))


@register("hashed_embeddings")
def q_hashed_embeddings(spark, sf):
    """M1 with the md5 encoder over whole texts, in long form."""
    t = fx.complaint_texts(spark, sf)
    t = t.select(S.KEY, X.composite_text(t.columns, max_chars=None).alias("_text"))
    v = features.Md5Encoder().fit(t, "_text").encode(t, "_text")
    return v.select(S.KEY, F.posexplode("vec").alias("bucket", "weight")).where("weight <> 0") \
        .withColumn("weight", F.round("weight", 6))


@register("reference_set")
def q_reference_set(spark, sf):
    """K5 then S5: the stored category references, read back."""
    ref = reference.load_reference_set(spark, _reference(spark, sf).path)
    return ref.table.select("ref_id", "label", "texto", F.posexplode("embedding").alias("bucket", "weight")) \
        .where("weight <> 0").withColumn("weight", F.round("weight", 6))


@register("reference_metadata")
def q_reference_metadata(spark, sf):
    m = _reference(spark, sf).metadata
    return m.select("label_column", "total_records", "original_dataset_size", "used_stratified_sample",
                    "embedding_model", "embedding_dimension", F.explode("categories").alias("label", "n"))


@register("autolabel_texts")
def q_autolabel_texts(spark, sf):
    out = autolabel.autolabel(fx.complaint_texts(spark, sf), encoder=features.Md5Encoder(),
                              threshold=LABEL_THRESHOLD)
    return out.select(S.KEY, S.CATEGORY, F.round("category_confidence", 6).alias("category_confidence"),
                      "category_method", "category_needs_review", S.SUBCATEGORY,
                      F.round("subcategory_confidence", 6).alias("subcategory_confidence"),
                      "subcategory_method", "subcategory_needs_review")


@register("probe_classify")
def q_probe_classify(spark, sf):
    probes = table(spark, sf, "benchmark")
    out = autolabel.classify_probes(probes, _reference(spark, sf), "text", "item_id", threshold=LABEL_THRESHOLD)
    return out.withColumns({"confianca": F.round("confianca", 6), "top_similares": F.array_join("top_similares", "|")})


@register("forest_relabel")
def q_forest_relabel(spark, sf):
    t = fx.complaint_texts(spark, sf)
    return forest.relabel(t, forest.forest_predict(t), candidates=X.has_outro(S.SUBCATEGORY)) \
        .select(S.KEY, S.SUBCATEGORY, "relabel_confidence")


FOREST_N = 50


@register("forest_invariants")
def q_forest_invariants(spark, sf):
    """M7, M8, A25 by what must hold of any forest: rows that were not 'outros' are unchanged, labels
    are training labels, the confidence lies in [1 / classes, 1], the partial form writes n rows."""
    t = fx.complaint_texts(spark, sf)
    pred = written(spark, forest.forest_predict(t), "forest-predictions")
    full = forest.relabel(t, pred, candidates=X.has_outro(S.SUBCATEGORY))
    part = forest.relabel(t, pred, top_n=FOREST_N, candidates=X.has_outro(S.SUBCATEGORY))
    before = t.select(F.col(S.KEY).alias("_k"), F.col(S.SUBCATEGORY).alias("_old"))
    j = full.join(before, F.col(S.KEY) == F.col("_k"))
    was = X.has_outro("_old")
    a = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(was).alias("n_outros"),
              F.count_if(~was & ~F.col("_old").eqNullSafe(F.col(S.SUBCATEGORY))).alias("changed_others"),
              F.count_if(was & ~F.col(S.SUBCATEGORY).isin("GOOD", "POOR")).alias("foreign_labels"),
              F.count_if(was & F.col("relabel_confidence").between(0.5, 1.0)).alias("confident"))
    s = forest.confidence_summary(pred).select(
        F.col("n").alias("n_predicted"), (F.col("min_confidence") <= F.col("mean_confidence")).alias("min_below_mean"),
        (F.col("mean_confidence") <= F.col("max_confidence")).alias("mean_below_max"))
    p = part.agg(F.count_if(F.col("relabel_confidence").isNotNull()).alias("written_partial"))
    return a.withColumns({c: s.select(c).scalar() for c in s.columns}).withColumn(
        "written_partial", p.select("written_partial").scalar())


@register("forest_confidence")
def q_forest_confidence(spark, sf):
    return forest.confidence_summary(forest.forest_predict(fx.complaint_texts(spark, sf)))


@register("label_distribution")
def q_label_distribution(spark, sf):
    return kpi.label_distribution(fx.complaints(spark, sf))


@register("valid_label_counts")
def q_valid_label_counts(spark, sf):
    return compare.valid_label_counts(fx.complaints(spark, sf))


# ---- sampling ------------------------------------------------------------------------------
@register("stratified_sample")
def q_stratified_sample(spark, sf):
    c = fx.complaints(spark, sf).where(~X.needs_category(S.CATEGORY))
    return sampling.stratified_sample_a(c, S.CATEGORY, "row_id", total=SAMPLE_TOTAL) \
        .select("row_id", S.KEY, S.CATEGORY)


@register("stratified_sample_b")
def q_stratified_sample_b(spark, sf):
    c = fx.complaints(spark, sf).where(~X.needs_subcategory(S.SUBCATEGORY))
    return sampling.stratified_sample_b(c, S.SUBCATEGORY, "row_id", total=SAMPLE_TOTAL) \
        .select("row_id", S.KEY, S.SUBCATEGORY)


@register("sample_fixed_n")
def q_sample_fixed_n(spark, sf):
    c = fx.complaints(spark, sf)
    return sampling.fixed_per_label(c, S.CATEGORY, "row_id", 25).select("row_id", S.KEY, S.CATEGORY)


@register("sample_200")
def q_sample_200(spark, sf):
    c = fx.complaints(spark, sf)
    return sampling.simple_sample(c, "row_id", 200).select("row_id", S.KEY, S.CATEGORY)


@register("sample_coverage")
def q_sample_coverage(spark, sf):
    c = fx.complaints(spark, sf).where(~X.needs_category(S.CATEGORY))
    s = sampling.stratified_sample_a(c, S.CATEGORY, "row_id", total=SAMPLE_TOTAL)
    return sampling.sample_coverage(c, s, S.CATEGORY)


# ---- audit ----------------------------------------------------------------------------------
@register("query_stats")
def q_query_stats(spark, sf):
    return audit.query_stats(fx.query_audit(spark, sf), hours=AUDIT_HOURS) \
        .withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@register("query_type_stats")
def q_query_type_stats(spark, sf):
    return audit.query_type_stats(fx.query_audit(spark, sf), hours=AUDIT_HOURS) \
        .withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


@register("upload_history")
def q_upload_history(spark, sf):
    return audit.upload_history(fx.uploads(spark, sf), 10)


@register("upload_log")
def q_upload_log(spark, sf):
    """K6: a log row for each day and status of the orders, appended in two uploads and read back."""
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"), "o_orderstatus")
    rows = o.groupBy("d", "o_orderstatus").agg(F.count("*").alias("num_records")).select(
        F.concat(F.lit("orders_"), F.date_format("d", "yyyyMMdd"), F.lit("_"), "o_orderstatus").alias("filename"),
        "num_records", F.lit("loader").alias("user"), F.date_add("d", 1).cast("timestamp_ntz").alias("uploaded_at"))
    path = shared_dir(spark, f"uploads-{uuid.uuid4().hex}")
    for part in (F.col("uploaded_at") < F.lit("1996-01-01"), F.col("uploaded_at") >= F.lit("1996-01-01")):
        audit.append_uploads(rows.where(part), path)
    return spark.read.schema(audit.UPLOAD_SCHEMA).parquet(path).select("filename", "num_records", "user", "uploaded_at")


@register("query_log")
def q_query_log(spark, sf):
    """K7 then A26: a log row for each day and type of the events, appended and read back."""
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d"), F.col("event_type").alias("query_type")).agg(
        F.count("*").cast("double").alias("response_time_ms"), F.max("ts").alias("executed_at"))
    path = shared_dir(spark, f"queries-{uuid.uuid4().hex}")
    audit.append_queries(rows.withColumn("query_text", F.date_format("d", "yyyy-MM-dd")), path)
    return audit.query_type_stats(spark.read.schema(audit.QUERY_SCHEMA).parquet(path), hours=24 * 366) \
        .withColumn("avg_response_time_ms", F.round("avg_response_time_ms", 6))


# ---- sinks ------------------------------------------------------------------------------------
@register("export_json")
def q_export_json(spark, sf):
    """K3: written as JSON lines, read back."""
    c = fx.complaints(spark, sf).select(S.KEY, S.CATEGORY, S.REGISTERED_AT)
    path = shared_dir(spark, f"json-{uuid.uuid4().hex}")
    report.export_json(c, path)
    return spark.read.schema(f"{S.KEY} string, {S.CATEGORY} string, {S.REGISTERED_AT} string").json(path)


@register("report_export")
def q_report_export(spark, sf):
    """K4: the report sections written as CSV, the category summary read back."""
    path = shared_dir(spark, f"report-{uuid.uuid4().hex}")
    paths = report.export_report(fx.complaints(spark, sf), path, "csv")
    return spark.read.option("header", True).schema("rank int, label string, n long, share_pct double") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .csv(paths["category_summary"])


# ---- streaming --------------------------------------------------------------------------------
@register("stream_weekly_counts")
def q_stream_weekly_counts(spark, sf):
    """R2 over a landing folder of three files that arrive newest dates first."""
    e = table(spark, sf, "events").select("ts", "event_type")
    land = shared_dir(spark, f"landing-{uuid.uuid4().hex}")
    day = F.dayofmonth("ts")
    for part in (day > 20, (day > 10) & (day <= 20), day <= 10):
        e.where(part).coalesce(1).write.mode("append").parquet(land)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(land)
    return sstream.stream_weekly_counts(spark, stream, "ts", "event_type")


@register("stream_dedupe")
def q_stream_dedupe(spark, sf):
    """R1, run twice on one checkpoint: the second run finds no new files."""
    run = uuid.uuid4().hex
    for _ in range(2):
        srcs = [ingest.harmonise(s, i) for i, s in enumerate(fx.streaming_complaint_sources(spark, sf))]
        out = sstream.stream_dedupe(spark, srcs, run_id=run)
    return out.select(S.KEY, S.CATEGORY, S.USER, S.SUBCATEGORY, S.REGISTERED_AT, S.BRANCH)


def _exports(spark, sf):
    """The two sources as users' exports: no row identity, texts with separators, quotes and line
    breaks, and in the first file repeated keys of which the later rows differ."""
    s0, s1 = _sources(spark, sf)
    note = F.concat(F.lit('obs "'), F.col("row_id").cast("string"), F.lit('"; a,b'),
                    F.when(F.col("row_id") % 7 == 0, F.lit("\nsegunda linha")).otherwise(F.lit("")))
    s0 = s0.withColumn(S.TEXT, note)
    again = s0.where(F.col("row_id") % 5 == 0).withColumn(S.TEXT, F.lit("repetido"))
    return s0, again, s1


#: Rows of one file of an export, some 50 MB.
EXPORT_ROWS = 400_000


@register("csv_ingest")
def q_csv_ingest(spark, sf):
    """K2/K1 then S1 + S4: exports as CSV (';' ISO-8859-1 and ',' UTF-8), one path a prefix of the
    other, sniffed, read back, mapped, parsed, de-duplicated by their place in the file."""
    from ..sources import csv as C
    s0, again, s1 = _exports(spark, sf)
    base = shared_dir(spark, f"csv_ingest_{uuid.uuid4().hex}")
    a, b = f"{base}/export1", f"{base}/export10"
    # the parts of a union follow each other, so the repeated rows lie behind the others; line breaks in
    # quotes keep a file from being read in splits, so files are bounded
    C.write_csv(s0.unionByName(again).drop("row_id"), a, sep=";", encoding="ISO-8859-1", max_rows=EXPORT_ROWS)
    C.write_csv(s1.drop("row_id"), b, sep=",", encoding="UTF-8")
    parts = [p.drop("_file") for p in C.read_sniffed(spark, [a, b])]
    return ingest.ingest(parts).drop("row_id")


@register("distinct_categories")
def q_distinct_categories(spark, sf):
    return dedupe.distinct_values(fx.complaints(spark, sf), S.CATEGORY)


@register("csv_mixed_headers")
def q_csv_mixed_headers(spark, sf):
    """Files of one folder with two column orders, other column names, another separator and
    a missing column; each header is mapped alone."""
    from ..sources import csv as C
    from ..sources.columns import map_columns
    c = fx.complaints(spark, sf).select("row_id", S.KEY, S.CATEGORY, S.BRANCH)
    base = shared_dir(spark, f"csv_headers_{uuid.uuid4().hex}")
    part = [c.where(F.col("row_id") % 3 == i).drop("row_id") for i in range(3)]
    C.write_csv(part[0], base, ";", "ISO-8859-1", mode="append")
    C.write_csv(part[1].select(F.col(S.BRANCH).alias("unidade"), F.col(S.CATEGORY).alias("categoria"),
                               F.col(S.KEY).alias("id")), base, ";", "ISO-8859-1", mode="append")
    C.write_csv(part[2].select(S.CATEGORY, S.KEY), base, ",", "UTF-8", mode="append")
    return C.read_sniffed(spark, [base], rename=map_columns)[0].select(S.KEY, S.CATEGORY, S.BRANCH)


@register("csv_bad_rows")
def q_csv_bad_rows(spark, sf):
    """Lines of a fixed dialect, short ones kept, long ones in quarantine with the reason,
    separators in quotes kept; good rows and quarantine in one result."""
    from ..sources import csv as C
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = (F.when(k % 7 == 0, F.concat_ws(";", k, F.lit("nota")))
            .when(k % 11 == 0, F.concat_ws(";", k, F.lit("nota"), status, F.lit("sobra")))
            .when(k % 5 == 0, F.concat(k, F.lit(';"nota; com ""aspas""";'), status))
            .otherwise(F.concat_ws(";", k, F.lit("nota"), status)))
    base = shared_dir(spark, f"csv_bad_{uuid.uuid4().hex}")
    table(spark, sf, "orders").select(line.alias("value")).write.text(f"{base}/in")
    good, bad = C.ingest_fixed(spark, f"{base}/in", ["id", "nota", "situacao"], f"{base}/out", encoding="UTF-8", header=False)
    return good.select("id", "nota", "situacao").unionByName(bad.select("raw_line", "reason"), allowMissingColumns=True)


@register("knn_pruned")
def q_knn_pruned(spark, sf):
    """J1 over the metric index: the rows of knn_topk."""
    v = fx.vectors(spark, sf)
    top, _ = knn_index.topk(v.where("is_test"), v.where("not is_test"), query_id="vec_id", query_vec="embedding",
                            ref_id="vec_id", ref_vec="embedding", ref_label="label")
    return top.withColumn("similarity", F.round("similarity", 6))


@register("stream_monthly_counts")
def q_stream_monthly_counts(spark, sf):
    """R2 by calendar month over a landing folder whose oldest file arrives last."""
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderstatus")
    land = shared_dir(spark, f"landing-{uuid.uuid4().hex}")
    year = F.year("o_orderdate")
    for part in (year > 1996, (year > 1994) & (year <= 1996), year <= 1994):
        o.where(part).write.mode("append").parquet(land)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(land)
    return sstream.stream_monthly_counts(spark, stream, "o_orderdate", "o_orderstatus")


@register("stream_dedupe_watermark")
def q_stream_dedupe_watermark(spark, sf):
    """R1 with bounded state: every event arrives again ten minutes later (dropped), those of the first
    five days once more after twenty days (new records)."""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts")
    run = uuid.uuid4().hex
    land = shared_dir(spark, f"landing-{run}")
    day = F.dayofmonth("ts")
    soon = e.unionAll(e.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 MINUTES")).select(*e.columns))
    late = e.where(day <= 5).withColumn("ts", F.col("ts") + F.expr("INTERVAL 20 DAYS")).select(*e.columns)
    of = e.select("event_id", day.alias("day")).distinct()
    soon = soon.join(of, "event_id").select(*e.columns, "day")
    for low, high in ((0, 10), (10, 20), (20, 31)):  # a part of any number of files, read as one batch when it has landed
        rows = soon.where((F.col("day") > low) & (F.col("day") <= high)).select(*e.columns)
        (rows.unionAll(late) if low == 20 else rows).write.mode("append").parquet(land)
        stream = spark.readStream.schema(e.schema).parquet(land)
        out = sstream.stream_dedupe_watermark(spark, stream, "event_id", "ts", run_id=run)
    return out.groupBy("event_id", "event_type").agg(F.count("*").alias("n"))
