"""Complaint-shaped views over the generated test tables (see FIXTURES.md §3).

Every view reads whole tables; rules built on keys only shape values (inject
nulls, generic labels, a second snapshot), they never drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from .tables import table


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select("c_custkey", "c_mktsegment", "n_name", "r_name"))


def complaint_columns(o: DataFrame, geo: DataFrame) -> DataFrame:
    """orders ⋈ customer geography -> complaint columns (plus ``row_id``)."""
    k = F.col("o_orderkey")
    category = (F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED",
                       F.when(k % 3 == 0, F.lit(None).cast("string"))
                        .when(k % 3 == 1, F.lit(" Outros "))
                        .otherwise(F.lit("OUTRO")))
                 .otherwise(F.col("o_orderpriority")))
    sub = (F.when(F.col("o_orderstatus") != "P", F.col("c_mktsegment"))
             .when(k % 3 == 0, F.lit("OUTROS (DETALHAR)"))
             .when(k % 3 == 1, F.lit(None).cast("string"))
             .otherwise(F.lit("  ")))
    return (o.join(geo, o.o_custkey == geo.c_custkey)
             .select(k.alias("row_id"),
                     k.cast("string").alias(S.KEY),
                     category.alias(S.CATEGORY),
                     F.col("o_custkey").cast("string").alias(S.USER),
                     sub.alias(S.SUBCATEGORY),
                     F.concat(F.lit("pedido "), F.col("o_orderpriority"), F.lit(" situacao "),
                              F.col("o_orderstatus")).alias(S.TEXT),
                     F.when(k % 101 == 0, F.lit(None).cast("timestamp_ntz"))
                      .otherwise(F.col("o_orderdate")).alias(S.REGISTERED_AT),
                     F.col("n_name").alias(S.BRANCH),
                     F.col("r_name").alias(S.OPERATOR)))


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``complaints`` view: one row per order."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    return complaint_columns(o, _geo(spark, sf_dir))


# Second export of an overlapping period, with the column names a different system uses.
SOURCE1_NAMES = {S.KEY: "id", S.CATEGORY: "categoria", S.USER: "usuario",
                 S.SUBCATEGORY: "subcategoria", S.REGISTERED_AT: "Data Registro",
                 S.BRANCH: "unidade"}
SOURCE0_BEFORE = "2000-01-01"
SOURCE1_FROM = "1999-01-01"


def complaint_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two overlapping exports: source 0 = orders before 2000 (canonical names),
    source 1 = orders from 1999 on (other names, no OPERADORA). Together they cover
    every order; 1999 is in both."""
    geo = _geo(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    s0 = complaint_columns(o.filter(F.col("o_orderdate") < F.lit(SOURCE0_BEFORE).cast("timestamp_ntz")), geo)
    s1 = complaint_columns(o.filter(F.col("o_orderdate") >= F.lit(SOURCE1_FROM).cast("timestamp_ntz")), geo)
    s1 = s1.drop(S.OPERATOR).withColumnsRenamed(SOURCE1_NAMES)
    return [s0, s1]


def complaints_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complaints(spark, sf_dir)


def complaints_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot after a relabelling: SUB_ASSUNTO containing OUTRO gets the customer's
    segment, keys ending in 0 keep it, keys ending in 5 get the unseen label NEW."""
    geo = _geo(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    base = complaint_columns(o, geo)
    seg = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("_cust"), F.col("c_mktsegment").alias("_seg"))
    k = F.col("row_id")
    outro = F.coalesce(F.upper(F.col(S.SUBCATEGORY)).contains("OUTRO"), F.lit(False))
    new_sub = (F.when(outro & (k % 10 == 0), F.col(S.SUBCATEGORY))
                .when(outro & (k % 10 == 5), F.lit("NEW"))
                .when(outro, F.col("_seg"))
                .otherwise(F.col(S.SUBCATEGORY)))
    return (base.join(seg, base[S.USER] == seg["_cust"], "left")
                .withColumn(S.SUBCATEGORY, new_sub).drop("_cust", "_seg"))


def complaint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents ⟕ labels: text columns from the documents, labels from quality/toxic."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("row_id"),
        F.col("doc_id").cast("string").alias(S.KEY),
        F.when(F.col("toxic") == 1, "TOXIC").when(F.col("toxic") == 0, "CLEAN").alias(S.CATEGORY),
        F.when(F.col("quality") == 1, "GOOD").when(F.col("quality") == 0, "POOR")
         .otherwise("OUTROS").alias(S.SUBCATEGORY),
        F.col("text").alias(S.TEXT),
        F.col("lang").alias("DS_MOTIVO"),
        F.col("source").alias(S.BRANCH))


def query_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a query-audit table."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("query_id"),
                    F.col("props").alias("query_text"),
                    F.col("event_type").alias("query_type"),
                    F.col("user_id").cast("string").alias("user"),
                    F.col("value").alias("response_time_ms"),
                    F.col("ts").alias("executed_at"))


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderdate rendered as dd/MM/yyyy, yyyy-MM-dd or the text 'n/a'."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    raw = (F.when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .otherwise(F.lit("n/a")))
    return o.select(k.cast("string").alias(S.KEY), raw.alias(S.REGISTERED_AT))


def vectors(spark: SparkSession, sf_dir: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """embeddings with a stratified 80/20 split (W10): ``is_test`` rows are the
    queries (their label kept as truth), the others the reference set."""
    from ..operators.sampling import stratified_split
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return stratified_split(e, "label", "vec_id", test_fraction, seed)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upload audit derived from orders: one upload per order day, loaded the
    next day, with that day's row count."""
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    day = F.to_date("o_orderdate")
    return (o.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("num_records"))
             .select(F.concat(F.lit("orders_"), F.date_format("d", "yyyyMMdd"), F.lit(".csv")).alias("filename"),
                     "num_records", F.lit("loader").alias("user"),
                     F.lit(None).cast("string").alias("metadata"),
                     F.date_add("d", 1).cast("timestamp_ntz").alias("uploaded_at")))


def streaming_complaint_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two exports of ``complaint_sources`` as file streams over orders
    (stream-static joins with the customer geography)."""
    schema = table(spark, sf_dir, "orders").schema
    o = (table_stream(spark, sf_dir, "orders", schema)
              .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    geo = _geo(spark, sf_dir)
    s0 = complaint_columns(o.filter(F.col("o_orderdate") < F.lit(SOURCE0_BEFORE).cast("timestamp_ntz")), geo)
    s1 = complaint_columns(o.filter(F.col("o_orderdate") >= F.lit(SOURCE1_FROM).cast("timestamp_ntz")), geo)
    return [s0, s1.drop(S.OPERATOR).withColumnsRenamed(SOURCE1_NAMES)]


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema=None) -> DataFrame:
    """A file stream over one table of a folder (the file source watches folders;
    ``pathGlobFilter`` keeps it to this table's files)."""
    schema = schema or table(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                 .parquet(sf_dir.rstrip("/")))
