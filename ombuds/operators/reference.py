"""Stored, bounded reference sets for neighbour labelling.

F4 (rows with a valid label; for categories also enough text) -> P7 (composite text, whole) ->
W8 (stratified draw of at most about ``max_rows``, a documented parameter) -> an encoder fitted on
the references only -> one Parquet table ``(ref_id, label, texto, embedding)`` and one metadata row.
The encoder's state lies beside them, so later batches are encoded alike whatever they hold.

A build writes a new version folder and publishes it at the end by creating one empty marker,
``published/<number>_<version>``. The marker with the largest name is the current version, so
readers see a whole set or the one before, whatever becomes of a build; a version that was loaded
stays as it is until ``prune`` removes it.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..functions import text as X
from . import features, sampling
from .knn import unit_rows

MAX_ROWS = 5000
#: Largest matrix that is broadcast, checked against the metadata before anything is collected.
MAX_MATRIX_BYTES = 256 << 20

METADATA = T.StructType([
    T.StructField("label_column", T.StringType()), T.StructField("total_records", T.LongType()),
    T.StructField("original_dataset_size", T.LongType()), T.StructField("used_stratified_sample", T.BooleanType()),
    T.StructField("embedding_model", T.StringType()), T.StructField("embedding_dimension", T.IntegerType()),
    T.StructField("categories", T.MapType(T.StringType(), T.LongType())), T.StructField("encoder", T.StringType())])


class ReferenceSet:
    """One version of a stored reference set: its table, metadata row and fitted encoder."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.path, self.version = path, version
        folder = f"{path}/{version}"
        self.table = spark.read.parquet(f"{folder}/rows")
        self.metadata = spark.read.schema(METADATA).parquet(f"{folder}/metadata")
        self.meta = self.metadata.first()
        self.encoder = features.load_encoder(spark, f"{folder}/encoder", json.loads(self.meta.encoder))
        self.ref_type = self.table.schema["ref_id"].dataType

    def _checked(self) -> None:
        size = self.meta.total_records * self.meta.embedding_dimension * 8
        if size > MAX_MATRIX_BYTES:
            raise ValueError(f"{self.meta.total_records} references make a matrix of {size} bytes, over "
                             f"{MAX_MATRIX_BYTES}; use similarity_topk for references without a bound")

    def arrays(self) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(ids, labels, unit rows), by id; the size is checked first."""
        self._checked()
        t = self.table.select("ref_id", F.col("label").cast("string").alias("label"), "embedding").orderBy("ref_id").toArrow()
        ids, labels = t.column("ref_id").combine_chunks(), t.column("label").combine_chunks()
        rows = t.column("embedding").to_numpy()
        return ids, labels, unit_rows(rows) if len(rows) else np.zeros((0, self.meta.embedding_dimension))

    def snippets(self, chars: int = S.SNIPPET_CHARS) -> list[str]:
        """First characters of each text, by id."""
        self._checked()
        t = self.table.select("ref_id", F.substring("texto", 1, chars).alias("t")).orderBy("ref_id").toArrow()
        return [(x or "") + S.SNIPPET_SUFFIX for x in t.column("t").to_pylist()]


def _files(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _markers(spark: SparkSession, path: str) -> list[str]:
    folder, fs = _files(spark, f"{path}/published")
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(n for n in names if n[0].isdigit())


def versions(spark: SparkSession, path: str) -> list[str]:
    """Published versions, the current one last."""
    return [m.split("_", 1)[1] for m in _markers(spark, path)]


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Make a written version the current one: one file is created, none is replaced. Of two builds that
    publish at once the one with the larger name is current, the other stays loadable by name."""
    last = _markers(spark, path)[-1:]
    number = int(last[0].split("_", 1)[0]) + 1 if last else 0
    marker, fs = _files(spark, f"{path}/published/{number:010d}_{version}")
    fs.create(marker, False).close()


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all published versions but the last ``keep``, each marker before its folder."""
    for m in _markers(spark, path)[:-max(1, keep)]:
        for name in (f"published/{m}", m.split("_", 1)[1]):
            target, fs = _files(spark, f"{path}/{name}")
            fs.delete(target, True)


def build_reference_set(df: DataFrame, label: str, path: str, encoder=None, key: str = S.KEY, sub: bool = False,
                        max_rows: int = MAX_ROWS, min_per_label: int = 10, max_chars: int | None = None,
                        text=None) -> ReferenceSet:
    """Build, store and publish a version of the reference set of one label column; returns it loaded."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    folder = f"{path}/{version}"
    encoder = encoder or features.HashedEncoder()
    texto = X.composite_text(df.columns, max_chars=max_chars) if text is None else text
    base = df.select(F.col(key).alias("ref_id"), F.col(label).alias("label"), texto.alias("texto"))
    valid = sampling.valid_training_rows(base, "texto", "label", sub)
    drawn = (sampling.stratified_sample_b(valid, "label", "ref_id", max_rows) if sub
             else sampling.stratified_sample_a(valid, "label", "ref_id", max_rows, min_per_label))
    drawn.write.parquet(f"{folder}/drawn")
    drawn = spark.read.schema(drawn.schema).parquet(f"{folder}/drawn")
    fitted = encoder.fit(drawn, "texto")
    fitted.save(f"{folder}/encoder")
    fitted.encode(drawn, "texto", "embedding").select("ref_id", "label", "texto", "embedding") \
          .write.parquet(f"{folder}/rows")
    counts = {r.label: r.n for r in drawn.groupBy(F.col("label").cast("string").alias("label"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    size = valid.count()
    row = [(label, sum(counts.values()), size, size > max_rows, fitted.name, fitted.dims, counts,
            json.dumps(fitted.state()))]
    spark.createDataFrame(row, METADATA).coalesce(1).write.parquet(f"{folder}/metadata")
    publish(spark, path, version)
    return ReferenceSet(spark, path, version)


def load_reference_set(spark: SparkSession, path: str, version: str | None = None) -> ReferenceSet:
    """A stored reference set, the current version or a named one."""
    found = versions(spark, path)
    if not found or version not in (None, *found):
        raise FileNotFoundError(f"no published reference set {version or ''} below {path}")
    return ReferenceSet(spark, path, version or found[-1])
