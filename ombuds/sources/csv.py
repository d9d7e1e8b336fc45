"""CSV scans (S1-S3): header sniffing, fixed dialect with bad-row handling.

One row per file reaches the driver (its encoding, separator and quoting); the data
itself is read by Spark's CSV source in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Encodings tried in order (outer loop) and separators (inner loop).
SNIFF_ENCODINGS = ["utf-8", "latin1", "iso-8859-1", "cp1252"]
SNIFF_SEPARATORS = [";", ",", "\t"]
CORRUPT = "_corrupt_record"
JAVA_CHARSETS = {"utf-8": "UTF-8", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1"}


POSITION = "row_id"


def _plain(uri: str) -> str:
    """A path without scheme, host, percent signs and trailing slash."""
    parts = urlsplit(uri)
    return unquote(parts.path if parts.scheme else uri).rstrip("/")


def _separator(line: str) -> str:
    for sep in SNIFF_SEPARATORS:
        if len(line.split(sep)) > 1:
            return sep
    return ","


def sniff_files(spark: SparkSession, paths: list[str]) -> list[tuple]:
    """(input number, file, encoding, separator, multi-line, header line) of every data file below
    ``paths``.

    One distributed scan over all paths; one row per file reaches the driver. A file is UTF-8
    unless some byte is not valid UTF-8 (then latin-1, which accepts every byte). The separator is
    the first of ; , tab that splits the header line. A line with an odd number of quotes is
    part of a record that has a line break in quotes; only such files are read unsplit."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    line = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("f"),
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    rows = line.groupBy("f").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("bad"), F.bool_or(quotes % 2 == 1).alias("open"),
        F.min_by("value", "at").alias("header")).collect()
    roots = [_plain(p) for p in paths]
    out = []
    for r in rows:
        f = _plain(r.f)
        mine = [i for i, root in enumerate(roots) if f == root or f.startswith(root + "/")]
        of = max(mine, key=lambda i: len(roots[i])) if mine else 0
        out.append((of, r.f, "latin1" if r.bad else "utf-8", _separator(r.header or ""), bool(r.open),
                    (r.header or "").lstrip("\ufeff").rstrip("\r")))
    return sorted(out)


def sniff_header(spark: SparkSession, path: str) -> tuple[str, str]:
    return sniff_files(spark, [path])[0][2:4]


def position(file_numbers: dict[str, int]) -> Column:
    """Place of a row as decimal(33,0): file number, start of the block, place in the block.

    Row order in a file without counting rows: blocks are ordered by their first byte, and
    Spark numbers the rows of a task in order."""
    number = F.element_at(F.create_map(*(F.lit(x) for kv in file_numbers.items() for x in kv)),
                          F.col("_metadata.file_path"))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (number.cast("decimal(8,0)") * F.lit("1" + "0" * 25).cast("decimal(26,0)")
            + F.col("_metadata.file_block_start").cast("decimal(15,0)") * F.lit("1" + "0" * 10).cast("decimal(11,0)")
            + row.cast("decimal(10,0)")).cast("decimal(33,0)")


def read_sniffed(spark: SparkSession, paths: list[str],
                 rename: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """One all-STRING DataFrame per input path (a file or a folder of parts), in input order,
    with the file name (``_file``) and, unless the files have one, the row's place (``row_id``).

    Files of one dialect and one header line are read by one scan, which binds their columns by
    that header; the scans are united by column name, and a column that some files lack is null in
    their rows. ``rename`` (such as ``columns.map_columns``) sees each header alone, before the
    union, so that files of one folder may also name their columns differently. A quote in a quoted
    field is doubled. A file with line breaks in quotes is read by one task, so such files should
    be of at most a few GB each."""
    files = sniff_files(spark, paths)
    out = []
    for i in range(len(paths)):
        mine = [f for f in files if f[0] == i]
        numbers = {f[1]: n for n, f in enumerate(mine)}
        groups: dict[tuple, list[str]] = {}
        for f in mine:
            groups.setdefault(f[2:], []).append(f[1])
        part = None
        for (enc, sep, multi, _), names in sorted(groups.items()):
            df = (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
                  .option("encoding", JAVA_CHARSETS.get(enc, enc)).option("multiLine", multi)
                  .option("inferSchema", False).csv(names))
            cols = [F.col(f"`{c}`") for c in df.columns]
            if POSITION not in df.columns:
                cols.append(position(numbers).alias(POSITION))
            df = df.select(*cols, F.col("_metadata.file_path").alias("_file"))
            df = rename(df) if rename else df
            part = df if part is None else part.unionByName(df, allowMissingColumns=True)
        if part is not None:
            out.append(part)
    return out


def read_fixed(spark: SparkSession, paths: list[str] | str, columns: list[str],
               sep: str = ";", encoding: str = "ISO-8859-1",
               escape: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fixed dialect, PERMISSIVE. Short rows are padded with nulls (kept);
    rows with too many fields are rejected. Returns (good rows, rejected raw lines)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
              .schema(schema))
    reader = reader.option("escape", escape or '"').option("quote", '"')
    df = reader.csv(paths)
    df = df.withColumn("_too_many", _too_many(columns, sep, escape))
    good = df.where(~F.col("_too_many")).drop(CORRUPT, "_too_many")
    # parsed columns are kept next to the raw line (Spark refuses plans that read
    # the corrupt-record column alone)
    rejected = df.where(F.col("_too_many")).select(F.col(CORRUPT).alias("raw_line"), *columns)
    return good, rejected


def _n_fields(sep: str, escape: str | None) -> Column:
    """Fields of the raw line of a corrupt record."""
    # fields are counted outside quotes: a quoted part may hold separators
    quoted = '"([^"]|"")*"' if escape in (None, '"') else r'"(\\.|[^"\\])*"'
    return F.size(F.split(F.regexp_replace(F.col(CORRUPT), quoted, ""), _regex_escape(sep)))


def _too_many(columns: list[str], sep: str, escape: str | None) -> Column:
    # The flag also reads the parsed columns: a scan that requires only the
    # corrupt-record column is refused by Spark, and pruning would leave just that.
    parsed = F.length(F.concat_ws("\u0001", *[F.col(c) for c in columns])) >= 0
    many = F.col(CORRUPT).isNotNull() & (_n_fields(sep, escape) > len(columns)) & parsed
    return F.coalesce(many, F.lit(False))


def ingest_fixed(spark: SparkSession, paths: list[str] | str, columns: list[str], target: str,
                 sep: str = ";", encoding: str = "ISO-8859-1", escape: str | None = None,
                 header: bool = True) -> tuple[DataFrame, DataFrame]:
    """S2/S3 with a quarantine: one read of the files writes good rows and rejected ones side by side.

    Below ``target`` the folder ``rejected=false`` holds the rows (short ones padded with nulls),
    ``rejected=true`` the raw lines with too many fields, their file, the place of the line in
    it (a number that grows with the line) and the reason. Returns both, read back."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
          .option("escape", escape or '"').option("quote", '"').schema(schema).csv(paths))
    bad, fields = _too_many(columns, sep, escape), _n_fields(sep, escape)
    block = F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit("1" + "0" * 10).cast("decimal(11,0)")
    place = (block + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(10,0)"))
    rows = df.select(
        *columns, F.col("_metadata.file_path").alias("_file"), place.cast("decimal(33,0)").alias("_place"),
        F.when(bad, F.col(CORRUPT)).alias("raw_line"),
        F.when(bad, F.concat(fields, F.lit(f" fields, {len(columns)} expected"))).alias("reason"),
        bad.alias("rejected"))
    rows.write.mode("overwrite").partitionBy("rejected").parquet(target)
    back = spark.read.schema(rows.schema).parquet(target)
    good = back.where("not rejected").select(*columns, "_file", "_place")
    return good, back.where("rejected").select("_file", "_place", "raw_line", "reason")


def _regex_escape(sep: str) -> str:
    return "\\" + sep if sep in ".^$|?*+()[]{}\\" else sep


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8",
              mode: str = "overwrite", max_rows: int = 0) -> None:
    """K1/K2: header + separator + encoding. Spark writes no byte-order mark.

    Names of files grow with the rows' places; ``max_rows`` (0: no bound) starts a new file."""
    (df.write.mode(mode).option("header", True).option("sep", sep).option("maxRecordsPerFile", max_rows)
       .option("encoding", encoding).option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
       .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
       .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
