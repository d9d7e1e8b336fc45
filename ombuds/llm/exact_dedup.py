"""Exact duplicates by progressive refinement, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Three steps, each over what the one
before left:

1. length: texts of a byte length that no other text has are unique (lower-casing A-Z keeps it);
2. prefix: of the rest, those whose (length, hash of the first ``HEAD`` characters) is alone;
3. whole text: only what is left is read and hashed in full (SHA-256) and grouped by it.

The first scan makes one narrow row a document, (length, prefix hash); both groupings run on
that table. What survives them is kept as bitmaps of a fixed size (``marks``), so that the second
scan knows in place which texts to read in full, and texts are never shuffled. A bitmap may
let a unique text through, which the third step then finds alone; it never drops a copy.

A group that holds a third of all rows is reduced to one row in each task before the shuffle.
Results go back to the rows by the hash; groups of over ``1 / HOT`` of all rows, of which there
are fewer than ``HOT``, are broadcast, so their rows never meet in one task.

Defined results: a null text counts as empty; empty texts are one group. Of equal texts the row
with the largest id stays, a null id counts as the least, and of rows that repeat that id exactly
one stays. An empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .marks import flagged, marks

#: Characters of the prefix that the second step looks at.
HEAD = 64
#: Bits of the sets of repeated lengths and of repeated prefixes: 128 KB and 16 MB.
LENGTH_BITS, HEAD_BITS = 1 << 20, 1 << 27
#: Groups of more than this part of all rows are broadcast; there are fewer than HOT of them.
HOT = 1024


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, alive): ``alive`` where length and prefix do not prove that the text is unique."""
    spark = docs.sparkSession
    size, head = F.octet_length("text").alias("size"), F.xxhash64(folded(F.substring("text", 1, HEAD))).alias("head")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    narrow = written(spark, d.select(size, head), "lengths")

    lengths = narrow.groupBy("size").count().where("count > 1")
    by_size = marks(lengths, F.col("size"), LENGTH_BITS)
    left = flagged(narrow, F.col("size"), by_size, LENGTH_BITS, "again").where("again")
    heads = left.groupBy("size", "head").count().where("count > 1")
    key = F.xxhash64("size", "head")
    by_head = written(spark, marks(heads, key, HEAD_BITS).coalesce(4), "heads")

    return flagged(d.select("id", "text", size, head), key, by_head, HEAD_BITS, "alive").select("id", "text", "alive")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            digests: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` (lower-case hex) is null for texts that length and prefix prove unique, which
    are then not read in full; ``digests`` asks for it on every row.
    """
    spark = docs.sparkSession
    sha = F.unhex(F.sha2(folded(F.col("text")), 256))
    rows = survivors(docs, id_col, text_col).select(
        "id", "alive", F.monotonically_increasing_id().alias("row"),
        (sha if digests else F.when(F.col("alive"), sha)).alias("sha"))
    rows = written(spark, rows, "hashed")

    groups = rows.where("alive").groupBy("sha").agg(
        F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep")).where("group_size > 1")
    groups = written(spark, groups, "groups")
    many = rows.count() / HOT
    hot = F.broadcast(groups.where(F.col("group_size") > many))
    cold = groups.where(F.col("group_size") <= many)

    alive = rows.where("alive")
    found = (alive.join(hot, "sha")
             .unionByName(alive.join(hot.select("sha"), "sha", "left_anti").join(cold, "sha", "left"))
             .unionByName(rows.where("not alive"), allowMissingColumns=True))
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

