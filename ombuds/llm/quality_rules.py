"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged by three rules; lines that fail are removed, and a document
that loses too much of its text with them is rejected:

* punctuation: symbols are over a tenth of the line's word characters, or the line holds
  three or more runs of ``!`` or ``?``, or it is a short line without a closing mark;
* navigation: three or more separators (``|``, ``»``, ``›``, ``•``, ``·``);
* boilerplate: a short line that holds one of ``BOILERPLATE``.

Base counts of the whole text come with the verdict. There is no shuffle: every count is made
inside the row. Five-word windows are compared by a 64-bit hash.

Defined results: a null or blank text has no words and fails; repeated rows are judged each
on its own; only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
#: Phrases of boilerplate lines, lower case; fixed values.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy",
               "cookie", "javascript", "click here", "read more", "subscribe", "log in",
               "sign up", "copyright", "licensed under")
CLOSED = r"[.!?:;…\"'”’»)\]][\x20\x09-\x0D]*$"
#: A line of fewer words without a closing mark fails; so does a boilerplate line of up to this many.
SHORT_LINE, BOILERPLATE_WORDS = 5, 40
#: Least share of the word characters that must be left.
LEAST_LEFT = 0.5


def line_words(line):
    """Number of words of a line."""
    trimmed = F.btrim(line, F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SPACE)))


def ink(text):
    """Number of characters in words."""
    return F.length(F.regexp_replace(text, SPACE, ""))


def line_fails(line):
    """The three rules for one line that has a word."""
    words = line_words(line)
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    punctuation = ((F.regexp_count(line, F.lit(SYMBOLS)) * 10 > ink(line))
                   | (F.regexp_count(line, F.lit("[!?]{2,}")) >= 3)
                   | ((words < SHORT_LINE) & ~F.regexp_like(line, F.lit(CLOSED))))
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) >= 3
    return punctuation | navigation | (boiler & (words <= BOILERPLATE_WORDS))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          least_left: float = LEAST_LEFT) -> DataFrame:
    """Per document: base counts, the kept lines as ``clean_text``, and the verdict ``kept``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACES))
    d = d.select("doc_id", "text", F.when(trimmed == "", F.array().cast("array<string>"))
                 .otherwise(F.split(trimmed, SPACE)).alias("w"),
                 F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"),
                 F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.filter("lines", lambda x: ~line_fails(x)).alias("good"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    windows = F.transform("h", lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, 5))))
    d = d.select("*", F.when(F.size("h") >= 5, F.slice(windows, F.lit(1), F.size("h") - 4)).alias("g"))
    # only texts with a repeated window sort them
    d = d.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(
        F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    twice = F.transform("s", lambda e, j: F.when(
        (e["h"] == F.get("s", j - 1)["h"]) | (e["h"] == F.get("s", j + 1)["h"]), e["i"]))
    d = d.select("*", F.when(F.col("s").isNotNull(), F.sort_array(F.filter(twice, lambda x: x.isNotNull()))).alias("p"))
    covered = F.transform("p", lambda x, j: F.least(F.lit(5), F.coalesce(F.get("p", j + 1), x + 5) - x))
    repeated = F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))
    d = d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                 repeated.alias("n_repeat_words"), F.array_join("good", "\n").alias("clean_text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = d.select("*", failed.alias("base_failed"), ink(F.col("clean_text")).cast("long").alias("clean_chars"))
    return d.select("*", (~F.col("base_failed")
                          & (F.col("clean_chars") >= least_left * F.col("word_chars"))).alias("kept"))
