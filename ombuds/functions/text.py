"""Label and text rules as Column expressions (JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import schema as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    """Python ``str.strip()``: removes leading/trailing whitespace of any kind
    (``trim`` removes spaces only)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def needs_category(col) -> Column:
    """Null, blank, or exactly OUTROS/OUTRO after strip + upper."""
    c = _c(col)
    return c.isNull() | F.upper(strip(c)).isin("", *S.GENERIC_CATEGORIES)


def needs_subcategory(col) -> Column:
    """P5: null, blank, or containing OUTRO (upper-cased, not stripped)."""
    c = _c(col)
    return c.isNull() | (strip(c) == "") | F.upper(c).contains(S.GENERIC_SUB_MARK)


def has_outro(col) -> Column:
    """P6 (batch scripts): lower-cased value contains 'outro'; null -> false."""
    return F.coalesce(F.lower(_c(col)).contains(S.GENERIC_SUB_MARK_LOWER), F.lit(False))


def is_blank(col) -> Column:
    c = _c(col)
    return c.isNull() | (strip(c) == "")


def keep_specific_category(col) -> Column:
    """category chart filter -- upper without strip, then not null, not blank."""
    c = _c(col)
    return (~F.upper(c).isin(*S.GENERIC_CATEGORIES)) & c.isNotNull() & (strip(c) != "")


def keep_specific_subcategory(col) -> Column:
    """sub-category chart filter -- no OUTRO substring, not null, not blank."""
    c = _c(col)
    return (~F.coalesce(F.upper(c).contains(S.GENERIC_SUB_MARK), F.lit(False))) \
        & c.isNotNull() & (strip(c) != "")


def composite_text(available: Iterable[str], parts: list[str] | None = None,
                   min_part: int = S.COMPOSITE_MIN_PART,
                   max_chars: int | None = S.COMPOSITE_MAX_CHARS) -> Column:
    """Stripped parts longer than ``min_part`` joined by a space, cut at ``max_chars``
    (None: whole).

    Columns absent from ``available`` are skipped, like the reference."""
    present = set(available)
    cols = [strip(F.col(p)) for p in (parts or S.COMPOSITE_TEXT_COLUMNS) if p in present]
    if not cols:
        return F.lit("")
    kept = F.filter(F.array(*cols), lambda x: x.isNotNull() & (F.length(x) > min_part))
    joined = F.array_join(kept, " ")
    return joined if max_chars is None else F.substring(joined, 1, max_chars)


def forest_text(available: Iterable[str], parts: list[str] | None = None) -> Column:
    """Non-null parts joined by a space, unstripped, no cut."""
    present = set(available)
    cols = [F.col(p).cast("string") for p in (parts or S.FOREST_TEXT_COLUMNS) if p in present]
    if not cols:
        return F.lit("")
    return F.concat_ws(" ", *cols)


def enough_text(col, min_length: int = S.MIN_TEXT_LENGTH) -> Column:
    """Stripped length >= min_length (null -> false)."""
    return F.coalesce(F.length(strip(col)) >= min_length, F.lit(False))


def normalize_label(col) -> Column:
    """P10: upper, accents E/I/O replaced, strip; null stays null."""
    return strip(F.translate(F.upper(_c(col)), S.ACCENTS_FROM, S.ACCENTS_TO))


def snippets(texts_col, n: int = S.SNIPPET_COUNT, chars: int = S.SNIPPET_CHARS) -> Column:
    """First ``chars`` characters + '...' of the first ``n`` texts of an array."""
    return F.transform(F.slice(_c(texts_col), 1, n),
                       lambda t: F.concat(F.substring(t, 1, chars), F.lit(S.SNIPPET_SUFFIX)))
