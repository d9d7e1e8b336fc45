"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds the ids of whole texts, and in the same pass their bytes and what they decode to;
``decode`` turns ids of any table back into bytes. Long texts are cut at
safe boundaries first: in front of an ASCII space that follows a letter, digit or mark in
ASCII, where a match of the pattern always ends. Long runs of white space are one match of
the pattern each, and are merged as one piece (the library's pattern engine overflows there).

Defined results: a null or empty text gives no ids and decodes to empty bytes; a null list
of ids decodes to null. Other columns pass through, except one named like the output.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters after which a longer text is cut at the next safe boundary.
CUT_CHARS = 100_000
#: Bytes of text after which a result batch ends (a row is never split), and ids decoded in one call.
BATCH_BYTES = 1 << 20
DECODE_IDS = 100_000
_SAFE = re.compile(r"(?<=[!-~])(?= )")
#: White space as the pattern's engine has it (Unicode White_Space); fixed values.
_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                          0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LONG_SPACE = re.compile(f"[{_SPACE}]{{2000,}}")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once per Python process."""
    import tiktoken
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, cut: int = CUT_CHARS):
    """(text, single) parts whose ids joined are the ids of the whole; single: one match."""
    at = 0
    for m in _LONG_SPACE.finditer(text):
        a, b = m.span()
        yield from _cuts(text, at, a, cut)
        # before a non-space the last white space belongs to the next match
        at = b if b == len(text) else b - 1
        yield text[a:at], True
    yield from _cuts(text, at, len(text), cut)


def _cuts(text: str, a: int, b: int, cut: int):
    while b - a > cut:
        m = _SAFE.search(text, a + cut, b)
        if not m:
            break
        yield text[a:m.start()], False
        a = m.start()
    if a < b:
        yield text[a:b], False


def id_parts(enc, text: str):
    """Lists of ids that joined are the ids of one call over the whole text."""
    if len(text) <= CUT_CHARS and not _LONG_SPACE.search(text):
        yield enc.encode_ordinary(text)
        return
    for part, single in pieces(text):
        yield enc._encode_single_piece(part) if single else enc.encode_ordinary(part)


def encode_text(enc, text: str) -> list[int]:
    """Ids of a whole text, equal to those of one call over all of it."""
    return [i for part in id_parts(enc, text) for i in part]


def encode_array(enc, text: str | None) -> np.ndarray:
    """Ids of a whole text in 32 bits, without a list of all of them; none for a null."""
    parts = [np.asarray(x, np.int32) for x in id_parts(enc, text)] if text else []
    return parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.int32)])


def decode_array(enc, ids: np.ndarray) -> bytes:
    """Bytes of any ids: those of each id, joined."""
    return b"".join(enc.decode_bytes(ids[i:i + DECODE_IDS].tolist()) for i in range(0, len(ids), DECODE_IDS))


def bounded(batch: pa.RecordBatch, text_col: str):
    """Slices of a batch, in order, each ending with the row whose text reaches ``BATCH_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.large_string())), 0)
    ends, a = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
    while a < len(ends):
        full = (ends[a - 1] if a else 0) + BATCH_BYTES
        b = min(int(np.searchsorted(ends, full)) + 1, len(ends))
        yield batch.slice(a, b - a)
        a = b


def encoded(batches, enc, keep: list[str], text_col: str, out: str, raw: str | None, decoded: str | None):
    """Result batches of ``encode``, of bounded size: a task never holds the ids of a whole input batch."""
    for b in (x for batch in batches for x in bounded(batch, text_col)):
        ids = [encode_array(enc, t) for t in b.column(text_col).to_pylist()]
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        found = {out: pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids)))}
        if raw:
            found[raw] = pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())
        if decoded:
            found[decoded] = pa.array([decode_array(enc, x) for x in ids], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *found.values()], names=[*keep, *found])


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids",
           raw: str | None = None, decoded: str | None = None, drop_text: bool = False) -> DataFrame:
    """``df`` with the ids of each whole text (array<int>) in column ``out``, which it replaces.

    Where they are named, columns ``raw`` and ``decoded`` follow: the ids as little-endian unsigned
    32-bit integers, and the bytes that the ids decode to (binary). They come from the same Python
    worker, so a task needs no second one. ``drop_text`` leaves the text column out.
    """
    added = [T.StructField(out, T.ArrayType(T.IntegerType(), False)),
             *(T.StructField(c, T.BinaryType()) for c in (raw, decoded) if c)]
    gone = {f.name.lower() for f in added} | ({text_col.lower()} if drop_text else set())
    keep = [f for f in df.schema if f.name.lower() not in gone]
    names = [f.name for f in keep]

    def run(batches):
        yield from encoded(batches, encoding(rank_file, pattern), names, text_col, out, raw, decoded)

    return df.mapInArrow(run, T.StructType([*keep, *added]))


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """Column of the raw bytes that the ids stand for (binary); any list of ids will do."""

    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        enc = encoding(rank_file, pattern)
        return s.map(lambda x: None if x is None else decode_array(enc, x))

    return run(ids)
