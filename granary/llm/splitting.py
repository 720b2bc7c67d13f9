"""Splitting oversized texts at natural boundaries (problem 7).

Method: a range-maximum index over boundary strengths. Each position of a text
has a strength as a cut (paragraph, line, sentence, clause, word, hyphen, none);
strength and position form one key, so that the largest key in a window is the
strongest cut and among equals the rightmost. The permissible window of a piece
runs from half the limit (more than the overlap at least) to the limit. All
windows have one length, so the sparse table needs only its level of that
length: two overlapping blocks answer a query. The next piece starts ``overlap``
characters before the cut.

Sizes are code points. Texts within the limit, empty or null texts aren't split.
A text without any boundary is cut at the limit. No cut stands before a
combining mark unless the window has no other place.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import rolling as R

# fixed values: characters that end sentences and clauses, and closing marks that may follow them
SENTENCE, CLAUSE, CLOSING, BREAKABLE = ".!?…。！？", ";:,،、；：", "\"'»”’)]}", "-/–—‐"
PARAGRAPH, LINE, SENT, CLAU, WORD, HYPHEN, NONE, INSIDE = 7, 6, 5, 4, 3, 2, 1, 0

_tables: dict[str, np.ndarray] = {}


def _kind() -> np.ndarray:
    if "kind" not in _tables:
        t = np.zeros(0x110000, np.uint8)
        t[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 1
        for chars, v in ((SENTENCE, 2), (CLAUSE, 3), (CLOSING, 4), (BREAKABLE, 5)):
            t[[ord(c) for c in chars]] = v
        marks = [i for i in range(0x300, 0x20000) if unicodedata.category(chr(i))[0] == "M"]
        t[[*marks, 0x200D, *range(0xE0100, 0xE01F0)]] = 6
        _tables["kind"] = t
    return _tables["kind"]


def strengths(codes: np.ndarray) -> np.ndarray:
    """The strength of a cut before each position 0..n; positions inside a run of blanks have that of none."""
    n = len(codes)
    kind = _kind()[codes]
    out = np.full(n + 1, NONE, np.int64)
    out[0] = INSIDE
    if n == 0:
        return out
    out[:-1][kind == 6] = INSIDE
    out[1:][kind == 5] = HYPHEN
    blank = kind == 1
    ends = np.flatnonzero(blank & np.append(~blank[1:], True))
    if len(ends):
        starts = np.flatnonzero(blank & np.insert(~blank[:-1], 0, True))
        lines = np.concatenate([[0], np.cumsum(codes == 10)])
        breaks = lines[ends + 1] - lines[starts]
        # the last character before the run that isn't a closing mark
        solid = np.maximum.accumulate(np.where(kind != 4, np.arange(n), -1))
        before = np.where(starts > 0, solid[np.maximum(starts - 1, 0)], -1)
        mark = np.where(before >= 0, kind[np.maximum(before, 0)], 0)
        s = np.select([breaks >= 2, breaks == 1, mark == 2, mark == 3], [PARAGRAPH, LINE, SENT, CLAU], WORD)
        out[ends + 1] = s
    return out


def cuts(codes: np.ndarray, max_size: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces [start, end) of a text."""
    n = len(codes)
    if n <= max_size:
        return [(0, n)]
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be less than the size limit")
    least = min(max_size, max(overlap + 1, max_size // 2))
    length = max_size - least + 1
    key = strengths(codes) * (n + 1) + np.arange(n + 1)
    block = 1 << (length.bit_length() - 1)
    level = R.window_min(-key, block)
    out, start = [], 0
    while n - start > max_size:
        lo = start + least
        best = -min(int(level[lo]), int(level[lo + length - block]))
        cut = best % (n + 1)
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[tuple] = []
        for table, item, field, size, overlap, text in zip(*(c.to_pylist() for c in b.columns)):
            for k, (s, e) in enumerate(cuts(R.code_points(text), size, overlap), 1):
                out.append((table, item, field, k, s, e, text[s:e]))
        if out:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                ["table_name", "item_id", "field_name", "piece_no", "start", "end", "piece"],
            )


def split(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the oversized texts of ``items(table_name, item_id, field_name, text)``.

    ``limits(table_name, field_name, max_size, overlap)``; texts without a limit aren't split.
    """
    m = limits.select("table_name", "field_name", "max_size", "overlap")
    over = items.join(m, ["table_name", "field_name"]).where(F.length("text") > F.col("max_size"))
    return over.select("table_name", "item_id", "field_name", "max_size", "overlap", "text").mapInArrow(
        _split_batches,
        "table_name string, item_id string, field_name string, piece_no int, start long, end long, piece string",
    )
