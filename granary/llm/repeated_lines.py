"""Lines repeated across one site's documents (problem 6).

Method: content-defined chunking. Each text is read as one stream of letters
(case folded, everything else dropped, line breaks too). The stream is cut where
a rolling hash over the last ROLL letters falls below a threshold, so that equal
passages fall into equal chunks however their lines are broken. Distinct
documents are counted for each chunk and source; chunks in at least ``min_docs``
documents are repeated. ``repeated_spans`` cuts runs of repeated chunks.

The cases of the data are lines. A line that holds a chunk whose ends and
windows lie within it is known by its first such chunk, which depends on the
line's letters alone: only if that chunk is repeated is the line a candidate.
Shorter lines are candidates as they are. An exact count of distinct documents
for the candidates' whole letters decides.

Counts are exact and cover all rows: each Arrow batch first drops its own
repetitions (map-side), the rest is aggregated by key, so a chunk that stands in
a third of all rows is combined before the shuffle and never gathered.

Documents without text, source or letters have no repeated lines. Whole rows
that are repeated count once, because distinct ids are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import rolling as R
from granary.plans.staging import stage

ROLL = 8
MEAN_CHUNK = 48
CUT_LETTERS = 64

_letters: list[np.ndarray] = []


def letter_words() -> np.ndarray:
    """For each code point the random word of its lower-case letter, 0 for others."""
    if not _letters:
        words = R.code_words()
        table = np.zeros(0x110000, np.uint64)
        for i in range(0x32400):  # no letters are assigned beyond
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = words[ord(low) if len(low) == 1 else i]
        _letters.append(table)
    return _letters[0]


def letter_chunks(text: str) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(chunks, lines) of a text as columns.

    Chunks have start and end (code points), hash and, if one is the first of
    its line, the line's index among ``lines``, else -1. Lines (those with
    letters) have number from 1, start and end of their letters, hash and whether
    they hold a chunk.
    """
    codes = R.code_points(text)
    w = letter_words()[codes]
    at = np.flatnonzero(w)
    n = len(at)
    if not n:
        e = np.empty(0, np.int64)
        return dict(start=e, end=e, hash=e, line=e), dict(no=e, start=e, end=e, hash=e, held=e.astype(bool))
    line_of = np.cumsum(codes == 10)[at] + 1
    prefix = R.prefix_hashes(w[at])
    cuts = np.array([0, n])
    if n > ROLL:
        inv = R.powers(n + 1)[1]
        roll = R.mix((prefix[ROLL:-1] - prefix[: -ROLL - 1]) * inv[: n - ROLL])  # of the letters before i, i from ROLL
        inner = np.flatnonzero(roll < np.uint64((1 << 64) // MEAN_CHUNK)) + ROLL
        cuts = np.concatenate([[0], inner, [n]])
    starts, ends = cuts[:-1], cuts[1:]
    chunk = R.span_hashes(prefix, starts, ends).view(np.int64)
    heads = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1]))
    tails = np.append(heads[1:], n)
    no = line_of[heads]
    whole = R.span_hashes(prefix, heads, tails).view(np.int64)
    # both cuts and their windows within one line
    own = np.flatnonzero((starts >= ROLL) & (ends < n))
    own = own[line_of[starts[own] - ROLL] == line_of[ends[own] - 1]]
    lines, first = np.unique(line_of[starts[own]], return_index=True)
    line = np.full(len(starts), -1)
    line[own[first]] = np.searchsorted(no, lines)
    held = np.zeros(len(no), bool)
    held[line[own[first]]] = True
    return (
        dict(start=at[starts], end=at[ends - 1] + 1, hash=chunk, line=line),
        dict(no=no, start=at[heads], end=at[tails - 1] + 1, hash=whole, held=held),
    )


def _chunk_rows(places: bool):
    """Rows of chunks and lines; without ``places`` a chunk that stands for no line comes once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0).to_numpy(zero_copy_only=False)
            parts: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(b.column(2).to_pylist()):
                c, x = letter_chunks(text)
                keep = np.arange(len(c["hash"]))
                if not places and len(keep):
                    order = np.lexsort((c["line"] < 0, c["hash"]))
                    h = c["hash"][order]
                    new = np.append(True, h[1:] != h[:-1]) | (c["line"][order] >= 0)
                    keep = order[new]
                line = c["line"][keep]
                of = lambda a, missing: np.where(line >= 0, a[np.maximum(line, 0)], missing) if len(a) else np.full(len(line), missing)
                bare = np.flatnonzero(~x["held"])
                k, m = len(keep), len(bare)
                parts.append((
                    np.full(k + m, i), np.append(np.zeros(k, bool), np.ones(m, bool)), np.append(c["hash"][keep], np.zeros(m, np.int64)),
                    np.append(c["start"][keep], x["start"][bare]), np.append(c["end"][keep], x["end"][bare]),
                    np.append(of(x["no"], 0), x["no"][bare]), np.append(of(x["hash"], 0), x["hash"][bare]),
                ))
            i, bare, chunk, start, end, no, whole = (np.concatenate(p) for p in zip(*parts)) if parts else [np.empty(0, np.int64)] * 7
            i, bare, no = i.astype(np.int64), bare.astype(bool), no.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).take(pa.array(i)), pa.array(docs[i]), pa.array(chunk, mask=bare), pa.array(no, mask=no == 0),
                    pa.array(whole, mask=no == 0), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)),
                ],
                ["site", "doc", "chunk", "line_no", "line", "start", "end"],
            )

    return run


def chunks(docs: DataFrame, places: bool = False) -> DataFrame:
    """(site, doc, chunk, line_no, line, start, end) of ``docs(doc, site, text)``.

    A row is a chunk, with line_no and line (a hash) if it stands for a line, or a line that holds none (chunk is null).
    """
    some = docs.select("doc", "site", "text").where("doc is not null and site is not null and text is not null")
    return some.mapInArrow(_chunk_rows(places), "site string, doc long, chunk long, line_no int, line long, start int, end int")


def over(df: DataFrame, key: str, min_docs: int) -> DataFrame:
    """(site, key): keys that stand in at least min_docs distinct documents of their site."""
    once = df.select("site", key, "doc").distinct()
    return once.groupBy("site", key).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _lines(c: DataFrame, frequent: DataFrame, min_docs: int) -> DataFrame:
    """(doc, line_no) of the repeated lines among chunk rows, ``frequent`` being the repeated chunks."""
    named = c.where("line_no is not null")
    held = named.where("chunk is not null").join(frequent, ["site", "chunk"], "left_semi")
    candidates = held.unionByName(named.where("chunk is null")).select("site", "doc", "line_no", "line")
    candidates = stage(candidates, "p6-candidates")
    sure = over(candidates, "line", min_docs).select("site", "line")
    return candidates.join(sure, ["site", "line"], "left_semi").select("doc", "line_no").distinct()


def repeated_lines(docs: DataFrame, min_docs: int = 8) -> DataFrame:
    """(doc, line_no): lines of ``docs(doc, site, text)`` that stand in min_docs documents of their site."""
    c = stage(chunks(docs).drop("start", "end"), "p6-chunks")
    frequent = over(c.where("chunk is not null"), "chunk", min_docs).select("site", "chunk")
    return _lines(c, frequent, min_docs)


def _runs(c: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """(doc, start, end) of the runs of repeated chunks among chunk rows with places."""
    by = W.partitionBy("doc").orderBy("start", "end")  # the chunks of one text
    often = frequent.select("site", "chunk", F.lit(True).alias("often"))
    x = c.where("chunk is not null").join(often, ["site", "chunk"], "left").select("doc", "start", "end", "often").distinct()
    x = x.withColumn("run", F.sum(F.when(F.col("often") & F.lag("often").over(by), 0).otherwise(1)).over(by)).where("often")
    runs = x.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.where(F.col("end") - F.col("start") >= least).select("doc", "start", "end")


def repeated_spans(docs: DataFrame, min_docs: int = 8, least: int = CUT_LETTERS) -> DataFrame:
    """(doc, start, end): runs of repeated chunks that stretch over at least ``least`` characters of their text.

    Places count code points from 0. A chunk next to another repeated one joins
    its run; what a run lacks at its ends is less than a chunk on each side.
    """
    c = stage(chunks(docs, places=True).where("chunk is not null").select("site", "doc", "chunk", "start", "end"), "p6-places")
    return _runs(c, over(c, "chunk", min_docs), least)


def repetitions(docs: DataFrame, min_docs: int = 8, least: int = CUT_LETTERS) -> tuple[DataFrame, DataFrame]:
    """(repeated_lines, repeated_spans) of ``docs``, which are read once for both."""
    c = stage(chunks(docs, places=True), "p6-all")
    frequent = stage(over(c.where("chunk is not null"), "chunk", min_docs).select("site", "chunk"), "p6-frequent")
    return _lines(c, frequent, min_docs), _runs(c, frequent, least)


def _without_spans(breaks: bool) -> Column:
    """The column text less its gone_spans, disjoint and in order; with ``breaks`` the line breaks within them stay."""
    n = F.size("gone_spans")
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("gone_spans", i - 1)["end"])
    upto = lambda i: F.coalesce(F.get("gone_spans", i)["start"], F.length("text"))

    def piece(i):
        kept = F.substr(F.col("text"), before(i) + 1, upto(i) - before(i))
        cut = F.get("gone_spans", i)
        inside = F.regexp_replace(F.substr(F.col("text"), cut["start"] + 1, cut["end"] - cut["start"]), r"[^\n]", "")
        return F.concat(kept, F.coalesce(inside, F.lit(""))) if breaks else kept

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n), piece), "")).otherwise(F.col("text"))


def _without_lines() -> Column:
    """The column text less its gone_lines, numbered from 1."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("t")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.coalesce("gone_lines", F.array().cast("array<int>")), x["n"]))
    return F.when(F.col("text").isNotNull(), F.array_join(F.transform(kept, lambda x: x["t"]), "\n"))


def _spans_of(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone_spans"))  # of one text


def _lines_of(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc").agg(F.collect_set("line_no").alias("gone_lines"))


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs(doc, text)`` with text less the disjoint ``spans(doc, start, end)``; all rows and columns stay."""
    return docs.join(_spans_of(spans), "doc", "left").withColumn("text", _without_spans(False)).drop("gone_spans")


def without_lines(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs(doc, site, text)`` with text less the lines in ``drop(doc, line_no)``; all rows and columns stay."""
    return docs.join(_lines_of(drop), "doc", "left").withColumn("text", _without_lines()).drop("gone_lines")


def without_repetitions(docs: DataFrame, lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs(doc, site, text)`` without repeated ``lines(doc, line_no)`` and ``spans(doc, start, end)``; runs of blank lines become one.

    What goes from each text is put together first, so that texts are joined once.
    """
    x = docs.join(_lines_of(lines).join(_spans_of(spans), "doc", "full"), "doc", "left")
    x = x.withColumn("text", _without_spans(True)).withColumn("text", _without_lines()).drop("gone_lines", "gone_spans")
    return x.withColumn("text", F.regexp_replace("text", r"\n\s*\n\s*\n+", "\n\n"))
