"""Long exact spans shared between records (problem 10).

Method: de Bruijn compaction over a sparse, exact set of k-mers.

* The tokens are characters, the edges k-mers of K characters. Of each record
  only the winnowed k-mers are kept: with K + W - 1 = min_len every span of
  min_len characters holds one of them, and equal spans hold equal ones, so that
  no shared span can be missed while about 1 position in 50 is stored.
* K-mers that stand in one record only leave the graph (a count with map-side
  combine, then a semi join that AQE can split on hot k-mers).
* A repeated k-mer whose predecessor is the same, at the same distance of at
  most K, in all its occurrences doesn't branch; such runs compact to one path.
  As the text between is covered by overlapping k-mers, all occurrences of a
  path have the same text. Paths are found by joins of per-k-mer summaries and
  a window over each record's own coordinates; nothing is iterated.
* Source coordinates verify: the path's text and up to min_len characters at
  each side are cut from the source, occurrences with equal text and context
  form a class, and classes are compared character by character. Paths with
  more than ``hot`` classes aren't compared pairwise: each window of min_len
  characters over such a path and each longer reach to one side becomes a key,
  and only equal keys meet; the longest reaches that meet are exact.

Null, empty and shorter texts share nothing. Records with equal ids count as
one record. A span repeated within one record alone isn't shared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import rolling as R
from granary.plans.staging import bounded_broadcast, stage

HOT_CLASSES = 64
BROADCAST_DOCS = 200_000


def split_length(min_len: int) -> tuple[int, int]:
    """K and W with K + W - 1 = min_len and W <= K."""
    k = min_len // 2 + 1
    return k, min_len - k + 1


def _anchor_batches(min_len: int):
    k, w = split_length(min_len)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = R.code_words()
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            docs, hashes, places = [], [], []
            for i, text in zip(ids, b.column(1).to_pylist()):
                if len(text) < min_len:
                    continue
                at, h = R.winnow(R.prefix_hashes(words[R.code_points(text)]), k, w)
                docs.append(np.full(len(at), i, np.int64))
                hashes.append(h.view(np.int64))
                places.append(at.astype(np.int32))
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (hashes, docs, places)], ["h", "doc", "pos"]
                )

    return run


def anchors(docs: DataFrame, min_len: int) -> DataFrame:
    """(h, doc, pos): the winnowed k-mers of each text of at least min_len characters."""
    return docs.select("doc", "text").where(F.length("text") >= min_len).mapInArrow(
        _anchor_batches(min_len), "h long, doc long, pos int"
    )


def paths(a: DataFrame, min_len: int) -> DataFrame:
    """(h, doc, start, end): occurrences of compacted nonbranching paths of repeated k-mers."""
    k, _ = split_length(min_len)
    repeated = (
        a.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h")
    )
    r = stage(a.join(repeated, "h", "left_semi").distinct(), "p10-repeated")
    by_doc = W.partitionBy("doc").orderBy("pos", "h")
    near = F.lag("pos").over(by_doc) >= F.col("pos") - k
    r = r.select(
        "*",
        F.when(near, F.lag("h").over(by_doc)).alias("prev"),
        F.when(near, F.col("pos") - F.lag("pos").over(by_doc)).alias("gap"),
    )
    r = stage(r, "p10-linked")
    link = F.struct("prev", "gap")
    s = r.groupBy("h").agg(
        F.count("*").alias("n"),
        F.count("prev").alias("n_prev"),
        F.min(link).alias("first"),
        F.max(link).alias("last"),
    )
    single = s.where("n = n_prev and first = last").select("h", "n", F.col("first.prev").alias("prev"))
    inner = single.join(
        s.select(F.col("h").alias("prev"), F.col("n").alias("n_of_prev")), "prev"
    ).where("n = n_of_prev").select("h", F.lit(True).alias("inner"))
    r = r.join(inner, "h", "left").withColumn("head", F.when(F.col("inner"), 0).otherwise(1))
    r = r.withColumn("path", F.sum("head").over(by_doc))
    return r.groupBy("doc", "path").agg(
        F.min_by("h", "pos").alias("h"),
        F.min("pos").alias("start"),
        (F.max("pos") + k).alias("end"),
    ).select("h", "doc", "start", "end")


CONTEXT_SCHEMA = "h long, doc long, start int, end int, body string, left_text string, right_text string"


def _context_batches(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, found in zip(*(c.to_pylist() for c in b.columns)):
                for x in found:
                    s, e = x["start"], x["end"]
                    body = hashlib.md5(text[s:e].encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((x["h"], doc, s, e, body, text[max(0, s - min_len) : s], text[e : e + min_len]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                    ["h", "doc", "start", "end", "body", "left_text", "right_text"],
                )

    return run


def with_context(docs: DataFrame, p: DataFrame, min_len: int) -> DataFrame:
    """Each occurrence with a digest of its text and the characters at its sides."""
    by_doc = p.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "end")).alias("found"))
    by_doc = bounded_broadcast(stage(by_doc, "p10-by-doc"), BROADCAST_DOCS)
    both = docs.join(by_doc, "doc").select("doc", "text", "found")
    return both.mapInArrow(_context_batches(min_len), CONTEXT_SCHEMA)


def _compare_batches(min_len: int):
    def same(a: str, b: str, backward: bool) -> int:
        n = min(len(a), len(b))
        if backward:
            a, b = a[len(a) - n :], b[len(b) - n :]
        if a[:n] == b[:n]:
            return n
        x, y = np.array(list(a[:n])), np.array(list(b[:n]))
        d = np.flatnonzero(x != y)
        return int(n - 1 - d[-1] if backward else d[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, ls, rs = [], [], []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for i, (_, _, size, la, ra, lb, rb) in enumerate(zip(*cols)):
                left, right = same(la, lb, True), same(ra, rb, False)
                if left + size + right >= min_len:
                    keep.append(i)
                    ls.append(left)
                    rs.append(right)
            if keep:
                kept = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(ls, pa.int32()), pa.array(rs, pa.int32())],
                    ["class_a", "class_b", "l", "r"],
                )

    return run


def _reaches(size: int, left: int, right: int, min_len: int) -> Iterator[tuple[int, int, bool]]:
    """(l, r, window): the least span that proves a reach of l to the left, and one that proves r to the right.

    Windows have exactly min_len characters (or are the path alone if it has as many); l and r beyond them need
    nothing on the other side.
    """
    need = max(0, min_len - size)
    for n in range(max(0, need - right), min(need, left) + 1):
        yield n, need - n, True
    for n in range(need + 1, left + 1):
        yield n, 0, False
    for n in range(need + 1, right + 1):
        yield 0, n, False


def _key_batches(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, cls, ls, rs, windows = [], [], [], [], []
            for h, body, c, size, left, right in zip(*(x.to_pylist() for x in b.columns)):
                for n, m, window in _reaches(size, len(left), len(right), min_len):
                    cut = f"{h}|{body}|{n}|{left[len(left) - n:]}|{right[:m]}"
                    key.append(hashlib.md5(cut.encode("utf-8", "surrogatepass")).digest())
                    cls.append(c)
                    ls.append(n)
                    rs.append(m)
                    windows.append(window)
            if key:
                kinds = (pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip((key, cls, ls, rs, windows), kinds)], ["key", "cls", "l", "r", "window"]
                )

    return run


def shared(
    docs: DataFrame, min_len: int = 200, hot: int = HOT_CLASSES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(occurrences, links, hot_keys) for ``docs(doc long, text string)``.

    occurrences(cls, doc, start, end): each occurrence of a path and its class.
    links(class_a, class_b, l, r): classes whose occurrences share a span of at
    least min_len characters, which reaches l characters before and r after the
    path; a class of several records is linked to itself.
    hot_keys(key, cls, l, r, window): spans over paths of many classes; classes
    with an equal key share that span, which reaches l characters before and r
    after the path. Windows have min_len characters and tell which classes meet;
    the longer spans tell how far they go on.
    """
    docs = docs.where("doc is not null and text is not null")
    a = stage(anchors(docs, min_len), "p10-anchors")
    p = stage(paths(a, min_len), "p10-paths")
    c = with_context(docs, p, min_len)
    c = c.withColumn(
        "cls", F.md5(F.concat_ws("\u0001", F.col("h").cast("string"), "body", "left_text", "right_text"))
    )
    c = stage(c, "p10-context")
    classes = c.groupBy("cls").agg(
        F.first("h").alias("h"), F.first("body").alias("body"), F.first(F.col("end") - F.col("start")).alias("size"),
        F.first("left_text").alias("lt"), F.first("right_text").alias("rt"),
        F.min("doc").alias("lo"), F.max("doc").alias("hi"),
    )
    classes = stage(classes, "p10-classes")
    per_path = classes.groupBy("h").agg(F.count("*").alias("n"), F.min("lo").alias("lo_all"), F.max("hi").alias("hi_all"))
    per_path = per_path.where("lo_all < hi_all").select("h", "n")
    classes = classes.join(per_path, "h")
    alone = classes.where("lo < hi").select(
        F.col("cls").alias("class_a"), F.col("cls").alias("class_b"), F.length("lt").alias("l"), F.length("rt").alias("r"),
        "size",
    ).where(F.col("l") + F.col("size") + F.col("r") >= min_len).drop("size")
    few = classes.where(F.col("n").between(2, hot))
    x, y = few.alias("x"), few.alias("y")
    same_path = (F.col("x.h") == F.col("y.h")) & (F.col("x.body") == F.col("y.body"))
    # two classes of one and the same record share nothing with another
    apart = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    pairs = x.join(y, same_path & apart & (F.col("x.cls") < F.col("y.cls"))).select(
        F.col("x.cls").alias("class_a"), F.col("y.cls").alias("class_b"), F.col("x.size").alias("size"),
        F.col("x.lt").alias("la"), F.col("x.rt").alias("ra"), F.col("y.lt").alias("lb"), F.col("y.rt").alias("rb"),
    )
    compared = pairs.mapInArrow(_compare_batches(min_len), "class_a string, class_b string, l int, r int")
    many = classes.where(F.col("n") > hot)
    keys = many.select("h", "body", "cls", "size", "lt", "rt").mapInArrow(
        _key_batches(min_len), "key binary, cls string, l int, r int, window boolean"
    )
    keys = stage(keys.join(many.select("cls", "lo", "hi"), "cls"), "p10-keys")
    common = keys.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("other"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    common = common.where("first < other and lo < hi").select("key")
    occurrences = c.select("cls", "doc", "start", "end")
    hot_keys = keys.join(common, "key", "left_semi").select("key", "cls", "l", "r", "window")
    return occurrences, alone.unionByName(compared), hot_keys


def shared_pairs(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: records that share a span of min_len characters."""
    occ, links, hot_keys = shared(docs, min_len)
    members = occ.select("cls", "doc").distinct()
    x, y = members.alias("x"), members.alias("y")
    by_class = (
        links.select("class_a", "class_b").distinct()
        .join(x, F.col("class_a") == F.col("x.cls")).join(y, F.col("class_b") == F.col("y.cls"))
        .select(F.least("x.doc", "y.doc").alias("doc_a"), F.greatest("x.doc", "y.doc").alias("doc_b"))
    )
    keyed = hot_keys.where("window").join(members, "cls").select("key", "doc").distinct()
    by_key = keyed.alias("x").join(keyed.alias("y"), F.col("x.key") == F.col("y.key")).where(
        F.col("x.doc") < F.col("y.doc")
    ).select(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"))
    return by_class.unionByName(by_key).where("doc_a < doc_b").distinct()


def groups(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """(passage, doc, start, end): the records that hold a shared passage and where; all records of a passage hold it alike.

    Any two records that share a span of min_len characters have a passage in
    common; there are no pairs, so that a passage with many copies costs a row each.
    """
    occ, links, hot_keys = shared(docs, min_len)
    g = links.select(
        F.md5(F.concat_ws("|", "class_a", "class_b")).alias("passage"), F.explode(F.array_distinct(F.array("class_a", "class_b"))).alias("cls"), "l", "r"
    ).unionByName(hot_keys.where("window").select(F.lower(F.hex("key")).alias("passage"), "cls", "l", "r"))
    return g.join(occ, "cls").select("passage", "doc", (F.col("start") - F.col("l")).alias("start"), (F.col("end") + F.col("r")).alias("end")).distinct()


def merged_spans(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """(doc, start, end): the shared passages of each record, from 0 and without the end, overlapping ones as one.

    Spans reach at most min_len characters beyond a path; longer ones go on with
    the next path.
    """
    occ, links, hot_keys = shared(docs, min_len)
    reach = (
        links.select(F.col("class_a").alias("cls"), "l", "r")
        .unionByName(links.select(F.col("class_b").alias("cls"), "l", "r"))
        .unionByName(hot_keys.select("cls", "l", "r"))
        .groupBy("cls").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    spans = occ.join(reach, "cls").select("doc", (F.col("start") - F.col("l")).alias("s"), (F.col("end") + F.col("r")).alias("e"))
    w = W.partitionBy("doc").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select("doc", "s", "e", F.when(F.col("s") <= before, 0).otherwise(1).alias("new"))
    spans = spans.withColumn("passage", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return spans.groupBy("doc", "passage").agg(F.min("s").alias("start"), F.max("e").alias("end")).select("doc", "start", "end")


def coverage(docs: DataFrame, min_len: int = 200) -> DataFrame:
    """(doc, n_chars, shared_spans, shared_chars, shared_share) for every record with text.

    Overlapping shared spans of one record count once.
    """
    merged = merged_spans(docs, min_len).groupBy("doc").agg(
        F.count("*").alias("shared_spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars")
    )
    sizes = docs.where("doc is not null and text is not null").groupBy("doc").agg(F.max(F.length("text")).alias("n_chars"))
    return sizes.join(merged, "doc", "left").select(
        "doc", "n_chars", F.coalesce("shared_spans", F.lit(0)).alias("shared_spans"),
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)).alias("shared_share"),
    )
