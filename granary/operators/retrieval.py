"""Retrieval: content ids, chunks, tags and exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip_accents
from granary.operators.relational import top_k
from granary.plans.staging import stage

BLOCK = 1024  # vectors in a block


def content_id(source: Column, text: Column) -> Column:
    """Source and md5 of the content."""
    return F.concat_ws("_", F.coalesce(source, F.lit("inconnu")), F.md5(text))


def fixed_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """``df`` exploded to chunks of ``size`` characters that share ``overlap``; an empty text is one empty chunk."""
    step = size - overlap
    n = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1))
    numbers = F.sequence(F.lit(0).cast("bigint"), n - 1)
    keep = [c for c in df.columns if c != text]
    out = df.where(F.col(text).isNotNull()).select(*keep, text, F.explode(numbers).alias("chunk_no"))
    start = (F.col("chunk_no") * step + 1).cast("int")
    return out.select(*keep, "chunk_no", F.substring(F.col(text), start, F.lit(size)).alias("chunk"))


def sentence_chunks(df: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """``df`` exploded to chunks of whole sentences, packed greedily in order; a fold inside the row, no shuffle.

    A chunk begins with the last sentences of the one before, as many as ``overlap``
    characters hold and the next sentence leaves room for. A sentence longer than
    ``size`` is a chunk by itself.
    """
    sentences = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    none = F.array().cast("array<string>")
    joined = lambda a: F.array_join(a, " ")

    def tail(open_: Column, s: Column) -> Column:
        room = F.least(F.lit(overlap), size - 1 - F.length(s))
        start = F.struct(none.alias("kept"), F.lit(True).alias("on"))
        def take(acc: Column, x: Column) -> Column:
            fits = acc["on"] & (F.length(joined(F.concat(F.array(x), acc["kept"]))) <= room)
            return F.struct(F.when(fits, F.concat(F.array(x), acc["kept"])).otherwise(acc["kept"]).alias("kept"), fits.alias("on"))
        return F.aggregate(F.reverse(open_), start, take, lambda acc: acc["kept"])

    def add(acc: Column, s: Column) -> Column:
        fits = (F.size(acc["open"]) == 0) | (F.length(joined(acc["open"])) + 1 + F.length(s) <= size)
        kept = tail(acc["open"], s) if overlap else none
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(joined(acc["open"])))).alias("done"),
            F.when(fits, F.concat(acc["open"], F.array(s))).otherwise(F.concat(kept, F.array(s))).alias("open"),
        )

    chunks = F.aggregate(sentences, F.struct(none.alias("done"), none.alias("open")), add,
                         lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(joined(a["open"])))).otherwise(a["done"]))
    keep = [c for c in df.columns if c != text]
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(chunks).alias("chunk_no", "chunk"))


def path_class(path: Column, folders: dict[str, tuple[str, str]]) -> Column:
    """struct(doc_type, category, source_folder) of a path: by the first folder that is known, else by the file's name."""
    parts, file = F.split(path, "/"), F.lower(F.element_at(F.split(path, "/"), -1))
    weather = file.contains("bulletin") | file.contains("meteo")
    kind = F.when(weather, "weather_bulletin").otherwise("agronomy_knowledge")
    group, folder = F.when(weather, "climat").otherwise("technique_culturale"), F.lit("raw_data")
    for name, (t, c) in reversed(folders.items()):
        inside = F.array_contains(parts, name)
        kind, group, folder = F.when(inside, t).otherwise(kind), F.when(inside, c).otherwise(group), F.when(inside, name).otherwise(folder)
    return F.struct(kind.alias("doc_type"), group.alias("category"), folder.alias("source_folder"))


# fixed values: words that tag a text
TAGS = {
    "crops": "mais|sorgho|mil|coton|arachide|niebe|riz|oignon|tomate|manioc|sesame",
    "weather": "pluie|secheresse|inondation|innondation|temperature|vent|humidite|climat",
    "themes": "marche|prix|subvention|irrigation|semences|engrais|pesticide|bio|elevage",
}
# fixed values: tags and their canonical names
CANONICAL = {"mais": "maïs", "niebe": "niébé", "secheresse": "sécheresse", "temperature": "température", "humidite": "humidité", "innondation": "inondation"}


def tags(folded: str, words: str) -> Column:
    """Distinct canonical tags in a folded text, sorted."""
    names = F.create_map(*(F.lit(x) for kv in CANONICAL.items() for x in kv))
    found = F.regexp_extract_all(folded, F.lit(f"({words})"), 1)
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(found), lambda t: F.coalesce(F.try_element_at(names, t), t))))


def inner_product(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def search(df: DataFrame, vector: str, query: list[float], k: int) -> DataFrame:
    """The k rows of greatest inner product with a query: a scan with a top-k in each task, no shuffle of vectors."""
    q = F.array(*[F.lit(x) for x in query])
    key = "vec_id" if "vec_id" in df.columns else df.columns[0]
    return df.withColumn("score", inner_product(F.col(vector), q)).orderBy(F.desc(F.round("score", 5)), key).limit(k)


def _block_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                x = b.slice(i, size)
                m = np.array(x.column(1).to_pylist(), np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], ["ids", "matrix"]
                )

    return run


def _blocks(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(ids, matrix): rows of at most BLOCK vectors."""
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.mapInArrow(_block_batches(BLOCK), "ids array<long>, matrix binary").repartition(parts), "vector-blocks")


def _score_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for q_ids, q, e_ids, e in zip(*(c.to_pylist() for c in b.columns)):
                q_ids, e_ids = np.array(q_ids, np.int64), np.array(e_ids, np.int64)
                scores = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(e).reshape(len(e_ids), -1).T
                scores = np.sign(scores) * np.floor(np.abs(scores) * 1e5 + 0.5) / 1e5
                for i, s in zip(q_ids, scores):
                    s = np.where(e_ids == i, -np.inf, s)
                    best = np.lexsort((e_ids, -s))[:k]
                    out += [(i, e_ids[j], s[j]) for j in best if e_ids[j] != i]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(c), t) for c, t in zip(zip(*out), kinds)], ["query_id", "vec_id", "score"]
                )

    return run


def search_all(queries: DataFrame, df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): for each query the k other rows of greatest inner product, scores to 5 places.

    Blocks of queries meet blocks of rows in matrix products; k hits of each query
    and block are merged. Equal scores go by id.
    """
    q, e = _blocks(queries, key, vector), _blocks(df, key, vector)
    pairs = q.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")).crossJoin(e)
    hits = pairs.mapInArrow(_score_batches(k), "query_id long, vec_id long, score double")
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


LISTS, SAMPLE = 64, 20_000


def centroids(df: DataFrame, key: str, vector: str, lists: int = LISTS, sample: int = SAMPLE, rounds: int = 15) -> np.ndarray:
    """Centres of ``lists`` groups of vectors by k-means on a bounded sample: the ``sample`` rows least by hash of their key, or all."""
    some = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(vector, F.xxhash64(key).alias("h")).orderBy("h").limit(sample)
    x = np.array([r[0] for r in some.select(vector).collect()], np.float64)
    if not len(x):
        return np.empty((0, 0))
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _list_batches(centres: np.ndarray, probes: int | None):
    """Rows with the list that each belongs to, or (for queries) the lists of greatest inner product with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column(1).to_pylist(), np.float64)
            if probes is None:
                lists = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)[:, None]
            else:
                lists = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(x)), lists.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["list", "id", "vector"])

    return run


def _list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one list as blocks of at most BLOCK vectors."""
    for b in batches:
        lists = b.column(0).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        rows = []
        for lo, hi in zip(edges, edges[1:]):
            for i in range(lo, hi, BLOCK):
                x = b.slice(i, min(BLOCK, hi - i))
                rows.append((int(lists[lo]), x.column(1).to_pylist(), np.array(x.column(2).to_pylist(), np.float64).tobytes()))
        if rows:
            kinds = (pa.int32(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["list", "ids", "matrix"])


def build_lists(df: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int | None = None) -> DataFrame:
    """(list, ids, matrix): every row in the list of its nearest centre; with ``probes`` queries in the lists they look into.

    A list is spread over partitions, so that one that holds a third of all rows makes more blocks, not a larger task.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), vector)
    x = rows.mapInArrow(_list_batches(centres, probes), "list int, id long, vector array<float>")
    x = x.repartition(F.pmod(F.xxhash64("id"), F.lit(64))).sortWithinPartitions("list")
    return stage(x.mapInArrow(_list_blocks, "list int, ids array<long>, matrix binary"), "vector-lists")


def search_lists(queries: DataFrame, df: DataFrame, key: str, vector: str, k: int, probes: int = 40, lists: int = LISTS) -> DataFrame:
    """(query_id, vec_id, score, rank) like search_all, from the ``probes`` most promising of ``lists`` lists only: approximate.

    Recall against search_all is measured in the tests and the README; more probes give more of it.
    """
    c = centroids(df, key, vector, lists)
    if not len(c):
        return queries.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    q = build_lists(queries, key, vector, c, min(probes, max(1, len(c)))).select("list", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    pairs = q.join(build_lists(df, key, vector, c), "list").drop("list")
    hits = pairs.mapInArrow(_score_batches(k), "query_id long, vec_id long, score double")
    return top_k(hits, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
