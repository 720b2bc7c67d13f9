"""Relational blocks, prefix sums, staging, sinks, profiles, graphs."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.urls import host, site
from granary.operators import graph, profiles, retrieval, textops
from granary.operators import relational as R
from granary.operators.prefix import prefix_sum
from granary.operators.retrieval import sentence_chunks
from granary.plans import documents, flows, messages, texts
from granary.plans.staging import bounded_broadcast, is_bounded, stage
from granary.sources import sinks
from tests.helpers import SF_SMALL, SF_TINY


def test_latest_by_key_takes_ties_by_whole_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "w"), (None, 1, "n")], "k string, t int, v string")
    got = {tuple(r) for r in R.latest_by_key(df, ["k"], ["t"]).collect()}
    assert got == {("a", 2, "z"), ("b", None, "w"), (None, 1, "n")}


def test_upsert_keeps_old_values_and_adds_keys(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "q")], "k string, n int, v string")
    u = spark.createDataFrame([("b", None, "z"), ("c", 9, "c"), (None, 4, None)], "k string, n int, v string")
    got = {tuple(r) for r in R.upsert(t, u, ["k"]).collect()}
    assert got == {("a", 1, "x"), ("b", 2, "z"), ("c", 9, "c"), (None, 4, "q")}


def test_lookup_splits_hot_keys(spark):
    rows = [(i, "hot" if i % 2 else None if i % 3 == 0 else f"k{i % 50}") for i in range(2000)]
    df = spark.createDataFrame([*rows, rows[1]], "id long, k string")
    t = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(40))], "o string, v long")
    want = sorted(R.lookup(df, t, "k", "o").collect(), key=str)
    assert sorted(R.lookup(df, t, "k", "o", rows=0, hot_rows=100).collect(), key=str) == want
    assert len(want) == 2001 and R.lookup(df.limit(0), t, "k", "o", rows=0).count() == 0


def test_broadcast_bound_counts_bytes(spark):
    df = spark.range(50).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.lit("ab"), F.lit(None)).alias("a"))
    assert is_bounded(df, 50) and not is_bounded(df, 49) and not is_bounded(df, 50, size=40_000) and is_bounded(df.limit(0), 0)


def test_prefix_sum_of_a_hot_group(spark):
    rows = [(("hot" if i % 3 else None) if i % 5 else "rare", i, i % 7) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    out = prefix_sum(df, ["g"], "id", F.col("v"), rows_per_bucket=100).collect()
    for g in ("hot", None, "rare"):
        own = sorted((r.before, r.before + r.v) for r in out if r.g == g)
        assert own[0][0] == 0 and all(a[1] <= b[0] or a[0] == b[0] for a, b in zip(own, own[1:]))
        assert max(e for _, e in own) == sum(r[2] for r in rows if r[0] == g)
    again = prefix_sum(df.repartition(13), ["g"], "id", F.col("v"), rows_per_bucket=100).collect()
    assert {(r.id, r.before) for r in out} == {(r.id, r.before) for r in again}


def test_prefix_sum_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, id long, v long")
    assert prefix_sum(empty, ["g"], "id", F.col("v")).count() == 0


def test_fan_out(spark):
    m = spark.createDataFrame([(1, "buy", "buy_n", "a1"), (2, "sell", "sell_n", "zz")], "message_id long, intent string, iz string, sender string")
    s = spark.createDataFrame([("a1", "buy", "i"), ("a2", "buy", "i"), ("a2", "buy_n", "z"), ("a3", "x", "i")], "agent string, topic string, kind string")
    assert {tuple(r) for r in R.fan_out(m, s, [("intent", "i"), ("iz", "z")]).collect()} == {(1, "a2")}


def test_bounded_broadcast(spark):
    small = spark.range(10)
    assert "ResolvedHint" in bounded_broadcast(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(small, 9)._jdf.queryExecution().analyzed().toString()
    assert stage(small.where("id > 100"), "none").count() == 0


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, t int, v string"
    sinks.write_upsert(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "b")], schema), path, ["k"], ["t"])
    sinks.write_upsert(spark.createDataFrame([("a", 3, None), ("c", 1, "c")], schema), path, ["k"], ["t"])
    assert {tuple(r) for r in sinks.current(spark, path).collect()} == {("a", 3, "y"), ("b", 1, "b"), ("c", 1, "c")}
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_new(spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 3)], "h string, n int"), log, "h")
    assert {tuple(r) for r in sinks.current(spark, log).collect()} == {("h1", 1), ("h2", 3)}
    # a version that didn't commit isn't read; older ones than the one before are gone
    spark.range(3).write.parquet(f"{path}/v00000009")
    os.remove(f"{path}/v00000009/_SUCCESS")
    assert sinks.versions(spark, path) == [1, 2] and sinks.current(spark, path).columns == ["k", "t", "v"]
    sinks.write_upsert(spark.createDataFrame([("d", 1, "d")], schema), path, ["k"], ["t"])
    assert sinks.versions(spark, path) == [2, 3] and sinks.current(spark, path).count() == 4
    sinks.write_csv(spark.createDataFrame([(1, "a\nb" + "c" * 600)], "i int, text string"), str(tmp_path / "csv"), "text")
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert row.text.startswith("a bccc") and len(row.text) == 500


def test_graph_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 2), (None, 1)], "src int, dst int")
    got = {(r.node, r.depth) for r in graph.bfs_depth(e, spark.createDataFrame([(1,)], "node int"), 3).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_profiles(spark):
    df = spark.sql("""select named_struct('place', 'A', 'plots', array(named_struct('id', '1', 'crop', 'mil'), named_struct('id', '2', 'crop', 'riz'))) as old,
        named_struct('place', cast(null as string), 'plots', array(named_struct('id', '2', 'crop', 'coton'), named_struct('id', '3', 'crop', 'soja'))) as new,
        array('Charrue', 'pompe') as tools, array('POMPE', 'Tracteur') as more, map('a', '1', 'b', '2') as m, map('b', '3') as n""")
    r = df.select(
        profiles.deep_merge(F.col("old"), F.col("new"), ["place", "plots"], {"plots": "id"}).alias("p"),
        profiles.add_without_case(F.col("tools"), F.col("more")).alias("t"), profiles.shallow_merge(F.col("m"), F.col("n")).alias("s"),
        profiles.shallow_merge(F.lit(None).cast("map<string,string>"), F.col("n")).alias("z"),
    ).first()
    assert r.p.place == "A" and [(x.id, x.crop) for x in r.p.plots] == [("1", "mil"), ("2", "coton"), ("3", "soja")]
    assert r.t == ["Charrue", "pompe", "Tracteur"] and r.s == {"a": "1", "b": "3"} and r.z == {"b": "3"}


def test_correct_words(spark):
    f = profiles.correct_words(["semence", "engrais"])
    got = [r[0] for r in spark.createDataFrame([("semance et engrai",), (None,)], "t string").select(f("t")).collect()]
    assert got == ["semence et engrais", None]


def test_text_operations(spark):
    t = F.col("t")
    r = spark.createDataFrame([("Bonjour, **le** monde\n\nPluie d'attention " + "x" * 400,)], "t string").select(
        textops.compress_message(t).alias("c"), textops.clean_control(F.lit("a\x01b\nc")).alias("k"), textops.segments(F.lit("abcde"), 2).alias("s"),
        textops.is_phone(F.lit("+226 70-12-34-56")).alias("ok"), textops.slug(F.lit(" Été & Maïs ! ")).alias("slug"),
    ).first()
    assert r.c.startswith("le monde 🌧️ d'⚠️ x") and len(r.c) == 320 and r.c.endswith("...")
    assert r.k == "ab\nc" and r.s == ["ab", "cd", "e"] and r.ok and r.slug == "ete-mais"


@pytest.mark.parametrize("url, want", [
    ("https://WWW.Pluie.Example:8080/a?b#c", "pluie.example"), ("http://m.x.example/p/é à", "x.example"), ("x.example", "x.example"),
    ("//user:pw@www.x.example./p", "x.example"), ("", None), (None, None), ("https://", None),
])
def test_site(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(site(F.col("u"))).first()[0] == want
    assert spark.createDataFrame([("HTTP://M.A.example:1/x",)], "u string").select(host(F.col("u"))).first()[0] == "m.a.example"


def test_sentence_chunks(spark):
    df = spark.createDataFrame([(1, "Un. Deux deux. Trois trois trois. " + "q" * 40 + "."), (2, ""), (3, None)], "id int, t string")
    got = [(r.id, r.chunk) for r in sentence_chunks(df, "t", 20).orderBy("id", "chunk_no").collect()]
    assert got == [(1, "Un. Deux deux."), (1, "Trois trois trois."), (1, "q" * 40 + ".")]


def test_search_takes_every_query_and_row(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rnd = np.random.default_rng(5)
    v = rnd.integers(-3, 4, (130, 8)).astype(float)  # many equal scores
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in retrieval.search_all(df.where("vec_id % 20 = 0"), df, "vec_id", "embedding", 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = {q: sorted(((i, float(v[i] @ v[q])) for i in range(130) if i != q), key=lambda x: (-x[1], x[0]))[:4] for q in range(0, 130, 20)}
    assert got == want


def test_texts_are_taken_whole(spark, tmp_path):
    long = "Été à Pô: " * 200  # 2000 characters
    rows = [(1, long, "fr"), (2, "  Le Maïs\u00a0ﬁn ½ \n", None), (3, "", "xx"), (4, None, "fr"), (5, "-" * 90 + "A?b", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    q = lambda f: f(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.key for r in q(documents.accent_normalise)} == {
        1: ("ete a po: " * 200).strip(), 2: "le mais fin 1⁄2", 3: "", 4: "", 5: "-" * 90 + "a?b"}
    segments = q(documents.sms_segments)
    assert {r.doc_id for r in segments} == {1, 2, 5} and sorted(len(r.segment) for r in segments if r.doc_id == 1) == [80] + [160] * 12
    got = {r.doc_id: (r.slug, r.file_name) for r in q(documents.slugs)}
    assert got[1] == ("-".join(["ete-a-po"] * 200), ("Été à Pô_ " * 7)) and got[5] == ("a-b", "-" * 70)
    assert got[3] == ("", "") and got[4] == (None, None) and set(got) == {1, 2, 3, 4, 5}


def test_every_event_enters_the_upsert(spark):
    keys = messages.events(spark, SF_TINY).select("user_id", "event_type").distinct()
    got = messages.upsert_column_subset(spark, SF_TINY).select("user_id", "event_type")
    assert got.count() == keys.count() > 0 and got.exceptAll(keys).count() == 0


def test_plots_and_profiles(spark):
    empty = spark.sql("select cast(null as array<struct<crop:string,status:string,area_ha:double,soil_type:string,planting_date:string>>) as plots")
    new = F.struct(F.lit("Mil").alias("crop"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("double").alias("area_ha"), F.lit(None).cast("string").alias("soil_type"), F.lit("2024-06-01").alias("planting_date"))
    one = empty.select(profiles.add_plot(F.col("plots"), new).alias("plots"))
    two = one.select(profiles.add_plot(F.col("plots"), F.struct(F.lit("MIL").alias("crop"), F.lit("ACTIVE").alias("status"), F.lit(2.0).alias("area_ha"), F.lit(None).cast("string").alias("soil_type"), F.lit(None).cast("string").alias("planting_date"))).alias("plots"))
    assert [tuple(p) for p in two.first().plots] == [("Mil", "ACTIVE", 2.0, None, "2024-06-01")]
    nothing = F.lit(None)
    text = profiles.profile_text(F.lit(""), nothing.cast("string"), nothing.cast("array<struct<crop:string,status:string,area_ha:double,soil_type:string,planting_date:string>>"),
                                 nothing.cast("array<struct<type:string,count:int>>"), nothing.cast("array<string>"), nothing.cast("double"), nothing.cast("string"), nothing.cast("int"))
    assert spark.range(1).select(text).first()[0] == ""


def test_urgent_payloads(spark):
    rows = [('{"a": {"b": {"c": "Une ÉPIDÉMIE ici"}}}', True), ('{"a": ["urgence"]}', False), ('{"photo": "x.jpg"}', True), ('{"photo": ""}', False), ('{"urgent": "non"}', False), ("[1]", False), ("{", False), (None, False)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert all(r.got == r.want for r in df.select("want", flows.urgent_payload(F.col("p")).alias("got")).collect())


def test_embedding_hook(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "i int, t string")
    out = texts.embed(df, "t", lambda batch: [[float(len(x)), 1.0, 2.0] for x in batch], 2)
    assert {r.i: r.embedding for r in out.collect()} == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}


def test_approximate_search_finds_nine_in_ten(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    want = {(r.query_id, r.vec_id) for r in retrieval.search_all(q, e, "vec_id", "embedding", 10).collect()}
    got = {(r.query_id, r.vec_id) for r in retrieval.search_lists(q, e, "vec_id", "embedding", 10).collect()}
    print("recall", len(want & got) / len(want))
    assert len(want & got) >= 0.9 * len(want) and len(got) == len(want)
    c = retrieval.centroids(e, "vec_id", "embedding")
    assert sum(len(r.ids) for r in retrieval.build_lists(e, "vec_id", "embedding", c).collect()) == e.count()  # every row is indexed
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)], "vec_id long, embedding array<float>")
    assert retrieval.search_lists(same.limit(2), same, "vec_id", "embedding", 3).count() == 6 and retrieval.search_lists(same, same.limit(0), "vec_id", "embedding", 3).count() == 0


def chunked(text, size, overlap):
    done, open_ = [], []
    for s in [x for x in re.split(r"(?<=[.!?])\s+", text) if x]:
        if not open_ or len(" ".join([*open_, s])) <= size:
            open_.append(s)
            continue
        done.append(" ".join(open_))
        kept = []
        for x in reversed(open_):
            if len(" ".join([x, *kept])) > min(overlap, size - 1 - len(s)):
                break
            kept.insert(0, x)
        open_ = [*kept, s]
    return done + ([" ".join(open_)] if open_ else [])


@pytest.mark.parametrize("size, overlap", [(650, 120), (200, 60), (80, 0)])
def test_sentence_chunks_with_overlap(spark, size, overlap):
    df = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "Un. Deux! Trois? " + "x" * 700 + ". Fin."), (-2, ""), (-3, None)], "doc_id long, text string")
    df = df.unionByName(extra)
    got = {}
    for r in sentence_chunks(df, "text", size, overlap).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_no, r.chunk))
    for r in df.collect():
        want = chunked(r.text, size, overlap) if r.text is not None else []
        assert [c for _, c in sorted(got.get(r.doc_id, []))] == want
