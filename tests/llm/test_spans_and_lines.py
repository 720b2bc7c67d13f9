"""Shared spans and repeated lines against brute force."""

import os
import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from granary.llm import queries, repeated_lines, shared_spans
from tests.helpers import SF_TINY


def brute(texts, n):
    """(pairs, covered characters) by all windows of n characters."""
    where = defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t) - n + 1):
            where[t[p : p + n]].add(i)
    pairs, cover = set(), {}
    for ids in where.values():
        ids = sorted(ids)
        pairs.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for i, t in texts.items():
        m = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if len(where[t[p : p + n]]) > 1:
                m[p : p + n] = b"\1" * n
        cover[i] = sum(m)
    return pairs, cover


def texts(seed, count=60, n=40):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé \n") for _ in range(rnd.randint(1, 9)))
    shared = ["".join(word() for _ in range(rnd.randint(5, 40))) for _ in range(12)]
    out = {}
    for i in range(count):
        parts = ["".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(3)]
        if rnd.random() < 0.7:
            parts.insert(rnd.randint(0, 3), rnd.choice(shared))
        if rnd.random() < 0.2:
            s = rnd.choice(shared)
            parts.insert(rnd.randint(0, 3), s[: rnd.randint(n - 2, n + 2)])
        out[i] = "".join(parts)
    out[900], out[901], out[902] = "", "x" * 500, "y" + "x" * 300 + "z"
    out[903] = out[5]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_coverage_are_exact(spark, seed):
    t = texts(seed)
    rows = [*t.items(), (950, None), (None, "a" * 300), (5, t[5])]
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("h", F.lit("clash"))
    pairs, cover = brute(t, 40)
    assert {tuple(r) for r in shared_spans.shared_pairs(df, 40).collect()} == pairs
    got = {r.doc: r for r in shared_spans.coverage(df, 40).collect()}
    assert {i: r.shared_chars for i, r in got.items()} == cover


def test_hot_paths_by_windows(spark, monkeypatch):
    core = "".join(random.Random(3).choice("abcdef") for _ in range(30))
    rnd = random.Random(4)
    t = {i: "".join(rnd.choice("ab") for _ in range(30)) + core + "".join(rnd.choice("ab") for _ in range(30)) for i in range(50)}
    df = spark.createDataFrame(list(t.items()), "doc long, text string")
    monkeypatch.setattr(shared_spans.shared, "__defaults__", (200, 4))
    assert {tuple(r) for r in shared_spans.shared_pairs(df, 36).collect()} == brute(t, 36)[0]


@pytest.mark.parametrize("size", [10, 30, 60])
def test_coverage_of_hot_paths_is_exact(spark, monkeypatch, size):
    rnd = random.Random(size)
    some = lambda n: "".join(rnd.choice("abcdef") for _ in range(n))
    core, lefts, rights = some(size), [some(70) for _ in range(4)], [some(70) for _ in range(4)]
    t = {}
    for i in range(60):  # some share more text around the core, on one side or both
        left = rnd.choice(lefts)[rnd.randint(0, 69) :] if rnd.random() < 0.6 else ""
        right = rnd.choice(rights)[: rnd.randint(0, 69)] if rnd.random() < 0.6 else ""
        t[i] = some(40) + left + core + right + some(40)
    t[60] = some(50) + core + some(50) + core + some(50)
    monkeypatch.setattr(shared_spans.shared, "__defaults__", (200, 4))
    df = spark.createDataFrame(list(t.items()), "doc long, text string")
    pairs, cover = brute(t, 36)
    assert {r.doc: r.shared_chars for r in shared_spans.coverage(df, 36).collect()} == cover
    assert {tuple(r) for r in shared_spans.shared_pairs(df, 36).collect()} == pairs


def test_passages_have_places(spark):
    t = texts(1)
    want = set()
    for i, text in t.items():
        m = [any(text[p : p + 40] in u for j, u in t.items() if j != i) for p in range(len(text) - 39)]
        at = [p for p, x in enumerate(m) if x]
        for k, p in enumerate(at):
            if k == 0 or p > at[k - 1] + 40:
                start = p
            if k + 1 == len(at) or at[k + 1] > p + 40:
                want.add((i, start, p + 40))
    df = spark.createDataFrame(list(t.items()), "doc long, text string")
    got = shared_spans.merged_spans(df, 40)
    assert got.columns == ["doc", "start", "end"] and "p10_spans" in queries.queries()
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("hot", [64, 2])
def test_groups_stand_for_all_pairs(spark, monkeypatch, hot):
    t = texts(1)
    monkeypatch.setattr(shared_spans.shared, "__defaults__", (200, hot))
    df = spark.createDataFrame(list(t.items()), "doc long, text string")
    members = defaultdict(list)
    for r in shared_spans.groups(df, 40).collect():
        members[r.passage].append((r.doc, t[r.doc][r.start : r.end]))
    pairs = set()
    for rows in members.values():
        assert len({x for _, x in rows}) == 1 and len(rows[0][1]) >= 40
        docs = sorted({d for d, _ in rows})
        pairs |= {(a, b) for i, a in enumerate(docs) for b in docs[i + 1 :]}
    assert pairs == {tuple(r) for r in shared_spans.shared_pairs(df, 40).collect()}


def test_empty_spans(spark):
    assert shared_spans.shared_pairs(spark.createDataFrame([], "doc long, text string"), 200).count() == 0


def letters(s):
    return "".join(c for c in s if c.isalpha()).lower()


def test_lines_match_brute_force(spark):
    rnd = random.Random(9)
    stock = ["Haut de page", "• HAUT DE PAGE (12)", "12", "", "a", "Tous droits réservés — " + "mot " * 60, "Mot court"]
    rows = []
    for i in range(120):
        body = [rnd.choice(stock) if rnd.random() < 0.4 else f"ligne {rnd.choice('abcdefgh') * rnd.randint(1, 30)}" for _ in range(rnd.randint(0, 12))]
        rows.append((i, "s1" if i % 3 else rnd.choice(["s2", None]), "\n".join(body)))
    rows += rows[:20] + [(500, "s1", None), (501, "s1", "")]
    seen = defaultdict(set)
    for i, s, t in rows:
        for line in (t or "").split("\n"):
            seen[s, letters(line)].add(i)
    want = {(i, n) for i, s, t in rows if s for n, line in enumerate((t or "").split("\n"), 1) if letters(line) and len(seen[s, letters(line)]) >= 8}
    df = spark.createDataFrame(rows, "doc long, site string, text string").withColumn("line", F.lit(1))
    found = repeated_lines.repeated_lines(df, 8)
    assert {tuple(r) for r in found.collect()} == want
    clean = {r.doc: r.text for r in repeated_lines.without_lines(df.dropDuplicates(["doc"]), found).collect()}
    for i, s, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want)
        assert clean[i] == kept


def notices(wrap):
    """A site's pages with the same notice, its lines broken at other places in each."""
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    notice = words(120)
    out = []
    for i in range(20):
        mine = notice.split() if i < 12 else words(120).split()
        k = rnd.randint(5, 17) if wrap else 24
        lines = [" ".join(mine[j : j + k]) for j in range(0, len(mine), k)]
        out.append((i, "s", words(30) + "\n" + "\n".join(lines) + "\n" + words(30)))
    return notice, out


def test_chunks_carry_long_lines(spark, monkeypatch):
    """Without repeated chunks no line that holds one is found."""
    _, rows = notices(wrap=False)
    df = spark.createDataFrame(rows, "doc long, site string, text string")
    found = repeated_lines.repeated_lines(df, 8).count()
    real = repeated_lines.over
    monkeypatch.setattr(repeated_lines, "over", lambda df, key, n: real(df, key, n).where(F.lit(key != "chunk")))
    assert found == 12 * 5 and repeated_lines.repeated_lines(df, 8).count() < found / 2


def test_notice_wrapped_otherwise(spark):
    notice, rows = notices(wrap=True)
    df = spark.createDataFrame(rows, "doc long, site string, text string")
    spans = repeated_lines.repeated_spans(df, 8)
    clean = {r.doc: r.text for r in repeated_lines.without_spans(df, spans).collect()}
    for i, _, text in rows:
        if i < 12:  # the notice but for its ends, and nothing else
            assert len(letters(text)) - len(letters(clean[i])) > 0.8 * len(letters(notice))
            assert clean[i].split("\n")[0] == text.split("\n")[0] and clean[i].split("\n")[-1] == text.split("\n")[-1]
        else:
            assert clean[i] == text
    assert repeated_lines.repeated_spans(df.where("doc < 7"), 8).count() == 0
    lines, same = repeated_lines.repetitions(df, 8)
    assert {tuple(r) for r in same.collect()} == {tuple(r) for r in spans.collect()}
    assert {tuple(r) for r in lines.collect()} == {tuple(r) for r in repeated_lines.repeated_lines(df, 8).collect()}
    both = {r.doc: r.text for r in repeated_lines.without_repetitions(df, lines, same).collect()}
    assert len(both) == len(rows) and all(both[i] == text for i, _, text in rows if i >= 12)
    assert all(letters(both[i]) == letters(clean[i]) for i, _, _ in rows)
    empty = spark.createDataFrame([(1, None, "a"), (2, "s", None), (3, "s", "")], "doc long, site string, text string")
    assert repeated_lines.repeated_spans(empty, 1).count() == 0


@pytest.mark.parametrize("name", ["p6_found", "p7_found"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF_TINY):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF_TINY}/{f}'")
    got = queries.queries()[name](spark, SF_TINY)
    want = con.execute(queries.oracle_sql()[name]).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert key(got.toPandas()) == key(want)
    assert all(re.match(r"p\d+_", q) for q in queries.queries())
