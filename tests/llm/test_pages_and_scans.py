"""Boilerplate and scanned texts on planted cases."""

import random

from pyspark.sql import functions as F

from granary.llm import boilerplate, scans

PARAGRAPH = "Les maraîchers de {} arrosent seulement le matin avec {} pompes remises en état, et la prochaine visite concernera {} parcelles."


def page(i, host):
    rnd = random.Random(i)
    name = lambda: rnd.choice("BDGKLMNPRSTVZ") + "".join(rnd.choice(["ani", "ebo", "ora", "uti", "ago"]) for _ in range(3))
    title = f"Marché de {name()} {name()} : que vaut le mil"
    body = [title, f"Par {name()} {name()}", PARAGRAPH.format(name(), i, 3 * i), f"Un autre titre sur {name()} {name()} et {name()}",
            PARAGRAPH.format(name(), i + 1, 5), f"- mil à {name()} : {1000 + i} F le sac", PARAGRAPH.format(name(), i + 2, 7)]
    top = ["Rubrique des saisons", "Espace membres", "Tout accepter", f"Accueil > {title}"]
    end = ["Lettre aux abonnés du réseau", f"{i} partages", "Dans la même série", f"{rnd.randint(1, 9)}. Récolte vue de {name()} {name()}",
           "Mots-clés : mil, " + name(), f"© 2024 {host}"]
    lines, main = [], []
    for part, is_main in ((top, False), (body, True), (end, False)):
        for x in part:
            lines.append(x)
            main.append(is_main)
            if i % 2:
                lines.append("")
                main.append(None)
    return title, "\n".join(lines), main


def test_pages(spark):
    rows, want = [], set()
    for i in range(60):
        host = f"h{i % 2}.example"
        title, text, main = page(i, host)
        rows.append((i, host, title if i % 5 else None, None, text))
        want |= {(i, n) for n, m in enumerate(main, 1) if m is False}
    rows += [rows[0], (100, None, None, None, None), (101, "h0.example", None, None, ""), (102, None, None, None, PARAGRAPH.format("X", 1, 2))]
    df = spark.createDataFrame(rows, "page long, site string, title string, author string, text string").withColumn("node", F.lit("clash"))
    got = [tuple(r) for r in boilerplate.boilerplate_lines(df).collect()]
    assert len(got) == len(set(got))
    assert len(want - set(got)) <= 0.01 * len(want) and len(set(got) - want) <= 0.01 * len(want)
    assert boilerplate.boilerplate_lines(df.limit(0)).count() == 0


NOTICE = "Ce site " + " ".join(["est édité par le réseau et la réutilisation de ses pages demande un accord écrit du bureau,"] * 7) + " sans exception."


def test_long_notice_of_a_host_is_template(spark):
    """A notice of over 600 characters on every page of a host is boilerplate; a long paragraph that varies isn't."""
    assert len(NOTICE) > 600
    rows = []
    for i in range(30):
        title, text, main = page(i, "h.example")
        long = " ".join(PARAGRAPH.format("Zo" + chr(97 + i % 26) * (1 + i // 26) + chr(97 + j), i, j) for j in range(7))
        rows.append((i, "h.example", title, None, f"{text}\n{long}\n{NOTICE}"))
    df = spark.createDataFrame(rows, "page long, site string, title string, author string, text string")
    got = {tuple(r) for r in boilerplate.boilerplate_lines(df).collect()}
    for i, _, _, _, text in rows:
        n = text.count("\n") + 1
        assert (i, n) in got and (i, n - 1) not in got


def test_share_keeps_frequent_headings(spark):
    """On a large host a heading that stands in few of its articles isn't template; on a host with a template cue words don't count."""
    rows = []
    for i in range(400):
        title, text, _ = page(i, "h.example")
        lines = text.split("\n")
        at = next(k for k, x in enumerate(lines) if x.startswith("Les maraîchers"))
        if i % 80 == 0:
            lines.insert(at + 1, "Le contexte")
        if i == 7:
            lines.insert(at + 1, PARAGRAPH.format("Zeba", 1, 2) + " La newsletter des paysans et leurs données personnelles y sont nées.")
        rows.append((i, "h.example", title, None, "\n".join(lines)))
    df = spark.createDataFrame(rows, "page long, site string, title string, author string, text string")
    cut = {(r.page, r.line_no) for r in boilerplate.boilerplate_lines(df).collect()}
    lines = {i: text.split("\n") for i, _, _, _, text in rows}
    assert not [p for p, n in cut if lines[p][n - 1] == "Le contexte" or "newsletter" in lines[p][n - 1]]


def test_partial_tree_alignment():
    pages = [([1, 2, 3], [1, 1, 1], 10), ([1, 4, 3], [1, 1, 1], 11), ([4, 5, 3], [1, 1, 1], 12), ([9], [1], 13), ([], [], 14), ([9, 9], [1, 1], 13)]
    assert boilerplate.align(pages) == {(1, 10), (1, 11), (3, 10), (3, 11), (3, 12), (4, 11), (4, 12)}


def test_simple_tree_matching():
    assert boilerplate.simple_tree_matching([1, 2, 3, 4], [1, 1, 1, 1], [2, 9, 4, 1]) == [3, 1]
    assert boilerplate.simple_tree_matching([1, 2], [1, 9], [2, 1]) == [1]  # the heavier one
    assert boilerplate.simple_tree_matching([], [], [1]) == []
    rnd = random.Random(0)
    for _ in range(200):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(0, 9))] for _ in range(2))
        w = [rnd.randint(1, 4) for _ in a]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (1 + w[i] if a[i] == b[j] else 0))
        assert sum(1 + w[i] for i in boilerplate.simple_tree_matching(a, w, b)) == best[-1][-1]


SCAN = """Situation du riz à Kanavi

Depuis la fin janvier, les maraîchers observent un jaun-
issement des feuilles dans la plaine, et les membres de
la coopérative ont rcnforcé les diguettes du bas-
fond avant la réunion. Les pompes sont remises en état
et la récolte reste à vérifier dans les villages voi¬
12
SITUATION DU RIZ À KANAVI

sins de Zalotara.

Marché de Zirato
599
91
663
soit le total

Les feuilles sèchent, les maraîchers attendent la pluie
13
SITUATI0N DU RlZ À KANAVI
et les membres de la coopérative vendent la réc0lte."""


def test_scans(spark):
    clean = [
        "Les maraîchers observent un jaunissement des feuilles dans la plaine, et les membres de la coopérative ont renforcé les diguettes du bas-fond.",
        "Les pompes sont remises en état et la récolte reste à vérifier dans les villages voisins. Les maraîchers attendent la pluie et la réunion.",
    ]
    rows = [(f"c{i}", "content", None, clean[i % 2]) for i in range(60)]
    rows += [("s", "content", "Situation du riz à Kanavi", SCAN), ("s", "content", "Situation du riz à Kanavi", SCAN), ("n", "content", None, None), ("e", "content", None, "")]
    df = spark.createDataFrame(rows, "item string, field string, title string, text string").withColumn("n", F.lit(0))
    got = {(r.line_no, r.fault) for r in scans.faults(df).collect() if r.item == "s"}
    assert {n for n, f in got if f == "furniture"} == {8, 9, 20, 21}
    assert {n for n, f in got if f == "hyphen"} == {3, 7}
    assert {n for n, f in got if f == "misread"} == {5, 22}
    assert not [r for r in scans.faults(df).collect() if r.item != "s"]
    text = next(r.text for r in scans.repair(df).collect() if r.item == "s")
    assert "un jaunissement des feuilles" in text and "ont renforcé les diguettes du bas-fond avant" in text.replace("bas- fond", "bas-fond")
    assert "villages voisins de Zalotara." in text and "la récolte." in text and "SITUATI" not in text


def test_empty_scans(spark):
    df = spark.createDataFrame([], "item string, field string, title string, text string")
    assert scans.faults(df).count() == 0 and scans.repair(df).count() == 0


def test_page_numbers():
    assert scans.page_number("- 119 -") == ("dash", 119) and scans.page_number("Page l2O") == ("word", 120) and scans.page_number("5/lO") == ("slash", 5)
    assert scans.page_number("   12 ") == ("plain", 12) and scans.page_number("12 kg") is None and scans.roman_number("xiv") == 14
    assert scans.number_chain([(10, "plain", 2), (15, "plain", 900), (40, "plain", 3), (70, "plain", 4)]) == {10, 40, 70}


def test_short_words_are_no_page_numbers(spark):
    """A line may be a short word of letters that stand for figures in other cases, as where a text is cut short."""
    for line in ("sol", "sols.", "so", "Lo", "bois", "12b", "LL", "- s -", "page sol", "s/b", "ıı", "3ſ"):
        assert scans.page_number(line) is None
    assert scans.page_number("PAGE SO") == ("word", 50) and scans.page_number("Page 3 SUR 12") == ("word", 3)
    assert scans.roman_number("xı") == 11 and scans.roman_number("İV") == 4
    rows = [("a", "content", None, "Les maraîchers observent un jaunissement des feuilles\nso"), ("b", "content", None, "Le fumier va au\nsol\nxı")]
    df = spark.createDataFrame(rows, "item string, field string, title string, text string")
    assert scans.faults(df).count() == 0
    assert {r.item: r.text for r in scans.repair(df).collect()} == {"a": "Les maraîchers observent un jaunissement des feuilles so", "b": "Le fumier va au sol xı"}
