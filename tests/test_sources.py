"""File, HTML and service sources on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from granary.plans import pages, registry
from granary.sources import files, html, polling, sinks
from tests.helpers import SF_TINY

PAGE = """<html><head><title> Prix du mil </title><meta property="og:description" content="Une note">
<script type="application/ld+json">{"@type": "Article", "headline": "Le mil", "author": [{"name": "A. B."}], "datePublished": "2024-01-02", "dateModified": "2024-02-03"}</script></head>
<body><nav><a href="/menu">Menu</a></nav><article><h1>Le mil</h1><p>Le prix du mil monte dans la plaine.</p><p>court</p>
<p>Une autre phrase assez longue <a href="doc/a.pdf#p2">note</a>.</p></article><a href="doc/a.pdf">encore</a><a href="mailto:x@y">m</a>
<a href="https://other.example/d.csv">data</a><dl><dt>Producteur :</dt><dd>INS</dd></dl><footer>pied de page</footer></body></html>"""


def fetch(region, start, end):
    if region == "bad":
        raise RuntimeError("down")
    return {"time": ["2024-01-01", "2024-01-02"], "precipitation_sum": [1.5, None], "sunrise": ["05:58", "05:59"]}


def test_html(spark):
    df = spark.createDataFrame([(PAGE, "https://site.example/x/"), (None, None), ("<p>broken <b", "u")], "h string, u string")
    rows = df.select(html.article("h").alias("a"), html.blocks("h").alias("b"), html.links("h", "u").alias("l"), html.pairs("h").alias("p"), html.report("h").alias("r")).collect()
    a = rows[0].a
    assert (a.title, a.author, a.published, a.description) == ("Le mil", "A. B.", "2024-01-02", "Une note")
    assert a.modified == "2024-02-03"
    assert a.content.startswith("Le prix du mil monte") and "court" not in a.content and "pied" not in a.content
    assert [(x.url, x.kind, x.same_host) for x in rows[0].l] == [
        ("https://site.example/menu", "page", True), ("https://site.example/x/doc/a.pdf", "pdf", True), ("https://other.example/d.csv", "data", False)]
    assert rows[0].p == {"Producteur": "INS"} and rows[0].b.title == "Prix du mil" and rows[0].r is None
    assert rows[1].a.title is None and rows[1].l == [] and rows[2].b.title is None


def test_reports(spark):
    text = "Une phrase du rapport qui dit quelque chose. " * 6
    rows = [(f"<div id='main-content'><p>{text}</p><div class='breadcrumb'>Accueil</div></div><p>dehors</p>", True), (f"<section class='x node--type-report'><p>{text}</p></section>", True),
            (f"<div><p>{text}</p></div>", False), ("<main><p>court</p></main>", False)]
    got = spark.createDataFrame(rows, "h string, ok boolean").select("ok", html.report("h").alias("r")).collect()
    for r in got:
        assert (r.r == text.strip()) if r.ok else r.r is None


def test_forms(spark):
    page = """<h1>Enquête</h1><div class='freebirdFormviewerComponent'><div role='heading'>Quelle <b>culture</b> ?</div><span class='aOptionText'>Mil</span>
    <div class='xOption'><span class='yOptionText'>Riz</span></div></div><div role='heading'>Combien ?</div>"""
    got = [r.f for r in spark.createDataFrame([(page,), (None,), ("<p>rien",)], "h string").select(html.form("h").alias("f")).collect()]
    assert got[0].title == "Enquête" and [(q.question, q.options) for q in got[0].questions] == [("Quelle culture ?", ["Mil", "Riz"]), ("Combien ?", [])]
    assert got[1].title is None and got[1].questions == [] and got[2].questions == []


def test_link_columns(spark):
    u = F.col("u")
    df = spark.createDataFrame([
        ("https://docs.example/spreadsheets/d/abc_1/edit",), ("https://docs.example/forms/d/e/F-9/view",), ("https://h.example/docs/bulletin/n1",),
        ("https://h.example/bulletin",), ("https://x.example/a.XLSX?dl=1",), ("https://x.example/A.PDF",), ("https://h.example/docs/index",)], "u string")
    got = df.select(html.shared_link(u).alias("s"), html.index_link(u, "https://h.example/docs/index", ("bulletin", "index")).alias("i"), html.file_format(u).alias("f")).collect()
    assert (got[0].s.kind, got[0].s.id) == ("sheet", "abc_1") and (got[1].s.kind, got[1].s.id) == ("form", "F-9")
    assert [r.i for r in got] == [False, False, True, False, False, True, False] and got[4].f == "Excel"
    assert spark.sql("select '10.4060/CD3185EN' as d").select(html.publication_code(F.col("d"))).first()[0] == "cd3185en"


def test_json_files(spark, tmp_path):
    w = {"metadata": {"zone_name": "z", "latitude": 1.0, "longitude": 2.0}, "daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [30.0], "precipitation_sum": [0.0, 5.0]}}
    (tmp_path / "w.json").write_text(json.dumps(w, indent=1))
    got = files.weather(spark, str(tmp_path / "w.json")).orderBy("day").collect()
    assert [(r.zone, str(r.day), r.t_max, r.rain) for r in got] == [("z", "2024-01-01", 30.0, 0.0), ("z", "2024-01-02", None, 5.0)]
    (tmp_path / "s.json").write_text(json.dumps({"metadata": {"lat": 1.0, "lon": 2.0}, "layers": {"sand": {"0-5cm": {"mean": 593.0, "uncertainty": 1.0}}}}))
    assert files.soil(spark, str(tmp_path / "s.json")).first()[2:5] == ("sand", "0-5cm", 593.0)
    (tmp_path / "c.json").write_text(json.dumps({"results": [{"url": "u", "metadata": {"city": "B", "raw_data": [{"title": "t", "series": [{"name": "n", "data": [{"category": 0, "y": 2.5}]}, {"name": "e", "data": []}]}]}}]}))
    assert {(r.city, r.series, r.value) for r in files.charts(spark, str(tmp_path / "c.json")).collect()} == {("B", "n", 2.5), ("B", "e", None)}
    (tmp_path / "p.json").write_text(json.dumps({"prices": {"mil": {"price": 300.0, "aliases": ["petit mil"]}}}))
    d = spark.createDataFrame([("mil", 250.0, 0.1), ("riz", 400.0, 0.2)], "key string, price double, volatility double")
    got = files.prices(spark, str(tmp_path / "p.json"), d).collect()
    assert {(r.key, r.price, r.fair_price, r.volatility, tuple(r.aliases)) for r in got} == {("mil", 300.0, 300.0, 0.1, ("petit mil",)), ("riz", 400.0, 400.0, 0.2, ("riz",))}
    o = spark.createDataFrame([("VENTE", "Maïs", 2.0, "Nord", "x")], "side string, commodity string, quantity double, location string, contact string")
    z = spark.createDataFrame([("mil", "high", "mai")], "key string, name string, value string")
    assert files.offers(spark, str(tmp_path / "p.json"), o).first().commodity == "mais" and files.seasons(spark, str(tmp_path / "p.json"), z).first().value == "mai"
    (tmp_path / "q.json").write_text(json.dumps({"offers": [{"side": "ACHAT", "commodity": "Niébé", "quantity": 5}], "seasonal": {"Riz": {"high": "juin", "low": "oct"}}}))
    assert [tuple(r)[:3] for r in files.offers(spark, str(tmp_path / "q.json"), o).collect()] == [("ACHAT", "niebe", 5.0)]
    assert {tuple(r) for r in files.seasons(spark, str(tmp_path / "q.json"), z).collect()} == {("riz", "high", "juin"), ("riz", "low", "oct")}


def test_folders_and_cards(spark, tmp_path):
    os.makedirs(tmp_path / "docs" / "meteo")
    for name, text in (("a.txt", "alpha"), ("meteo/b.json", "{}"), ("a_meta.json", "{}"), ("c.log", "x"), ("d.tmp", "x")):
        (tmp_path / "docs" / name).write_text(text)
    got = files.documents(spark, str(tmp_path / "docs"))
    assert {r.file_name for r in got.collect()} == {"a.txt", "b.json"}
    assert {r.c.category for r in got.select(files.path_class(F.col("path")).alias("c")).collect()} == {"climate", "general"}
    (tmp_path / "v.vcf").write_text("BEGIN:VCARD\nFN:Awa\nTEL;CELL:+226 70 00\nEND:VCARD\nBEGIN:VCARD\nFN:Again\nTEL:+2267000\nEND:VCARD\nBEGIN:VCARD\nFN:No\nEND:VCARD\n")
    assert [tuple(r) for r in files.contacts(spark, str(tmp_path / "v.vcf")).collect()] == [("Awa", "+2267000")]


def test_polling_isolates_failures(spark):
    polling.register(spark)
    df = spark.read.format("poll").option("regions", "n,bad,s").option("fetch", "tests.test_sources:fetch").load()
    got = {(r.region, r.day, r.metric, r.value, bool(r.error)) for r in df.collect()}
    rain = "precipitation_sum"
    assert got == {("n", "2024-01-01", rain, "1.5", False), ("n", "2024-01-02", rain, None, False), ("s", "2024-01-01", rain, "1.5", False), ("s", "2024-01-02", rain, None, False),
                   ("bad", None, None, None, True)}
    all_ = spark.read.format("poll").option("regions", "n").option("fetch", "tests.test_sources:fetch").option("metrics", "*").load()
    assert {(r.metric, r.value) for r in all_.collect()} == {(rain, "1.5"), (rain, None), ("sunrise", "05:58"), ("sunrise", "05:59")}


def test_catalogue(spark):
    names = {x["name"] for x in registry.C.describe()}
    assert "routing_fallback" in names and all(x["description"] for x in registry.C.describe())
    with pytest.raises(KeyError):
        registry.C.call(spark, SF_TINY, "nothing")
    with pytest.raises(TypeError):
        registry.C.call(spark, SF_TINY, "urls_absolute", limit=3)
    views = registry.C.expose(spark, SF_TINY)
    assert spark.sql("select count(*) as n from q_urls_absolute where url = ''").first().n > 0 and len(views) == len(names)


def test_resources(spark):
    assert pages.uri_parameters("db://a/{x}/b/{y}", "db://a/1/b/2") == {"x": "1", "y": "2"} and pages.uri_parameters("db://a/{x}", "db://b/1") is None
    assert pages.read_resource(spark, SF_TINY, "db://regions").count() > 0
    with pytest.raises(ValueError):
        pages.read_resource(spark, SF_TINY, "db://none")


def test_extraction_falls_back(spark):
    def first(b):
        if b.startswith(b"bad"):
            raise ValueError("broken")
        return "court"

    rows = [("a", b"plain " * 30), ("b", b"bad"), ("c", b"x"), ("d", None), ("e", b"")]
    df = spark.createDataFrame([(p, None if b is None else bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r.path: (r.text, r.reader) for r in files.extracted(df, [first, lambda b: b.decode()]).collect()}
    assert got["a"][1] == 1 and got["b"] == ("bad", 1) and got["c"] == ("court", 0) and got["d"] == (None, None) and got["e"] == ("court", 0)
    assert files.extracted(df, []).where("text is not null").count() == 0


def test_progress(spark, tmp_path):
    tasks = spark.createDataFrame([("a",), ("b",), ("c",)], "task string")
    path = str(tmp_path / "state")
    assert sinks.remaining(tasks, path).count() == 3
    sinks.save_progress(spark.createDataFrame([("a", "completed", 1), ("b", "failed", 1), ("b", "running", 0)], "task string, state string, at int"), path)
    assert {r.task for r in sinks.remaining(tasks, path).collect()} == {"b", "c"}
    sinks.save_progress(spark.createDataFrame([("b", "completed", 2)], "task string, state string, at int"), path)
    assert {r.task for r in sinks.remaining(tasks, path).collect()} == {"c"}
