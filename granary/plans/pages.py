"""Sources as queries: pages, files and links rebuilt from the test tables and read by ``granary.sources``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.catalog import Catalog
from granary.sources import files, html
from granary.sources.tables import table

C = Catalog()


def escaped(c: Column) -> Column:
    """A text as it stands in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def as_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, title, author, content, page): articles as HTML, every second one in a container."""
    w = table(spark, d, "web_articles").where("content is not null").select("page_id", "url", "title", "author", "description", "content").distinct()
    lines = F.array_join(F.transform(F.split("content", "\n"), lambda x: F.concat(F.lit("<p>"), escaped(x), F.lit("</p>"))), "")
    holder = F.when(F.col("page_id") % 2 == 0, "main").otherwise("div")
    linked = F.to_json(F.struct(F.lit("Article").alias("@type"), F.col("title").alias("headline"), F.struct(F.col("author").alias("name")).alias("author"), "description"))
    page = F.concat(
        F.lit("<html><head><title>"), escaped(F.coalesce("title", F.lit(""))), F.lit('</title><script type="application/ld+json">'), linked,
        F.lit("</script></head><body><nav><p>Un menu de navigation assez long</p></nav><"), holder, F.lit(">"), lines, F.lit("</"), holder, F.lit('><footer>'),
        F.lit('<p>Un pied de page assez long aussi</p></footer></body></html>'))
    return w.select("page_id", "url", "title", "author", "description", "content", page.alias("page"))


_W = "(select distinct page_id, url, title, author, description, content from web_articles where content is not null)"
# blanks of any kind are one blank in text read from HTML
_LINES = f"""(select page_id, list_filter([trim(regexp_replace(x, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) for x in string_split(content, chr(10))], lambda x: length(x) > 20) as l from {_W})"""


@C.query(f"""select w.page_id, nullif(trim(title), '') as title, nullif(author, '') as author, nullif(description, '') as description, nullif(array_to_string(l, chr(10)), '') as content
from {_W} w join {_LINES} using (page_id)""")
def page_articles(spark: SparkSession, d: str) -> DataFrame:
    """Fields and paragraphs of articles."""
    x = as_pages(spark, d).select("page_id", html.article("page").alias("a"))
    return x.select("page_id", F.nullif(F.trim("a.title"), F.lit("")).alias("title"), "a.author", "a.description", "a.content")


@C.query(f"select w.page_id, len(l[1:10]) as blocks, l[1] as first_block from {_W} w join {_LINES} using (page_id)")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first ten blocks over 20 characters, counted, and the first."""
    x = as_pages(spark, d).select("page_id", html.blocks("page").alias("b"))
    return x.select("page_id", F.size("b.blocks").alias("blocks"), F.get("b.blocks", F.lit(0)).alias("first_block"))


@C.query(f"""
with r as (select page_id, array_to_string(list_filter([trim(regexp_replace(x, '[\\s\\x{{00a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{3000}}]+', ' ', 'g')) for x in string_split(content, chr(10))], lambda x: x <> ''), ' ') as t from {_W})
select page_id, case when page_id % 2 = 0 and length(t) >= 200 then md5(t) end as report from r""")
def page_reports(spark: SparkSession, d: str) -> DataFrame:
    """Digests of report texts: null without a container and where the text is too short."""
    return as_pages(spark, d).select("page_id", html.report("page").alias("r")).select("page_id", F.md5("r").alias("report"))


@C.query("""
with p as (select distinct pub_id, pdf_links from publications where pdf_links is not null)
select pub_id, 5 as links, 1 as pdfs, 1 as documents, 1 as data, 4 as same_host from p""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of listing pages by kind: absolute, without fragments, each url once."""
    p = table(spark, d, "publications").where("pdf_links is not null").select("pub_id").distinct()
    page = F.concat(F.lit("<a href='/a/"), F.col("pub_id"), F.lit(".PDF#page=2'>A</a><a href='/a/"), F.col("pub_id"), F.lit(
        ".PDF'>encore</a><a href='b.docx'>B</a><a href='//other.example/c.csv'>C</a><a href='?q=1'>D</a><a href='mailto:x@y'>E</a><a href='../up/'>F</a>"))
    x = p.select("pub_id", html.links(page, F.lit("https://h.example/x/y")).alias("l"))
    of = lambda kind: F.size(F.filter("l", lambda v: v["kind"] == kind))
    return x.select("pub_id", F.size("l").alias("links"), of("pdf").alias("pdfs"), of("document").alias("documents"), of("data").alias("data"), F.size(F.filter("l", lambda v: v["same_host"])).alias("same_host"))


@C.query("select zone_id, region, agro_type from zones")
def catalogue_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Labels and values of catalogue pages."""
    page = F.concat(F.lit("<dl><dt>Région :</dt><dd>"), escaped(F.col("region")), F.lit("</dd><dt>Type</dt><dd>"), escaped(F.col("agro_type")), F.lit("</dd></dl>"))
    x = table(spark, d, "zones").select("zone_id", html.pairs(page).alias("p"))
    return x.select("zone_id", F.col("p")["Région"].alias("region"), F.col("p")["Type"].alias("agro_type"))


@C.query("""
with p as (select distinct record_id, payload from raw_records where json_valid(payload) and json_type(payload, '$.daily.time') = 'ARRAY' and json_type(payload) = 'OBJECT'),
j as (select record_id, json_extract_string(payload, '$.metadata.zone_name') as zone, from_json(json_extract(payload, '$.daily'), '{"time": ["VARCHAR"], "precipitation_sum": "JSON", "temperature_2m_max": "JSON"}') as x, payload from p),
k as (select record_id, zone, x.time as t, case when json_type(x.precipitation_sum) = 'ARRAY' then from_json(x.precipitation_sum, '["DOUBLE"]') end as r from j)
select record_id, zone, unnest(t) as day, unnest(list_resize(coalesce(r, []::double[]), len(t))) as rain from k""")
def weather_days(spark: SparkSession, d: str) -> DataFrame:
    """Weather files, column by column, as one row for each day."""
    raw = table(spark, d, "raw_records").select("record_id", "payload").distinct()
    j = raw.select("record_id", F.from_json("payload", files.WEATHER.replace("metadata struct<", "record string, metadata struct<")).alias("j")).where("j.daily.time is not null")
    rows = j.select(F.struct(F.col("record_id"), F.col("j.metadata.zone_name").alias("zone")).alias("k"), "j.daily")
    out = rows.select("k", F.explode(F.arrays_zip(F.col("daily.time").alias("day"), F.coalesce("daily.precipitation_sum", F.array().cast("array<double>")).alias("rain"))).alias("r"))
    return out.where("r.day is not null").select("k.record_id", "k.zone", "r.day", "r.rain")


@C.query("""
select 'p' || p_partkey as point, unnest(['sand', 'phh2o']) as property, '0-5cm' as depth, unnest([p_size * 10.0::double, (p_size + 40) / 10.0::double]) as mean from part""")
def soil_layers(spark: SparkSession, d: str) -> DataFrame:
    """Soil properties by depth from maps of maps; pH is stored as ten times its value."""
    value = lambda c: F.create_map(F.lit("0-5cm"), F.struct(c.cast("double").alias("mean"), F.lit(1.0).alias("uncertainty")))
    body = F.to_json(F.struct(F.struct(F.col("p_partkey").cast("double").alias("lat"), F.lit(0.0).alias("lon")).alias("metadata"), F.create_map(
        F.lit("sand"), value(F.col("p_size") * 10), F.lit("phh2o"), value(F.col("p_size") + 40)).alias("layers")))
    raw = table(spark, d, "part").select(F.from_json(body, files.SOIL).alias("j")).select("j.*")
    x = files.soil_rows(raw)
    mean = F.when(F.col("property") == "phh2o", F.col("mean") / 10).otherwise(F.col("mean"))
    return x.select(F.concat(F.lit("p"), F.col("lat").cast("bigint")).alias("point"), "property", "depth", mean.alias("mean"))


@C.query("""
select 'user ' || user_id as city, event_type as title, 'value' as series, event_id as at_ms, value from events""")
def chart_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of chart series nested three deep."""
    point = F.array(F.struct(F.col("event_id").alias("category"), F.col("value").alias("y")))
    chart = F.array(F.struct(F.col("event_type").alias("title"), F.array(F.struct(F.lit("value").alias("name"), point.alias("data"))).alias("series")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("u").alias("url"), F.struct(F.concat(F.lit("user "), F.col("user_id")).alias("city"), chart.alias("raw_data")).alias("metadata"))).alias("results")))
    raw = table(spark, d, "events").select(F.from_json(body, files.CHART).alias("j")).select("j.*")
    return files.chart_rows(raw).select("city", "title", "series", F.unix_millis("at").alias("at_ms"), "value")


@C.query("""
select p_partkey, ['CSV', 'Excel', 'JSON', 'ZIP', null][1 + p_partkey % 5] as format, ['sheet', 'form', 'document', 'folder', 'file'][1 + p_partkey % 5] as kind,
 case p_partkey % 5 when 0 then 'S_' when 1 then 'F-' when 2 then 'D' when 3 then 'R' else 'X' end || p_partkey as id, p_partkey % 3 < 2 as follow from part""")
def link_types(spark: SparkSession, d: str) -> DataFrame:
    """Formats of data files, kinds and ids of shared links, links of an index worth following."""
    k = F.col("p_partkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    data = F.concat(F.lit("https://d.example/f"), k, pick(5, ".csv", ".XLSX?dl=1", ".json#a", ".zip", ".html"))
    shared = F.concat(F.lit("https://docs.example"), pick(5, "/spreadsheets/d/S_", "/forms/d/e/F-", "/document/d/D", "/drive/folders/R", "/file/d/X"), k, F.lit("/view"))
    index = F.concat(F.lit("https://h.example"), pick(3, "/docs/bulletin/", "/files/x", "/bulletin-"), k, pick(3, "", ".pdf", ""))
    link = html.shared_link(shared)
    return table(spark, d, "part").select(
        "p_partkey", html.file_format(data).alias("format"), link["kind"].alias("kind"), link["id"].alias("id"), html.index_link(index, "https://h.example/docs", ("bulletin",)).alias("follow"))


@C.query("""
with p as (select distinct pub_id, doi, pdf_data.title as file_title, title, pdf_data.content as file_text, content from publications)
select pub_id, coalesce(nullif(file_title, ''), title) as title, coalesce(nullif(file_text, ''), content) is not null as has_text, case when nullif(file_text, '') is not null then 'pdf' when content is not null then 'html' end as text_from from p""")
def publication_merge(spark: SparkSession, d: str) -> DataFrame:
    """A publication's record put together: what the file says goes before the page."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    p = table(spark, d, "publications").select("pub_id", F.col("pdf_data.title").alias("ft"), "title", F.col("pdf_data.content").alias("fc"), "content").distinct()
    return p.select(
        "pub_id", F.coalesce(some("ft"), "title").alias("title"), F.coalesce(some("fc"), "content").isNotNull().alias("has_text"),
        F.when(some("fc").isNotNull(), "pdf").when(F.col("content").isNotNull(), "html").alias("text_from"))


@C.query("""
with p as (select pub_id, unnest(pdf_links) as url, generate_subscripts(pdf_links, 1) as pos from publications)
select url, min(pub_id) as first_pub, count(*) as listed, ends_with(lower(url), '.pdf') as direct_pdf from p where url is not null group by url""")
def report_listing(spark: SparkSession, d: str) -> DataFrame:
    """Report links, each url once with its first place, and whether it leads to a file at once."""
    p = table(spark, d, "publications").select("pub_id", F.explode("pdf_links").alias("url")).where("url is not null")
    return p.groupBy("url").agg(F.min("pub_id").alias("first_pub"), F.count("*").alias("listed")).withColumn("direct_pdf", F.endswith(F.lower("url"), F.lit(".pdf")))


@C.query("""
with c as (select unnest([['+226 70 00 ' || lpad(cast(c_custkey % 100 as varchar), 2, '0'), c_name], ['+2267000' || lpad(cast(c_custkey % 100 as varchar), 2, '0'), 'Copie']]) as x, c_custkey from customer)
select replace(x[1], ' ', '') as phone, min_by(x[2], c_custkey * 2 + (x[2] = 'Copie')::int) as name from c group by 1""")
def contact_cards(spark: SparkSession, d: str) -> DataFrame:
    """Names and phones of contact cards; of cards with one phone the first holds."""
    k = F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")
    card = lambda name, phone: F.concat(F.lit("BEGIN:VCARD\nFN:"), name, F.lit("\nTEL;TYPE=CELL:"), phone, F.lit("\n"))
    cards = F.array(card(F.col("c_name"), F.concat(F.lit("+226 70 00 "), k)), card(F.lit("Copie"), F.concat(F.lit("+2267000"), k)))
    x = table(spark, d, "customer").select("c_custkey", F.posexplode(cards).alias("i", "value"))
    return files.card_rows(x.withColumn("pos", F.struct("c_custkey", "i"))).select("phone", "name")


@C.query("select s_suppkey, s_name, n_name as zone from supplier join nation on n_nationkey = s_nationkey where s_nationkey = 3 and s_acctbal >= 100")
def resource_by_uri(spark: SparkSession, d: str) -> DataFrame:
    """A resource named by a URI: the template that matches gives the query and its parameters."""
    return read_resource(spark, d, "db://zones/3/producers/100")


RESOURCES = {
    "db://zones/{zone}/producers/{least}": """select s_suppkey, s_name, n_name as zone from {supplier} join {nation} on n_nationkey = s_nationkey
        where s_nationkey = cast(:zone as int) and s_acctbal >= cast(:least as double)""",
    "db://regions": "select r_regionkey, r_name from {region}",
}


def uri_parameters(template: str, uri: str) -> dict[str, str] | None:
    """The parameters of a URI that fits a template, else None."""
    t, u = template.split("/"), uri.split("/")
    fits = len(t) == len(u) and all(a == b or (a.startswith("{") and b) for a, b in zip(t, u))
    return {a[1:-1]: b for a, b in zip(t, u) if a.startswith("{")} if fits else None


def read_resource(spark: SparkSession, d: str, uri: str) -> DataFrame:
    """The rows of a resource; parameters are bound, not pasted. Raises for a URI no template fits."""
    for template, query in RESOURCES.items():
        found = uri_parameters(template, uri)
        if found is not None:
            names = [n for n in ("supplier", "nation", "region") if "{" + n + "}" in query]
            return spark.sql(query, args=found, **{n: table(spark, d, n) for n in names})
    raise ValueError(f"no resource fits {uri}")
