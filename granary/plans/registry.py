"""Registries and lookups: discovery, scored routing with a next candidate, tables of patterns, diagnoses by symptoms, corrections, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.relational import top_k
from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()

_AGENTS = """(select s_suppkey as agent, case when s_acctbal >= 0 then 'ACTIVE' else 'OFFLINE' end as status, ['market', 'weather', 'soil'][1 + s_suppkey % 3] as domain,
 case when s_suppkey % 4 = 0 then ['all'] when s_suppkey % 4 = 1 then ['mil', 'riz'] else ['mil'] end as crops, [s_nationkey % 5, 5 + s_suppkey % 2] as intents, s_nationkey as zone, abs(s_acctbal) as ms from supplier)"""


def agents(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as agents of a registry."""
    k = F.col("s_suppkey")
    words = lambda *w: F.array(*map(F.lit, w))
    return table(spark, d, "supplier").select(
        k.alias("agent"), F.when(F.col("s_acctbal") >= 0, "ACTIVE").otherwise("OFFLINE").alias("status"), F.element_at(words("market", "weather", "soil"), (k % 3 + 1).cast("int")).alias("domain"),
        F.when(k % 4 == 0, words("all")).when(k % 4 == 1, words("mil", "riz")).otherwise(words("mil")).alias("crops"),
        F.array((F.col("s_nationkey") % 5).cast("long"), 5 + k % 2).alias("intents"), F.col("s_nationkey").alias("zone"), F.abs("s_acctbal").alias("ms"))


def discover(a: DataFrame, domain: str | None = None, crop: str | None = None) -> DataFrame:
    """Active agents of a domain that know a crop, or all crops; what isn't given isn't asked for."""
    a = a.where("status = 'ACTIVE'")
    if domain is not None:
        a = a.where(F.col("domain") == domain)
    if crop is not None:
        a = a.where(F.array_contains("crops", "all") | F.array_contains("crops", crop))
    return a


@C.query(f"select agent, ms from {_AGENTS} where status = 'ACTIVE' and domain = 'market' and (list_contains(crops, 'all') or list_contains(crops, 'riz'))")
def registry_discover(spark: SparkSession, d: str) -> DataFrame:
    """Active agents of a domain for a crop."""
    return discover(agents(spark, d), "market", "riz").select("agent", "ms")


@C.query(f"""
select (select count(*) from {_AGENTS}) as agents, (select count(*) from {_AGENTS} where status = 'ACTIVE') as active,
 (select count(distinct i) from (select unnest(intents) as i from {_AGENTS})) as intents, (select count(distinct zone) from {_AGENTS}) as zones""")
def registry_totals(spark: SparkSession, d: str) -> DataFrame:
    """Agents, active ones, distinct intents and zones of the registry."""
    x = agents(spark, d).select("agent", "status", "zone", F.explode("intents").alias("intent"))
    return x.agg(
        F.count_distinct("agent").alias("agents"), F.count_distinct(F.when(F.col("status") == "ACTIVE", F.col("agent"))).alias("active"),
        F.count_distinct("intent").alias("intents"), F.count_distinct("zone").alias("zones"))


@C.query(f"""
with c as (select *, row_number() over (partition by zone order by ms, agent) as rank from {_AGENTS} where status = 'ACTIVE'),
r as (select event_id, user_id % 25 as zone from events),
m as (select r.event_id, c.agent, c.rank from r left join c on c.zone = r.zone and c.rank <= 3 and (r.event_id + c.agent) % 3 <> 0)
select event_id, min_by(agent, rank) as agent, min(rank) - 1 as refusals from m group by 1""")
def routing_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The best of three candidates of a zone that accepts a request; null if all refuse."""
    c = top_k(agents(spark, d).where("status = 'ACTIVE'"), ["zone"], [F.asc("ms"), F.asc("agent")], 3).select("zone", "agent", "rank")
    r = table(spark, d, "events").select("event_id", (F.col("user_id") % 25).cast("int").alias("zone"))
    accepts = (F.col("event_id") + F.col("agent")) % 3 != 0
    m = r.join(c, "zone", "left").groupBy("event_id").agg(F.min(F.when(accepts, F.struct("rank", "agent"))).alias("best"))
    return m.select("event_id", F.col("best.agent").alias("agent"), (F.col("best.rank") - 1).alias("refusals"))


PLACES = (("bobo", 11.18, -4.29), ("sahel", 14.03, -0.03), ("centre", 12.37, -1.52), ("nord", 13.58, -2.42), ("sud", 11.66, -1.07), ("est", 12.06, 0.36))


@C.query("""
with p(name, lat, lon, ordinal) as (values ('bobo', 11.18, -4.29, 0), ('sahel', 14.03, -0.03, 1), ('centre', 12.37, -1.52, 2), ('nord', 13.58, -2.42, 3), ('sud', 11.66, -1.07, 4), ('est', 12.06, 0.36, 5)),
m as (select z.zone_id, p.* from zones z left join p on contains(lower(z.name || ' ' || z.region), p.name))
select zone_id, coalesce(min_by(lat, ordinal), 12.37)::double as lat, coalesce(min_by(lon, ordinal), -1.52)::double as lon from m group by 1""")
def place_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of a place by the first entry of a table that its name contains, else those of the capital."""
    p = spark.createDataFrame([(n, lat, lon, i) for i, (n, lat, lon) in enumerate(PLACES)], "name string, p_lat double, p_lon double, ordinal int")
    z = table(spark, d, "zones").select("zone_id", F.lower(F.concat_ws(" ", "name", "region")).alias("text"))
    m = z.join(F.broadcast(p), F.contains("text", "name"), "left")  # a table of patterns
    best = m.groupBy("zone_id").agg(F.min(F.when(F.col("ordinal").isNotNull(), F.struct("ordinal", "p_lat", "p_lon"))).alias("b"))
    return best.select("zone_id", F.coalesce("b.p_lat", F.lit(12.37)).alias("lat"), F.coalesce("b.p_lon", F.lit(-1.52)).alias("lon"))


# fixed values: diseases of each crop with local names, symptoms and the infested share (%) from which chemicals are advised
DISEASES = (
    ("maïs", "Chenille Légionnaire d'Automne", ("spodoptera", "chenille"), ("feuilles trouées", "sciure", "cœur mangé"), 15),
    ("maïs", "Striga (Wongo)", ("wongo", "striga"), ("fleurs violettes", "jaunissement", "croissance arrêtée"), 1),
    ("maïs", "Charbon", ("charbon",), ("excroissances noires", "poudre noire"), 5),
    ("niébé", "Thrips", ("thrips", "poux des fleurs"), ("chute des fleurs", "fleurs noires"), 10),
    ("niébé", "Maruca", ("foreuse de gousses",), ("trous dans gousses", "déjections"), 5),
)


def diagnosis(crop: Column, observed: Column, rate: Column) -> Column:
    """struct(status, disease, chemical): of a crop's diseases the one with most points (a symptom 1, a local name 2), the first among equals."""
    low = F.lower(observed)
    found = []
    for i, (c, name, local, symptoms, share) in enumerate(DISEASES):
        points = sum((F.contains(low, F.lit(s)).cast("int") for s in symptoms), F.lit(0)) + sum((F.contains(low, F.lit(s)).cast("int") * 2 for s in local), F.lit(0))
        found.append(F.when((F.lower(crop) == c) & (points > 0), F.struct(points.alias("points"), F.lit(-i).alias("order"), F.lit(name).alias("name"), (rate >= share).alias("chemical"))))
    best = F.array_max(F.array_compact(F.array(*found)))
    known = F.lower(crop).isin(*{c for c, *_ in DISEASES})
    return F.struct(
        F.when(~known, "Inconnu").when(best.isNull(), "Incertain").otherwise("Identifié").alias("status"), best["name"].alias("disease"), best["chemical"].alias("chemical"))


@C.query("""
with k(crop, name, o, word, points, share) as (values ('maïs', 'Chenille Légionnaire d''Automne', 0, 'spodoptera', 2, 15), ('maïs', 'Chenille Légionnaire d''Automne', 0, 'chenille', 2, 15), ('maïs', 'Chenille Légionnaire d''Automne', 0, 'feuilles trouées', 1, 15),
 ('maïs', 'Chenille Légionnaire d''Automne', 0, 'sciure', 1, 15), ('maïs', 'Chenille Légionnaire d''Automne', 0, 'cœur mangé', 1, 15), ('maïs', 'Striga (Wongo)', 1, 'wongo', 2, 1), ('maïs', 'Striga (Wongo)', 1, 'striga', 2, 1),
 ('maïs', 'Striga (Wongo)', 1, 'fleurs violettes', 1, 1), ('maïs', 'Striga (Wongo)', 1, 'jaunissement', 1, 1), ('maïs', 'Striga (Wongo)', 1, 'croissance arrêtée', 1, 1), ('maïs', 'Charbon', 2, 'charbon', 2, 5), ('maïs', 'Charbon', 2, 'excroissances noires', 1, 5),
 ('maïs', 'Charbon', 2, 'poudre noire', 1, 5), ('niébé', 'Thrips', 3, 'thrips', 2, 10), ('niébé', 'Thrips', 3, 'poux des fleurs', 2, 10), ('niébé', 'Thrips', 3, 'chute des fleurs', 1, 10), ('niébé', 'Thrips', 3, 'fleurs noires', 1, 10),
 ('niébé', 'Maruca', 4, 'foreuse de gousses', 2, 5), ('niébé', 'Maruca', 4, 'trous dans gousses', 1, 5), ('niébé', 'Maruca', 4, 'déjections', 1, 5)),
x as (select doc_id, ['maïs', 'Niébé', 'riz'][1 + doc_id % 3] as crop, lower(text || case when doc_id % 2 = 0 then ' chute des fleurs, Striga' else '' end) as t, doc_id % 20 as rate from documents where text is not null),
s as (select doc_id, k.name, k.o, k.share, sum(points) as score from x join k on k.crop = lower(x.crop) and contains(t, word) group by 1, 2, 3, 4),
b as (select *, row_number() over (partition by doc_id order by score desc, o) as r from s)
select x.doc_id, case when lower(x.crop) = 'riz' then 'Inconnu' when b.name is null then 'Incertain' else 'Identifié' end as status, b.name as disease, x.rate >= b.share as chemical from x left join b on b.doc_id = x.doc_id and r = 1""")
def symptom_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """The disease that observations of a crop point to, and whether chemicals are advised."""
    k = F.col("doc_id")
    crop = F.element_at(F.array(*map(F.lit, ("maïs", "Niébé", "riz"))), (k % 3 + 1).cast("int"))
    seen = F.concat("text", F.when(k % 2 == 0, " chute des fleurs, Striga").otherwise(""))
    return table(spark, d, "documents").where("text is not null").select("doc_id", diagnosis(crop, seen, k % 20).alias("x")).select("doc_id", "x.*")


TYPOS = (("mayis", "maïs"), ("sorgo", "sorgho"), ("pri ", "prix "))
OFFICIAL = {"mais": "maïs", "niebe": "niébé", "maïs": "maïs", "sorgho": "sorgho", "mil": "mil", "prix": "prix"}
LOCAL = (("kaba", "maïs"), ("dolo", "bière de sorgho"))


def corrected(text: Column) -> Column:
    """Known typing errors put right, official spellings word by word, standard names beside local ones; near misses are ``correct_words``'s."""
    t = text
    for wrong, right in TYPOS:
        t = F.regexp_replace(t, f"(?iu){wrong}", right)
    names = F.create_map(*(F.lit(x) for kv in OFFICIAL.items() for x in kv))
    words = F.transform(F.split(F.trim(t), r"\s+"), lambda w: F.coalesce(F.try_element_at(names, F.regexp_replace(F.lower(w), "^[,.!?;:]+|[,.!?;:]+$", "")), w))
    t = F.array_join(words, " ")
    for local, standard in LOCAL:
        t = F.regexp_replace(t, f"(?iu){local}", f"{standard} ({local})")
    return t


@C.query("""
select event_id, ['Le prix du maïs à ' || user_id, 'sorgho et niébé', 'maïs (kaba) ou bière de sorgho (dolo)', 'Rien ici'][1 + event_id % 4] as text from events""")
def typo_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Requests with their spelling put right."""
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("Le pri du  MAYIS à "), F.col("user_id"))).when(k == 1, "sorgo et NIEBE,").when(k == 2, "Kaba ou dolo").otherwise("Rien ici")
    return table(spark, d, "events").select("event_id", corrected(t).alias("text"))


def absolute(href: Column, base: str) -> Column:
    """A link as an absolute address without fragment: ``//`` gets https, a path the host of ``base``, anything else its folder; null and empty are empty."""
    from urllib.parse import urlsplit

    u = urlsplit(base)
    root, folder = f"{u.scheme}://{u.netloc}", f"{u.scheme}://{u.netloc}{u.path.rpartition('/')[0]}/"
    h = F.trim(F.coalesce(href, F.lit("")))
    full = (
        F.when(h == "", h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("/"), F.concat(F.lit(root), h)).when(h.startswith("#"), F.lit(base)).when(h.startswith("?"), F.concat(F.lit(base.partition("?")[0]), h))
        .otherwise(F.concat(F.lit(folder), h))
    )
    return F.split(full, "#")[0]


@C.query("""
select p_partkey, ['https://cdn.example/a' || p_partkey, 'https://h.example/b' || p_partkey || '?q=1', 'https://h.example/docs/c' || p_partkey || '.pdf', 'http://o.example/' || p_partkey, ''][1 + p_partkey % 5] as url,
 ['https://cdn.example/a' || p_partkey, 'https://h.example/b' || p_partkey, 'https://h.example/docs/c' || p_partkey || '.pdf', 'http://o.example/' || p_partkey, ''][1 + p_partkey % 5] as key from part""")
def urls_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page as absolute addresses, and as keys without query."""
    k = F.col("p_partkey")
    href = F.when(k % 5 == 0, F.concat(F.lit(" //cdn.example/a"), k)).when(k % 5 == 1, F.concat(F.lit("/b"), k, F.lit("?q=1#x"))).when(
        k % 5 == 2, F.concat(F.lit("c"), k, F.lit(".pdf#page=2"))).when(k % 5 == 3, F.concat(F.lit("http://o.example/"), k)).otherwise(F.lit(None).cast("string"))
    url = absolute(href, "https://h.example/docs/index.html")
    return table(spark, d, "part").select("p_partkey", url.alias("url"), F.split(url, r"\?")[0].alias("key"))
