"""Small text, date, profile and retrieval queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import fold
from granary.operators import profiles as P
from granary.operators import textops as X
from granary.operators.relational import top_k
from granary.operators.retrieval import search_all, search_lists
from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()


@C.query("select farm_id, upper(trim(name)) as key, upper(trim(coalesce(zone_id, ''))) as zone_key from farms where name is not null")
def registry_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys as registries compare them; a missing zone is the empty key."""
    return table(spark, d, "farms").where("name is not null").select("farm_id", X.key(F.col("name")).alias("key"), X.key(F.coalesce("zone_id", F.lit(""))).alias("zone_key"))


@C.query("""
with x as (select event_id, upper(trim(['m ', 'P ', 'a ', ''][1 + event_id % 4] || event_type || ' zone ' || user_id)) as t from events)
select event_id, case when starts_with(t, 'M ') then 'Météo pour ' || t[3:] when starts_with(t, 'P ') then 'Prix du marché pour ' || t[3:]
 when starts_with(t, 'A ') then 'Je signale une alerte : ' || t[3:] else t end as query from x""")
def inbound_routes(spark: SparkSession, d: str) -> DataFrame:
    """Questions behind coded messages."""
    code = F.element_at(F.array(F.lit("m "), F.lit("P "), F.lit("a "), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(code, F.col("event_type"), F.lit(" zone "), F.col("user_id"))
    return table(spark, d, "events").select("event_id", X.inbound_query(text).alias("query"))


@C.query("""select doc_id, '[Source: ' || coalesce(source, '?') || ' | Type: ' || coalesce(doc_type, '?') || ' | Culture: ' || coalesce(crop, '?') || ']' || chr(10) || text as chunk from documents where text is not null""")
def header_prepend(spark: SparkSession, d: str) -> DataFrame:
    """Texts with a header that says where they are from."""
    part = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("?")))
    head = F.concat(part("[Source: ", "source"), part(" | Type: ", "doc_type"), part(" | Culture: ", "crop"), F.lit("]\n"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(head, "text").alias("chunk"))


@C.query("""
with x as (select event_id, ['Oui merci', 'c''est bon', 'je dis non', 'STOP', 'ouistiti', 'peut-être', 'ok mais non', 'Valide'][1 + event_id % 8] as t from events)
select event_id, case when regexp_matches(t, '(?i)\\b(oui|ok|d''accord|c''est bon|valide|confirme)\\b') then 'CONFIRMED' when regexp_matches(t, '(?i)\\b(non|annule|stop|pas bonne|erreur)\\b') then 'CANCELLED' end as answer from x""")
def confirmations(spark: SparkSession, d: str) -> DataFrame:
    """Yes, no or neither."""
    texts = ("Oui merci", "c'est bon", "je dis non", "STOP", "ouistiti", "peut-être", "ok mais non", "Valide")
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.confirmation(t).alias("answer"))


@C.query("""
with x as (select event_id, case event_id % 4 when 0 then 'Voici {oops} puis ' || props || ' fin' when 1 then props when 2 then 'rien' else '{"a": 1} et {"b": 2}' end as t from events)
select event_id, case event_id % 4 when 0 then props when 1 then props when 3 then '{"a": 1}' end as block from x join events using (event_id)""")
def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first block of a text that is JSON."""
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.concat(F.lit("Voici {oops} puis "), "props", F.lit(" fin"))).when(k == 1, F.col("props")).when(k == 2, "rien").otherwise('{"a": 1} et {"b": 2}')
    return table(spark, d, "events").select("event_id", X.first_json_block(t).alias("block"))


@C.query("""
select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where props is not null""")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    """Values of JSON that stands in a code fence."""
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Voilà :\n```json\n"), "props", F.lit("\n```\nfin"))).otherwise(F.col("props"))
    return table(spark, d, "events").where("props is not null").select("event_id", F.from_json(X.fenced(t), "k bigint")["k"].alias("k"))


@C.query("select o_orderkey, format('{:,}', cast(round(o_totalprice) as bigint)) || ' FCFA' as amount from orders")
def thousands(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written with thousands apart."""
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.format_number(F.round("o_totalprice"), 0), F.lit(" FCFA")).alias("amount"))


@C.query("""
with x as (select event_id, case event_id % 4 when 0 then 'mon champ de ' || replace(cast(user_id / 4.0 as varchar), '.', ',') || ' ha' when 1 then user_id || ' m² de tomates' when 2 then 'sans surface' else user_id || ' hectares et 5 m2' end as t, user_id from events)
select event_id, case event_id % 4 when 0 then user_id / 4.0 * 10000 when 1 then user_id when 3 then user_id * 10000.0 end::double as m2, round(case event_id % 4 when 0 then user_id / 4.0 * 10000 when 1 then user_id when 3 then user_id * 10000.0 end * 5.25, 2)::double as litres from x""")
def surface_losses(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces read from texts and the water they lose at a given evapotranspiration."""
    k, u = F.col("event_id") % 4, F.col("user_id")
    t = F.when(k == 0, F.concat(F.lit("mon champ de "), F.replace((u / 4).cast("string"), F.lit("."), F.lit(",")), F.lit(" ha"))).when(
        k == 1, F.concat(u, F.lit(" m² de tomates"))).when(k == 2, "sans surface").otherwise(F.concat(u, F.lit(" hectares et 5 m2")))
    x = table(spark, d, "events").select("event_id", X.surface_m2(t).alias("m2"))
    return x.withColumn("litres", F.round(F.col("m2") * 5.25, 2))


TERMS = ("sorgho", "sorgho rouge", "sesame", "semence", "semis", "soja", "mais", "manioc", "mil", "maraichage", "niebe", "coton", "compost")


@C.query("""
with t(term) as (values ('sorgho'), ('sorgho rouge'), ('sesame'), ('semence'), ('semis'), ('soja'), ('mais'), ('manioc'), ('mil'), ('maraichage'), ('niebe'), ('coton'), ('compost')),
q as (select distinct lower(trim(crop)) as q, left(lower(strip_accents(trim(crop))), 3) as p from documents where crop is not null),
m as (select q, p, term, case when starts_with(term, p) then 0 else 1 end as kind, case when starts_with(term, p) then 0 else levenshtein(p, left(term, 3)) end as far from q, t),
r as (select *, row_number() over (partition by q order by kind, far, term) as rank from m where kind = 0 or far <= 1)
select q, term, rank from r where rank <= 5""")
def completions(spark: SparkSession, d: str) -> DataFrame:
    """Up to five completions of what was typed so far: terms that begin with it, then terms that nearly do."""
    typed = table(spark, d, "documents").where("crop is not null").select(F.lower(F.trim("crop")).alias("q"), F.substring(fold(F.col("crop")), 1, 3).alias("p")).distinct()
    terms = F.broadcast(spark.createDataFrame([(t,) for t in TERMS], "term string"))  # the list of official terms
    starts = F.startswith("term", "p")
    x = typed.join(terms, starts | (F.levenshtein("p", F.substring("term", 1, 3)) <= 1)).withColumn("kind", F.when(starts, 0).otherwise(1))
    x = x.withColumn("far", F.when(starts, 0).otherwise(F.levenshtein("p", F.substring("term", 1, 3))))
    return top_k(x, ["q"], [F.col("kind"), F.col("far"), F.col("term")], 5).select("q", "term", "rank")


@C.query("""
select event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') as at, strftime(ts - interval 61 day, '%Y-%m-%d') as since, strftime(ts - interval 1 day, '%Y-%m-%d') as until from events""")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """An instant to the second, and the sixty days that end the day before."""
    day = F.to_date("ts")
    return table(spark, d, "events").select(
        "event_id", F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        F.date_format(F.date_sub(day, 61), "yyyy-MM-dd").alias("since"), F.date_format(F.date_sub(day, 1), "yyyy-MM-dd").alias("until"))


@C.query("""
with x as (select event_id, md5(cast(event_id as varchar)) as h from events),
y as (select event_id, case event_id % 3 when 0 then h when 1 then '../' || h else h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] end as id from x)
select event_id, regexp_full_match(id, '[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}') as task_id, regexp_full_match(id, '[a-fA-F0-9-]{1,64}') as audio_id from y""")
def id_validation(spark: SparkSession, d: str) -> DataFrame:
    """Which ids are those of a task, which of an audio file."""
    h = F.md5(F.col("event_id").cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    dashed = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    i = F.when(F.col("event_id") % 3 == 0, h).when(F.col("event_id") % 3 == 1, F.concat(F.lit("../"), h)).otherwise(dashed)
    return table(spark, d, "events").select(
        "event_id", i.rlike("^[a-fA-F0-9]{8}(-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}$").alias("task_id"), i.rlike(r"^[a-fA-F0-9\-]{1,64}$").alias("audio_id"))


@C.query("""select event_id, md5('{"props":' || props || ',"type":"' || event_type || '","user":' || user_id || '}') as digest from events where props is not null""")
def canonical_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of canonical JSON: members in the order of their names."""
    members = {"type": F.col("event_type"), "user": F.col("user_id"), "props": F.from_json("props", "k bigint")}
    body = F.to_json(F.struct(*(members[k].alias(k) for k in sorted(members))))
    return table(spark, d, "events").where("props is not null").select("event_id", F.md5(F.replace(body, F.lit('"k":'), F.lit('"k": '))).alias("digest"))


@C.query("""
with x as (select event_id, 'Bonjour, **Attention** : la pluie arrive' || chr(10) || chr(10) || 'à ' || user_id || ' km. [Voir](http://x) # Prix 500 FCFA Cordialement, ' || repeat('mil ', (event_id % 100)::int) as t from events),
y as (select event_id, trim(regexp_replace('⚠️ : la 🌧️ arrive à ' || (select any_value(0) where false) || '', '\\s+', ' ', 'g')) as z from x),
s as (select event_id, trim('⚠️ : la 🌧️ arrive à ' || user_id || ' km. Voir Prix 500 F ' || repeat('mil ', (event_id % 100)::int)) as m from events)
select event_id, case when length(m) > 320 then left(m, 317) || '...' else m end as sms from s""".replace("""y as (select event_id, trim(regexp_replace('⚠️ : la 🌧️ arrive à ' || (select any_value(0) where false) || '', '\\\\s+', ' ', 'g')) as z from x),
""", ""))
def sms_compress(spark: SparkSession, d: str) -> DataFrame:
    """Texts made fit for short messages."""
    t = F.concat(F.lit("Bonjour, **Attention** : la pluie arrive\n\nà "), F.col("user_id"), F.lit(" km. [Voir](http://x) # Prix 500 FCFA Cordialement, "),
                 F.repeat(F.lit("mil "), (F.col("event_id") % 100).cast("int")))
    return table(spark, d, "events").select("event_id", X.compress_message(t).alias("sms"))


@C.query("""
select farm_id, case when zone_id is null then 1 else 2 end as n_plots, case when zone_id is null then coalesce(size_ha, 1.5::double) else 1.5::double end as maize_ha,
 case when zone_id is null then 'sableux' end as maize_soil from farms""".replace("coalesce(size_ha, 1.5::double)", "coalesce(size_ha, 1.5::double)"))
def plot_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Plots of a profile after one more: the active plot of the same crop is updated, else it is added."""
    plot = lambda crop, area, soil: F.struct(crop.alias("crop"), F.lit("ACTIVE").alias("status"), area.cast("double").alias("area_ha"), soil.alias("soil_type"), F.lit(None).cast("string").alias("planting_date"))
    old = F.array(plot(F.lit("Maïs"), F.lit(1.5), F.lit(None).cast("string")))
    new = plot(F.when(F.col("zone_id").isNull(), "MAÏS").otherwise("Sorgho"), F.col("size_ha"), F.lit("sableux"))
    x = table(spark, d, "farms").select("farm_id", P.add_plot(old, new).alias("plots"))
    return x.select("farm_id", F.size("plots").alias("n_plots"), F.col("plots")[0]["area_ha"].alias("maize_ha"), F.col("plots")[0]["soil_type"].alias("maize_soil"))


@C.query("""
select c_custkey, case when c_custkey % 5 = 0 then '' else 'PROFIL AGRICULTEUR: Zone=Z' || c_nationkey || '. Parcelles: 2.5ha Maïs (semé 2024-06-15)' || case when c_custkey % 2 = 0 then ', Mil sol:sableux' else '' end
 || '. Bétail: 3 boeuf. Équipement: a, b, c, d, e. Contraintes: budget ' || format('{:,}', 1000 + c_custkey) || ' FCFA, 2 ouvriers.' end as profile from customer""")
def profile_texts(spark: SparkSession, d: str) -> DataFrame:
    """Profiles rendered as one line."""
    known = F.col("c_custkey") % 5 > 0
    some = lambda c: F.when(known, c)
    plots = F.from_json(F.when(known, F.concat(
        F.lit('[{"crop":"Maïs","status":"ACTIVE","area_ha":2.5,"planting_date":"2024-06-15"},{"crop":"Riz","status":"HARVESTED"}'),
        F.when(F.col("c_custkey") % 2 == 0, ',{"crop":"Mil","status":"ACTIVE","soil_type":"sableux"}').otherwise(""), F.lit("]"))).otherwise("[]"), "array<struct<" + P._fields(P.PLOT) + ">>")
    animals = F.from_json(F.when(known, '[{"type":"boeuf","count":3}]').otherwise("[]"), "array<struct<type:string,count:int>>")
    tools = F.when(known, F.array(*map(F.lit, "abcdefg"))).otherwise(F.array().cast("array<string>"))
    text = P.profile_text(some(F.concat(F.lit("Z"), F.col("c_nationkey"))), F.lit(None).cast("string"), plots, animals, tools, some(1000 + F.col("c_custkey")), F.lit(""), some(F.lit(2)))
    return table(spark, d, "customer").select("c_custkey", text.alias("profile"))


@C.query("""
select p_partkey, case p_size % 3 when 0 then 'card+text' when 1 then 'text+card' else 'text' end as kinds, case when p_size % 3 < 2 then 2 end as buttons from part""")
def pruned_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of a page that a channel without charts, images and interaction can show."""
    one = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit("u").alias("image_url"), F.array(*map(F.lit, "abc")).alias("actions"), F.array(*map(F.lit, "abcde")).alias("items"))
    all_ = F.when(F.col("p_size") % 3 == 0, F.array(one("card"), one("chart"), one("text"))).when(
        F.col("p_size") % 3 == 1, F.array(one("text"), one("list_picker"), one("card"))).otherwise(F.array(one("text"), one("chart"), one("action")))
    caps = {"charts": False, "images": False, "interactive": False, "buttons": 2, "list_items": 3}
    x = table(spark, d, "part").select("p_partkey", P.prune_components(all_, caps).alias("c"))
    card = F.filter("c", lambda c: c["type"] == "card")
    return x.select("p_partkey", F.array_join(F.transform("c", lambda c: c["type"]), "+").alias("kinds"), F.size(F.get(card, F.lit(0))["actions"]).alias("buttons")).withColumn(
        "buttons", F.when(F.col("buttons") >= 0, F.col("buttons")))


@C.query("""
with w as (select distinct user_id as phone from events), k as (select c_custkey, c_name from customer where c_custkey % 3 = 0)
select phone, coalesce(c_name, 'Producteur ' || phone) as name, c_custkey is null as created from w left join k on c_custkey = phone""")
def get_or_create(spark: SparkSession, d: str) -> DataFrame:
    """Users by phone, with those that must be made and the name they get."""
    known = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_name")
    asked = table(spark, d, "events").select(F.col("user_id").alias("phone")).distinct()
    x = asked.join(known, F.col("phone") == F.col("c_custkey"), "left")
    return x.select("phone", F.coalesce("c_name", F.concat(F.lit("Producteur "), F.col("phone"))).alias("name"), F.col("c_custkey").isNull().alias("created"))


@C.query("""
select event_id, json_extract_string(j, '$.sol.type') as type_code, cast(json_extract_string(j, '$.bilan.ph') as double) as ph, json_extract_string(j, '$.eau.strategie') as strategy
from (select event_id, '{"sol": {"type": "' || event_type || '"}, "bilan": {"ph": ' || (user_id % 14) || '}' || case when event_id % 2 = 0 then ', "eau": {"strategie": "zaï"}' else '' end || '}' as j from events)""")
def diagnosis_flat(spark: SparkSession, d: str) -> DataFrame:
    """A nested diagnosis as flat columns; missing parts are null."""
    j = F.concat(F.lit('{"sol": {"type": "'), "event_type", F.lit('"}, "bilan": {"ph": '), F.col("user_id") % 14, F.lit("}"),
                 F.when(F.col("event_id") % 2 == 0, ', "eau": {"strategie": "zaï"}').otherwise(""), F.lit("}"))
    x = table(spark, d, "events").select("event_id", F.from_json(j, "sol struct<type:string>, bilan struct<ph:double>, eau struct<strategie:string>").alias("j"))
    return x.select("event_id", F.col("j.sol.type").alias("type_code"), F.col("j.bilan.ph").alias("ph"), F.col("j.eau.strategie").alias("strategy"))


# fixed values: documents retrieved and kept, query expansion and tone of each level of user
LEVELS = {"debutant": (5, 3, False, "simple"), "intermediaire": (10, 5, True, "standard"), "expert": (20, 8, True, "technique")}


def level_profile(level):
    """struct(top_k, rerank_k, expand, tone) of a level; an unknown one is a beginner's."""
    one = lambda v: F.struct(F.lit(v[0]).alias("top_k"), F.lit(v[1]).alias("rerank_k"), F.lit(v[2]).alias("expand"), F.lit(v[3]).alias("tone"))
    out = one(LEVELS["debutant"])
    for name, v in LEVELS.items():
        out = F.when(level == name, one(v)).otherwise(out)
    return out


def expanded_query(query, expand, hypothetical=lambda q, tone: q, tone=None):
    """The query, with the text of a hypothetical document under it where the level asks for it. The default hook gives the query itself."""
    return F.when(expand, F.concat_ws("\n", query, hypothetical(query, tone))).otherwise(query)


def weather_query(query, condition):
    """The query with the weather's effect asked for, where the weather is known."""
    return F.when(condition.isNotNull(), F.concat(query, F.lit(" impact de "), condition, F.lit(" sur cette action"))).otherwise(query)


@C.query("""
with x as (select event_id, ['debutant', 'intermediaire', 'expert', 'inconnu'][1 + event_id % 4] as level, event_type || ' ' || user_id || case when value > 10 then ' impact de pluie sur cette action' else '' end as q from events)
select event_id, case level when 'intermediaire' then 10 when 'expert' then 20 else 5 end as top_k, case level when 'intermediaire' then 5 when 'expert' then 8 else 3 end as rerank_k,
 case level when 'intermediaire' then 'standard' when 'expert' then 'technique' else 'simple' end as tone, case when level in ('intermediaire', 'expert') then q || chr(10) || q else q end as query from x""")
def retrieval_plans(spark: SparkSession, d: str) -> DataFrame:
    """What is searched for each request, and how widely: level, weather, expansion."""
    level = F.element_at(F.array(*map(F.lit, (*LEVELS, "inconnu"))), (F.col("event_id") % 4 + 1).cast("int"))
    q = weather_query(F.concat_ws(" ", "event_type", "user_id"), F.when(F.col("value") > 10, "pluie"))
    x = table(spark, d, "events").select("event_id", level_profile(level).alias("p"), q.alias("q"))
    return x.select("event_id", "p.top_k", "p.rerank_k", "p.tone", expanded_query(F.col("q"), F.col("p.expand")).alias("query"))


@C.query("""
with q as (select vec_id as query_id, embedding as qe, ['debutant', 'intermediaire', 'expert'][1 + (vec_id // 20) % 3] as level from embeddings where vec_id % 20 = 0),
s as (select query_id, level, vec_id, list_inner_product(cast(qe as double[]), cast(embedding as double[])) as score from q, embeddings where vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, vec_id, rank from r where rank <= case level when 'debutant' then 3 when 'intermediaire' then 5 else 8 end""")
def search_by_level(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every query vector (ids divisible by 20) against all, as many as its level keeps after reranking."""
    e = table(spark, d, "embeddings")
    found = search_all(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 9).where("query_id <> vec_id")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.floor(F.col("query_id") / 20) % 3 + 1).cast("int"))
    x = found.withColumn("keep", level_profile(level)["rerank_k"])
    return top_k(x.drop("rank"), ["query_id"], [F.desc("score"), F.col("vec_id")], 8).where(F.col("rank") <= F.col("keep")).select("query_id", "vec_id", "rank")


@C.query()
def vector_ann(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search for every query vector (ids divisible by 20) over lists of near vectors; every row is indexed."""
    e = table(spark, d, "embeddings")
    return search_lists(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


def embed(df: DataFrame, text: str, model, size: int, out: str = "embedding") -> DataFrame:
    """``df`` with a vector of each text by ``model(list of texts) -> array of vectors``, called once for each Arrow batch; null texts have none.

    The model is a hook; none is installed.
    """
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        some = [t for t in texts if t is not None]
        vectors = iter(model(some) if some else [])
        return pd.Series([None if t is None else [float(x) for x in next(vectors)][:size] for t in texts], dtype=object)

    return df.withColumn(out, run(F.col(text)))
