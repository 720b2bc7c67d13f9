"""Document pipeline: ids, chunks, tags, text keys, vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import fold
from granary.functions.urls import host
from granary.functions.text import strip_accents
from granary.operators import retrieval, textops
from granary.operators.relational import top_k
from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@C.query("select doc_id, coalesce(source, 'inconnu') || '_' || md5(text) as content_id from documents")
def content_ids(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed document ids."""
    return docs(spark, d).select("doc_id", retrieval.content_id(F.col("source"), F.col("text")).alias("content_id"))


@C.query("select md5(text) as hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One document per text, the least id, with the number of copies; hashes are shuffled, not texts."""
    return docs(spark, d).groupBy(F.md5("text").alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@C.query("select doc_id from documents where md5(text) not in (select md5(text) from documents where source = 'etude_sol')")
def incremental_selection(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content isn't indexed yet."""
    x = docs(spark, d).select("doc_id", F.md5("text").alias("h"), "source")
    return x.join(x.where("source = 'etude_sol'").select("h").distinct(), "h", "left_anti").select("doc_id")


@C.query("""
select doc_id, i as chunk_no, substr(text, i * 530 + 1, 650) as chunk from documents,
 lateral (select unnest(generate_series(0, cast(greatest(ceil((length(text) - 120) / 530.0), 1) as bigint) - 1)) as i)""")
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks of 650 characters, 120 shared with the one before."""
    return retrieval.fixed_chunks(docs(spark, d).select("doc_id", "text"), "text", 650, 120)


@C.query()
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of whole sentences of at most 650 characters that overlap by up to 120; a longer sentence is a chunk by itself."""
    return retrieval.sentence_chunks(docs(spark, d).select("doc_id", "text"), "text", 650, 120)


@C.query("select doc_id, coalesce(lower(strip_accents(trim(replace(text, chr(160), ' ')))), '') as key from documents")
def accent_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Every whole text trimmed, in lower case, compatibility forms decomposed, without accents; null is empty."""
    return textops.normalised(docs(spark, d), "doc_id", "text")


@C.query("""
select doc_id, cast(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.3) as integer) as tokens,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) < 5 as vague from documents""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Token estimate from words, and whether a text is too short to be answered."""
    return docs(spark, d).select(
        "doc_id", textops.token_estimate(F.col("text")).alias("tokens"), (textops.word_count(F.col("text")) < 5).alias("vague"))


@C.query("""
select doc_id, unnest([substr(text, i * 160 + 1, 160) for i in generate_series(0, (length(text) - 1) // 160)]) as segment from documents where length(text) >= 1""")
def sms_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every text, of any length, cut into segments of 160 characters."""
    t = docs(spark, d).where(F.length("text") >= 1)
    return t.select("doc_id", F.explode(textops.segments(F.col("text"), 160)).alias("segment"))


@C.query("""
select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview,
 substr(trim(replace(text, chr(10), ' ')), 1, 500) as csv_content from documents""")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    """Previews with a mark where text was cut, and one-line content for CSV."""
    t = F.col("text")
    return docs(spark, d).select("doc_id", textops.truncate(t, 200).alias("preview"), textops.one_line(t, 500).alias("csv_content"))


FOLDERS = {
    "news_articles": ("news_article", "actualites_agricoles"), "fao_publications": ("fao_publication", "recherche_fao"),
    "technical_resources": ("technical_resource", "ressources_techniques"), "data_platforms": ("statistical_data", "donnees_statistiques"),
    "fews_net": ("fews_report", "securite_alimentaire"), "soil_grids": ("soil_data", "pedologie"),
}  # fixed values: folders with the type and category of what lies in them
_PATH = """(select doc_id, 'raw/' || ['news_articles', 'fao_publications', 'technical_resources', 'data_platforms', 'fews_net', 'soil_grids', 'divers'][1 + doc_id % 7] || '/' || coalesce(source, 'x') || '.txt' as path from documents)"""


@C.query(f"""
with x as (select doc_id, path, string_split(path, '/')[2] as folder, lower(string_split(path, '/')[-1]) as file from {_PATH}),
k(folder, doc_type, category) as (values ('news_articles', 'news_article', 'actualites_agricoles'), ('fao_publications', 'fao_publication', 'recherche_fao'),
 ('technical_resources', 'technical_resource', 'ressources_techniques'), ('data_platforms', 'statistical_data', 'donnees_statistiques'), ('fews_net', 'fews_report', 'securite_alimentaire'), ('soil_grids', 'soil_data', 'pedologie')),
y as (select doc_id, k.folder, coalesce(k.doc_type, case when contains(file, 'bulletin') or contains(file, 'meteo') then 'weather_bulletin' else 'agronomy_knowledge' end) as doc_type,
 coalesce(k.category, case when contains(file, 'bulletin') or contains(file, 'meteo') then 'climat' else 'technique_culturale' end) as category from x left join k using (folder))
select doc_id, doc_type, category, coalesce(folder, 'raw_data') as source_folder, case when doc_type in ('news_article', 'fao_publication', 'technical_resource') then 'high'
 when doc_type in ('weather_bulletin', 'fews_report') then 'medium' else 'normal' end as priority from y""")
def doc_type_from_path(spark: SparkSession, d: str) -> DataFrame:
    """Type, category, folder and priority of a document from its path."""
    names = F.array(*map(F.lit, (*FOLDERS, "divers")))
    path = F.concat(F.lit("raw/"), F.element_at(names, (F.col("doc_id") % 7 + 1).cast("int")), F.lit("/"), F.coalesce("source", F.lit("x")), F.lit(".txt"))
    x = docs(spark, d).select("doc_id", retrieval.path_class(path, FOLDERS).alias("c")).select("doc_id", "c.*")
    t = F.col("doc_type")
    return x.withColumn("priority", F.when(t.isin("news_article", "fao_publication", "technical_resource"), "high").when(t.isin("weather_bulletin", "fews_report"), "medium").otherwise("normal"))


@C.query("""
with x as (select doc_id, lower(strip_accents(text)) as t from documents)
select doc_id, array_to_string(list_sort(list_distinct([case v when 'mais' then 'maïs' when 'niebe' then 'niébé' else v end for v in regexp_extract_all(t, 'mais|sorgho|mil|coton|arachide|niebe|riz|oignon|tomate|manioc|sesame')])), ',') as crops,
 array_to_string(list_sort(list_distinct([case v when 'secheresse' then 'sécheresse' when 'temperature' then 'température' when 'humidite' then 'humidité' when 'innondation' then 'inondation' else v end
 for v in regexp_extract_all(t, 'pluie|secheresse|inondation|innondation|temperature|vent|humidite|climat')])), ',') as weather,
 array_to_string(list_sort(list_distinct(regexp_extract_all(t, 'marche|prix|subvention|irrigation|semences|engrais|pesticide|bio|elevage'))), ',') as themes from x""")
def tag_entities(spark: SparkSession, d: str) -> DataFrame:
    """Crops, weather and themes named in a text, without word boundaries, under their canonical names, sorted."""
    folded = F.lower(strip_accents(F.col("text")))
    return docs(spark, d).withColumn("folded", folded).select(
        "doc_id", *(F.array_join(retrieval.tags("folded", words), ",").alias(name) for name, words in retrieval.TAGS.items()))


# fixed values: terms of which a relevant page holds at least two
TERMS = (
    "burkina", "faso", "sahel", "agriculture", "céréale", "mil", "sorgho", "maïs", "culture", "irrigation", "fertilisant", "semence", "récolte",
    "climat", "sécheresse", "pluviométrie", "agronomie", "paysan", "production", "rendement", "technique", "pratique",
)


@C.query("""
with t(term) as (select unnest(['burkina', 'faso', 'sahel', 'agriculture', 'céréale', 'mil', 'sorgho', 'maïs', 'culture', 'irrigation', 'fertilisant', 'semence', 'récolte',
 'climat', 'sécheresse', 'pluviométrie', 'agronomie', 'paysan', 'production', 'rendement', 'technique', 'pratique'])),
x as (select doc_id, lower(coalesce(source, '') || ' ' || text) as c from documents where text is not null)
select doc_id, count(*)::int as hits from x join t on contains(c, term) group by 1 having count(*) >= 2""")
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose place or text holds at least two of the terms."""
    hits = textops.hits(F.concat(F.coalesce("source", F.lit("")), F.lit(" "), "text"), TERMS)
    return docs(spark, d).where("text is not null").select("doc_id", hits.alias("hits")).where("hits >= 2")


# words of the domain that the scope is judged by; a parameter
DOMAIN = ("maïs", "mais", "sorgho", "mil", "riz", "coton", "niébé", "semis", "récolte", "champ", "parcelle", "sol", "compost", "engrais", "irrigation", "eau", "pluie", "prix", "marché", "stock")


@C.query("""
with x as (select doc_id, lower(trim(text)) as t, regexp_extract_all(lower(trim(text)), '[\\p{L}\\p{N}_]+') as w from documents where text is not null),
y as (select *, len(list_filter(w, lambda v: list_contains(['maïs', 'mais', 'sorgho', 'mil', 'riz', 'coton', 'niébé', 'semis', 'récolte', 'champ', 'parcelle', 'sol', 'compost', 'engrais', 'irrigation', 'eau', 'pluie', 'prix', 'marché', 'stock'], v))) as n from x)
select doc_id, case when contains(t, 'orage') then 'REJECT' when len(w) > 0 and n / len(w) >= 0.15 then 'ACCEPT' when t in ('bonjour', 'bonsoir', 'salut', 'hello', 'hi') or len(w) <= 2 then 'ACCEPT' else 'REJECT' end as scope,
 case when n > 0 then least(0.5 + 0.1 * n, 0.99)::double else 0.15::double end as confidence from y""")
def scope_guard(spark: SparkSession, d: str) -> DataFrame:
    """Scope by ordered rules: a forbidden term, 15 % of words of the domain, greetings and texts of two words, else out of scope."""
    low = F.trim(F.lower("text"))
    x = docs(spark, d).where("text is not null").select("doc_id", low.alias("t"), F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("w"))
    n = F.size(F.filter("w", lambda v: v.isin(*DOMAIN)))
    short = F.col("t").isin("bonjour", "bonsoir", "salut", "hello", "hi") | (F.size("w") <= 2)
    scope = F.when(F.contains("t", F.lit("orage")), "REJECT").when((F.size("w") > 0) & (n / F.greatest(F.size("w"), F.lit(1)) >= 0.15), "ACCEPT").when(short, "ACCEPT").otherwise("REJECT")
    return x.select("doc_id", scope.alias("scope"), F.when(n > 0, F.least(F.lit(0.5) + F.lit(0.1) * n, F.lit(0.99))).otherwise(0.15).alias("confidence"))


@C.query("""
select doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') as slug,
 substr(regexp_replace(text, '[<>:"/\\\\|?*]', '_', 'g'), 1, 70) as file_name from documents""")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs and safe file names of every text; only the file name is cut, to 70 characters after it is cleaned."""
    t = F.col("text")
    return docs(spark, d).select("doc_id", textops.slug(t).alias("slug"), F.substring(textops.safe_name(t), 1, 70).alias("file_name"))


@C.query("""
select doc_id, len(regexp_extract_all(text, '[0-9]+([.,][0-9]+)?')) as numbers, len(regexp_extract_all(lower(text), 'environ|peut-être|about|maybe')) as hedges from documents""")
def suspicious_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and hedging words of a text."""
    return docs(spark, d).select(
        "doc_id", F.regexp_count("text", F.lit(r"[0-9]+([.,][0-9]+)?")).alias("numbers"),
        F.regexp_count(F.lower("text"), F.lit("environ|peut-être|about|maybe")).alias("hedges"))


@C.query("""
select page_id, lower(regexp_extract(trim(url), '^[a-zA-Z]+://([^/?#:]*)', 1)) as host,
 regexp_replace(regexp_replace(trim(url), '#.*$', ''), '\\?.*$', '') as key from web_articles where url is not null""")
def url_parts_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Host of a url, and the url without query and fragment as its key."""
    return table(spark, d, "web_articles").where("url is not null").select(
        "page_id", host(F.col("url")).alias("host"), F.regexp_replace(F.trim("url"), r"[?#].*$", "").alias("key"))


@C.query("""
select substr(md5(url), 1, 12) as key, count(distinct page_id) as pages, min(page_id) as first_page from web_articles where url is not null group by 1""")
def url_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue of resources: one entry per url, keyed by a short hash."""
    w = table(spark, d, "web_articles").where("url is not null").select("url", "page_id")
    return w.groupBy(F.substring(F.md5("url"), 1, 12).alias("key")).agg(F.count_distinct("page_id").alias("pages"), F.min("page_id").alias("first_page"))


@C.query("""
select source_type, count(*) as total, count(*) filter (status = 'success') as success, count(*) filter (status <> 'success') as failed,
 round(100.0 * count(*) filter (status = 'success') / count(*), 2) as rate from web_articles group by 1""")
def scrape_report(spark: SparkSession, d: str) -> DataFrame:
    """Success of scraping by type of source."""
    ok = F.count_if(F.col("status") == "success")
    return table(spark, d, "web_articles").groupBy("source_type").agg(
        F.count("*").alias("total"), ok.alias("success"), F.count_if(F.col("status") != "success").alias("failed"),
        F.round(ok * 100.0 / F.count("*"), 2).alias("rate"))


@C.query("""
select pub_id, regexp_extract(lower(pdf_data.metadata.filename), '([a-z]{2}[0-9]{4,}[a-z]{2})', 1) as fao_code,
 coalesce(nullif(pdf_data.content, ''), nullif(content, '')) is not null as has_text from publications""")
def publication_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes read from file names, and whether any text is there (the file's text goes before the page's)."""
    return table(spark, d, "publications").select(
        "pub_id", F.regexp_extract(F.lower("pdf_data.metadata.filename"), "([a-z]{2}[0-9]{4,}[a-z]{2})", 1).alias("fao_code"),
        F.coalesce(F.nullif("pdf_data.content", F.lit("")), F.nullif("content", F.lit(""))).isNotNull().alias("has_text"))


@C.query("""
with e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
s as (select q.vec_id as query_id, e.vec_id, round(list_inner_product(e.v, q.v), 5) as score from e join e q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id)
select * from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact inner-product search for every query vector, those with an id divisible by 20."""
    e = table(spark, d, "embeddings")
    return retrieval.search_all(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10).drop("rank")


@C.query("""
with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
s as (select q.vec_id as query_id, e.vec_id, e.label = q.label as same, round(list_inner_product(e.v, q.v), 5) as score
 from e join e q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id),
t as (select * from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20),
u as (select query_id, vec_id, score + case when same then 1 else 0 end as reranked from t)
select * from u qualify row_number() over (partition by query_id order by reranked desc, vec_id) <= 5""")
def vector_topk_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Search for every query vector, then a second score over the first results of each."""
    e = table(spark, d, "embeddings")
    found = retrieval.search_all(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 20)
    labels = e.select("vec_id", "label")
    queries = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    found = found.join(labels, "vec_id").join(queries, "query_id")
    second = F.col("score") + F.when(F.col("label") == F.col("query_label"), 1).otherwise(0)
    found = found.select("query_id", "vec_id", second.alias("reranked"))
    return top_k(found, ["query_id"], [F.desc("reranked"), F.asc("vec_id")], 5).drop("rank")


@C.query("""
with s as (select label, vec_id, round(list_inner_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(embedding, lambda x: cast(x as double))), 5) as norm from embeddings)
select label, vec_id, norm, r as rank from (select *, row_number() over (partition by label order by norm desc, vec_id) r from s) where r <= 3""")
def ranked_per_label(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest vectors of each label."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.round(retrieval.inner_product(F.col("embedding"), F.col("embedding")), 5).alias("norm"))
    return top_k(e, ["label"], [F.desc("norm"), F.asc("vec_id")], 3)


@C.query("""
select source, string_agg('[Doc ' || r || '] ' || substr(text, 1, 500), chr(10) order by r) as context, string_agg(doc_id, ',' order by r) as sources from (
 select *, row_number() over (partition by source order by n_chars desc, doc_id) r from documents) where r <= 3 group by 1""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Numbered excerpts (500 characters, as the assembly asks for) of the three longest documents of each source, and which these are."""
    t = top_k(docs(spark, d).select("source", "doc_id", "n_chars", F.substring("text", 1, 500).alias("head")), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)
    parts = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.format_string("[Doc %d] %s", "rank", "head").alias("t"))))
    joined = lambda f, by: F.array_join(F.transform(parts, f), by)
    return t.groupBy("source").agg(joined(lambda x: x["t"], "\n").alias("context"), joined(lambda x: x["doc_id"].cast("string"), ",").alias("sources"))


@C.query("select lang, count(*) as n, sum(n_chars) as chars, count(distinct source) as sources from documents group by 1")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of the corpus by language."""
    return docs(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@C.query("""select doc_id from documents where source = 'note_marche' and crop ilike '%mil%' and zone_id is not null""")
def docs_by_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Documents by metadata, without case."""
    return docs(spark, d).where((F.col("source") == "note_marche") & F.col("crop").ilike("%mil%") & F.col("zone_id").isNotNull()).select("doc_id")


@C.query("""select lower(strip_accents(name)) as key, count(distinct farm_id) as farms from farms where name is not null group by 1 having count(distinct farm_id) > 1""")
def same_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of several farms, compared without case and accents."""
    f = table(spark, d, "farms").where("name is not null").select(fold(F.col("name")).alias("key"), "farm_id").distinct()
    return f.groupBy("key").agg(F.count("*").alias("farms")).where("farms > 1")
