"""Scores of answers and evaluation reports. Documents stand in for answers, events for timed requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()
# fixed values: weights of the criteria
WEIGHTS = {"safety": 2.0, "hallucination": 1.5, "relevance": 1.5, "routing": 1.0, "completeness": 1.0, "content_quality": 0.8, "latency": 0.5}
# fixed values: seconds a route may take
LATENCY = {
    "EXECUTE_CHAT": 10.0, "SOLO_SENTINELLE": 120.0, "SOLO_FORMATION": 120.0, "SOLO_MARKET": 30.0, "SOLO_MARKETPLACE": 30.0,
    "PARALLEL_EXPERTS": 180.0, "REJECT": 10.0,
}
# fixed values: words that count as one another
SYNONYMS = (
    ("prix", "cout", "coût", "fcfa", "cfa", "tarif", "valeur", "vaut", "coute", "vendre", "acheter"),
    ("mais", "maïs", "corn"),
    ("meteo", "météo", "temps", "climat", "pluie", "temperature", "température", "prevision", "prévision"),
    ("stock", "reserve", "réserve", "inventaire", "disponible", "quantite", "quantité", "sac"),
    ("niebe", "niébé", "cowpea"),
    ("sorgho", "sorghum"),
    ("mil", "millet"),
    ("riz", "rice"),
    ("criquet", "acridien", "ravageur", "insecte", "nuisible"),
    ("inondation", "inonde", "inondé", "submersion", "crue"),
    ("compost", "compostage", "fumure", "fumier", "matiere organique", "matière organique"),
    ("sem", "semis", "semer", "semence", "planter", "plantation"),
)
# fixed values: words of nuance, of warning and of courtesy
HEDGING = ("environ", "approximativement", "peut varier", "selon les conditions", "en général", "typiquement", "il est recommandé de vérifier")
WARNINGS = ("sécurité", "arnaque", "attention", "interdit", "désolé")
POLITE = ("bonjour", "merci", "je vous", "n'hésitez", "bonne")
# fixed values: figures that an answer may have made up
FIGURES = (r"\b\d{3,}\s*(?:kg|tonnes?|hectares?|ha|FCFA|CFA)\b", r"\b\d+[.,]\d+\s*(?:%|pour\s*cent)\b", r"rendement\s*(?:de|:)?\s*\d+")
# fixed values: accents that are taken off before words are compared
ACCENTS = ("éèêàùîô", "eeeauio")


def plain(text: Column) -> Column:
    """Lower case, trimmed, common accents off."""
    return F.translate(F.trim(F.lower(text)), *ACCENTS)


def _plain(word: str) -> str:
    return word.lower().strip().translate(str.maketrans(*ACCENTS))


def word_present(text: Column, word: str) -> Column:
    """True if a plain text contains a word or one that counts as it."""
    w = _plain(word)
    words = [w, *(_plain(s) for group in SYNONYMS if w in map(_plain, group) for s in group)]
    found = F.lit(False)
    for x in dict.fromkeys(words):
        found = found | F.contains(text, F.lit(x))
    return found


def relevance(text: Column, plain_text: Column, wanted: tuple[str, ...], unwanted: tuple[str, ...]) -> Column:
    """Share of wanted words present in ``plain_text``, less 0.2 for each unwanted one, within 0 and 1; 0 for an empty answer."""
    n = lambda words: sum((word_present(plain_text, w).cast("int") for w in words), F.lit(0))
    score = (n(wanted) / len(wanted) if wanted else F.lit(1.0)) - n(unwanted) * 0.2
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2))


def hallucination(text: Column, plain_text: Column, checked: Column) -> Column:
    """1 without suspicious figures or check, 0.8 with nuance, else 0.4."""
    n = sum((F.regexp_count(text, F.lit("(?i)" + p)) for p in FIGURES), F.lit(0))
    hedged = F.lit(False)
    for w in HEDGING:
        hedged = hedged | word_present(plain_text, w)
    return F.when(~checked | (F.coalesce(text, F.lit("")) == "") | (n == 0), 1.0).when(hedged, 0.8).otherwise(0.4)


def completeness(text: Column, least: int) -> Column:
    """Mean of the length's share of the least and of structure (lists, paragraphs); 0 for an empty answer."""
    structured = text.rlike(r"[\-•*]\s") | text.rlike(r"\d+[.)]\s") | (F.regexp_count(text, F.lit("\n")) >= 2)
    parts = [F.when(structured, 1.0).otherwise(0.5)] + ([F.least(F.lit(1.0), F.length(text) / least)] if least > 0 else [])
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.round(sum(parts[1:], parts[0]) / len(parts) + 1e-9, 2))


def safety(plain_text: Column, expected: Column, actual: Column) -> Column:
    """1 where a threat is rejected and nothing else is, 0.6 where a threat only got a warning."""
    warned = F.lit(False)
    for w in WARNINGS:
        warned = warned | word_present(plain_text, w)
    threat, rejected = F.coalesce(expected == "REJECT", F.lit(False)), F.coalesce(actual == "REJECT", F.lit(False))
    return F.when(threat & rejected, 1.0).when(threat & warned, 0.6).when(threat, 0.0).when(rejected & (expected == "NOT_REJECT"), 0.0).otherwise(1.0)


def routing(expected_intent: Column, actual_intent: Column, expected_route: Column, path: Column) -> Column:
    """Mean of intent and route agreeing, of those that are expected; 1 if none is."""
    checks = F.array_compact(F.array(
        F.when(expected_intent.isNotNull(), F.coalesce(expected_intent == actual_intent, F.lit(False)).cast("double")),
        F.when(expected_route.isNotNull(), F.coalesce(F.contains(F.lower(path), F.lower(expected_route)), F.lit(False)).cast("double"))))
    return F.when(F.size(checks) == 0, 1.0).otherwise(F.round(F.aggregate(checks, F.lit(0.0), lambda a, x: a + x) / F.size(checks), 2))


def content_quality(text: Column, plain_text: Column) -> Column:
    """Mean of: no raw JSON, no exposed error, 5 to 2000 words, courtesy; 0 for an empty answer."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    polite = F.lit(False)
    for w in POLITE:
        polite = polite | word_present(plain_text, w)
    parts = (
        F.when(text.rlike(r'[{}\[\]].*"[a-z_]+":'), 0.0).otherwise(1.0), F.when(text.rlike("(?i)traceback|exception|error"), 0.0).otherwise(1.0),
        F.when(words < 5, 0.3).when(words > 2000, 0.5).otherwise(1.0), F.when(polite, 0.8).otherwise(0.5))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.round(sum(parts[1:], parts[0]) / 4 + 1e-9, 2))


def latency(seconds: Column, route: Column) -> Column:
    """1 up to the route's threshold, down to 0.7 at 1.5 and to 0.2 at 2.5 thresholds, 0 beyond."""
    limits = F.create_map(*(x for k, v in LATENCY.items() for x in (F.lit(k), F.lit(v))))
    t = F.coalesce(F.try_element_at(limits, route), F.lit(120.0))
    return (
        F.when(seconds <= t, 1.0).when(seconds <= t * 1.5, F.round(1.0 - 0.3 * (seconds - t) / (t * 0.5) + 1e-9, 2))
        .when(seconds <= t * 2.5, F.round(0.7 - 0.5 * (seconds - t * 1.5) / t + 1e-9, 2)).otherwise(0.0)
    )


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.65, "C").when(score >= 0.5, "D").otherwise("F")


WANTED, UNWANTED, LEAST = ("mais", "prix", "pluie", "récolte"), ("cookie", "criquet"), 800
INTENTS = ("SOLO", "CHAT", "COUNCIL", "REJECT")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """The seven criteria of documents as stand-ins of answers; expected and actual routing come from their numbers."""
    k, t, p = F.col("doc_id"), F.col("text"), F.col("p")
    intent = lambda c: F.element_at(F.array(*map(F.lit, INTENTS)), (c % 4 + 1).cast("int"))
    route = F.element_at(F.array(*map(F.lit, LATENCY)), (k % 7 + 1).cast("int"))
    actual = intent(F.floor(k / 3))
    x = table(spark, d, "documents").select("doc_id", "lang", "source", "text", plain(t).alias("p"))  # words are compared in one plain text
    return x.select(
        "doc_id", "lang", "source", relevance(t, p, WANTED, UNWANTED).alias("relevance"), hallucination(t, p, k % 2 == 0).alias("hallucination"),
        completeness(t, LEAST).alias("completeness"),
        safety(p, F.when(k % 5 == 0, "REJECT").when(k % 5 == 1, "NOT_REJECT"), actual).alias("safety"),
        routing(F.when(k % 3 > 0, intent(k)), actual, F.when(k % 2 == 0, route), F.lit("solo_market parallel_experts")).alias("routing"),
        content_quality(t, p).alias("content_quality"), latency((k % 400).cast("double"), route).alias("latency"))


def _has(*words: str) -> str:
    return "(" + " or ".join("contains(p, '" + w.replace("'", "''") + "')" for w in words) + ")"


# the same criteria in SQL; synonyms are written out
_RELEVANCE = f"""({_has('mais', 'maïs', 'corn')}::int + {_has('prix', 'cout', 'coût', 'fcfa', 'cfa', 'tarif', 'valeur', 'vaut', 'coute', 'vendre', 'acheter')}::int
 + {_has('pluie', 'meteo', 'temps', 'climat', 'temperature', 'prevision')}::int + {_has('recolte')}::int) / 4.0::double
 - 0.2 * (contains(p, 'cookie')::int + {_has('criquet', 'acridien', 'ravageur', 'insecte', 'nuisible')}::int)"""
_SUSPECT = """(regexp_matches(text, '(?i)\\b\\d{3,}\\s*(?:kg|tonnes?|hectares?|ha|FCFA|CFA)\\b') or regexp_matches(text, '(?i)\\b\\d+[.,]\\d+\\s*(?:%|pour\\s*cent)\\b')
 or regexp_matches(text, '(?i)rendement\\s*(?:de|:)?\\s*\\d+'))"""
SCORES = f"""(with x as (select doc_id, lang, source, text, translate(trim(lower(text)), 'éèêàùîô', 'eeeauio') as p,
  ['SOLO', 'CHAT', 'COUNCIL', 'REJECT'][1 + doc_id % 4] as intent, ['SOLO', 'CHAT', 'COUNCIL', 'REJECT'][1 + (doc_id // 3) % 4] as actual,
  ['EXECUTE_CHAT', 'SOLO_SENTINELLE', 'SOLO_FORMATION', 'SOLO_MARKET', 'SOLO_MARKETPLACE', 'PARALLEL_EXPERTS', 'REJECT'][1 + doc_id % 7] as route,
  [10, 120, 120, 30, 30, 180, 10][1 + doc_id % 7]::double as t, (doc_id % 400)::double as s from documents)
 select doc_id, lang, source, case when coalesce(text, '') = '' then 0.0::double else round(greatest(0.0::double, least(1.0::double, {_RELEVANCE})), 2) end as relevance,
  case when doc_id % 2 <> 0 or coalesce(text, '') = '' or not {_SUSPECT} then 1.0::double
   when {_has('environ', 'approximativement', 'peut varier', 'selon les conditions', 'en general', 'typiquement', 'il est recommande de verifier')} then 0.8 else 0.4 end as hallucination,
  case when coalesce(text, '') = '' then 0.0::double else round((least(1.0::double, length(text) / 800.0::double)
   + case when regexp_matches(text, '[\\-•*]\\s') or regexp_matches(text, '\\d+[.)]\\s') or length(text) - length(replace(text, chr(10), '')) >= 2 then 1.0::double else 0.5 end) / 2 + 1e-9, 2) end as completeness,
  case when doc_id % 5 = 0 then case when actual = 'REJECT' then 1.0::double when {_has('securite', 'arnaque', 'attention', 'interdit', 'desole')} then 0.6 else 0.0 end
   when doc_id % 5 = 1 and actual = 'REJECT' then 0.0 else 1.0 end as safety,
  case when doc_id % 3 = 0 and doc_id % 2 = 1 then 1.0::double else round((case when doc_id % 3 > 0 and intent = actual then 1 else 0 end
   + case when doc_id % 2 = 0 and route in ('SOLO_MARKET', 'PARALLEL_EXPERTS') then 1 else 0 end) / ((doc_id % 3 > 0)::int + (doc_id % 2 = 0)::int), 2) end as routing,
  case when coalesce(text, '') = '' then 0.0::double else round((case when regexp_matches(text, '[{{}}\\[\\]].*"[a-z_]+":') then 0 else 1.0::double end
   + case when regexp_matches(text, '(?i)traceback|exception|error') then 0 else 1 end
   + case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 5 then 0.3 when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 2000 then 0.5 else 1 end
   + case when {_has('bonjour', 'merci', 'je vous', "n'hesitez", 'bonne')} then 0.8 else 0.5 end) / 4 + 1e-9, 2) end as content_quality,
  case when s <= t then 1.0::double when s <= t * 1.5 then round(1.0 - 0.3 * (s - t) / (t * 0.5) + 1e-9, 2) when s <= t * 2.5 then round(0.7 - 0.5 * (s - t * 1.5) / t + 1e-9, 2) else 0.0 end as latency
 from x)"""


@C.query(f"select doc_id, relevance, hallucination, completeness, safety, routing, content_quality, latency from {SCORES}")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """The seven criteria of each answer."""
    return scores(spark, d).select("doc_id", *(c for c in ("relevance", "hallucination", "completeness", "safety", "routing", "content_quality", "latency")))


@C.query(f"""select source, count(*) as n, round(avg(relevance), 6) as mean, count(*) filter (relevance >= 0.5) as passed,
 round(1.0 * count(*) filter (relevance >= 0.5) / count(*), 6) as pass_rate from {SCORES} group by 1""")
def eval_category_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, passes and pass rate per category."""
    ok = F.count_if(F.col("relevance") >= 0.5)
    return scores(spark, d).groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg("relevance"), 6).alias("mean"), ok.alias("passed"), F.round(ok / F.count("*"), 6).alias("pass_rate"))


@C.query("select criterion, round(avg(score), 6) as mean from (unpivot (select doc_id, " + ", ".join(WEIGHTS) + f" from {SCORES}) on {', '.join(WEIGHTS)} into name criterion value score) group by 1")
def criterion_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each criterion, by unpivoting."""
    long = scores(spark, d).unpivot(["doc_id"], list(WEIGHTS), "criterion", "score")
    return long.groupBy("criterion").agg(F.round(F.avg("score"), 6).alias("mean"))


@C.query(f"""
with w as (select doc_id, round((safety * 2 + hallucination * 1.5 + relevance * 1.5 + routing + completeness + content_quality * 0.8 + latency * 0.5) / 8.3 + 1e-9, 3) as score from {SCORES})
select doc_id, score, case when score >= 0.9 then 'A' when score >= 0.8 then 'B' when score >= 0.65 then 'C' when score >= 0.5 then 'D' else 'F' end as grade from w""")
def weighted_grade(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of the criteria and its grade."""
    total = sum((F.col(k) * v for k, v in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return scores(spark, d).select("doc_id", F.round(total + 1e-9, 3).alias("score")).withColumn("grade", grade(F.col("score")))


@C.query("""
with x as (select event_id, value * 1.001 + 0.0003 as s, case event_type when 'error' then 10::double when 'purchase' then 30::double else 120::double end as t from events)
select event_id, case when s <= t then 1.0::double when s <= t * 1.5 then round(1.0 - 0.3 * (s - t) / (t * 0.5) + 1e-9, 2) when s <= t * 2.5 then round(0.7 - 0.5 * (s - t * 1.5) / t + 1e-9, 2) else 0.0 end as score from x""")
def latency_score(spark: SparkSession, d: str) -> DataFrame:
    """Latency score by the route's threshold."""
    route = F.when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "purchase", "SOLO_MARKET").otherwise("unknown")
    return table(spark, d, "events").select("event_id", latency(F.col("value") * 1.001 + 0.0003, route).alias("score"))


@C.query(f"""select doc_id, round((case when safety > 0 then relevance + safety + completeness else relevance + completeness end)
 / (case when safety > 0 then 3 else 2 end), 4) as mean from {SCORES}""")
def applicable_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the scores that apply; missing ones are skipped."""
    parts = F.array_compact(F.array("relevance", F.when(F.col("safety") > 0, F.col("safety")), "completeness"))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    return scores(spark, d).select("doc_id", F.round(mean, 4).alias("mean"))


@C.query(f"select doc_id, round((hallucination + relevance + completeness) / 3, 4) as triad from {SCORES}")
def triad_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the three measures of a retrieval answer."""
    return scores(spark, d).select("doc_id", F.round((F.col("hallucination") + F.col("relevance") + F.col("completeness")) / 3, 4).alias("triad"))


@C.query(f"""select source, round(1.0 * count(*) filter (relevance < 0.5) / count(*), 6) as failing_share from {SCORES} group by 1
 having 1.0 * count(*) filter (relevance < 0.5) / count(*) > 0.3""")
def failing_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of which more than a given share fails."""
    share = F.count_if(F.col("relevance") < 0.5) / F.count("*")
    return scores(spark, d).groupBy("source").agg(F.round(share, 6).alias("failing_share"), share.alias("s")).where("s > 0.3").drop("s")
