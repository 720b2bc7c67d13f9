"""Queries of problems 2, 4 and 5: records, clocks and quantities made uniform."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.urls import site
from granary.operators import clocks, quantities, records
from granary.operators.relational import lookup
from granary.plans.staging import stage
from granary.sources.tables import table

FIELDS = ("date_published", "date_modified", "scraped_at")


def _clock_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Values read, declared zones, candidate zones (all offset histories) and abbreviations."""
    sites, scrapers = table(spark, d, "sites"), table(spark, d, "scrapers")
    own = F.concat(F.lit("site:"), site(F.col("url")))
    scraper = F.concat(F.lit("scraper:"), F.col("scraper_id"))
    pages = table(spark, d, "web_articles").select(
        F.col("page_id").alias("page"), own.alias("_site"),
        F.explode(F.array(*(
            F.struct(F.lit(f).alias("field"), (scraper if f == "scraped_at" else own).alias("source"), F.col(f).alias("value"))
            for f in FIELDS
        ))).alias("x"),
    ).select("page", "_site", "x.*")
    orders = sites.select(F.concat(F.lit("site:"), F.lower("host")).alias("o_site"), "day_order").dropDuplicates(["o_site"])
    values = lookup(pages, orders, "_site", "o_site")
    declared = sites.select(F.concat(F.lit("site:"), F.lower("host")).alias("source"), F.col("tz").alias("zone")).unionByName(
        scrapers.select(F.concat(F.lit("scraper:"), "scraper_id").alias("source"), F.col("tz").alias("zone"))
    ).where(F.col("source").isNotNull() & F.col("zone").isin(*available_timezones())).dropDuplicates(["source"])
    declared_zones = [r[0] for r in declared.select("zone").distinct().collect()]  # names of time zones only, some hundreds exist
    zones = clocks.offset_histories(declared_zones)
    short = spark.createDataFrame(clocks.abbreviations([*zones, *declared_zones]) or [("UTC", "utc", 0)], "zone string, name string, offset long")
    candidates = spark.createDataFrame([(z,) for z in zones], "zone string")
    return clocks.read(values.select("page", "field", "source", "day_order", "value")), declared, candidates, short


def _merkle(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = table(spark, d, "raw_records")
    return records.merkle(raw.select("record_id", F.col("source_file").alias("source"), "payload"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of the flat tables of steps, files and units."""
    return records.flat_leaves(*_merkle(spark, d))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct subtree once, with the number of links that lead to it."""
    _, nodes, bridge = _merkle(spark, d)
    used = bridge.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("links"))
    return nodes.join(used, "node", "left").select(
        F.lower(F.hex("node")).alias("node"), "kind", "value", F.coalesce("links", F.lit(0)).alias("links"))


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    """The links from each distinct parent to its members, and from each record to its root."""
    roots, _, bridge = _merkle(spark, d)
    name = lambda c: F.lower(F.hex(c))
    links = bridge.select(name("parent").alias("parent"), "member", "pos", name("child").alias("child"), "quoted")
    return links.unionByName(roots.select(
        F.col("record_id").alias("parent"), F.lit(None).cast("string").alias("member"), F.lit(0).alias("pos"), name("node").alias("child"), "quoted"))


def p4_histories(spark: SparkSession, d: str) -> DataFrame:
    """The offset history chosen for each site and scraper, with its violations."""
    r, declared, candidates, short = _clock_tables(spark, d)
    return clocks.zone_histories(clocks.zone_violations(r, declared, candidates, "scraped_at", short))


def p4_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Each value that names one instant, with the basis of its zone; estimated zones are marked, and tied ones."""
    r, declared, candidates, short = _clock_tables(spark, d)
    r = stage(r, "p4-read")
    histories = stage(clocks.zone_histories(clocks.zone_violations(r, declared, candidates, "scraped_at", short)), "p4-zones")
    return clocks.normalise(r, histories, short).select(
        F.col("page").alias("page_id"), F.col("field").alias("field_name"), "value",
        clocks.utc_text(F.col("utc_micros")).alias("utc"), "basis", "tied",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that name exactly one instant: of those normalised the ones with explicit offsets and on clocks that are known; estimates aren't cases."""
    return p4_normalised(spark, d).where("basis <> 'estimated'").select("page_id", "field_name", "utc").distinct()


def p5_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every stock in base units, with the basis of its unit; inferred units are marked."""
    names = ("stocks", "farms", "zones", "unit_reference")
    return quantities.normalise(*(table(spark, d, n) for n in names))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Stocks whose quantity and unit are known, in thousandths of the base unit."""
    return quantities.known(*(table(spark, d, n) for n in ("stocks", "farms", "zones", "unit_reference")))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_bridge, p4_found, p4_normalised, p4_histories, p5_found, p5_normalised)}


# fixed values of the SQL, written apart from those of ``granary.functions.units`` so that the comparison means something
_SPELT = """('kgs','kg'), ('kilo','kg'), ('kilos','kg'), ('kilogramme','kg'), ('kilogrammes','kg'), ('kilogram','kg'), ('kilograms','kg'),
 ('gr','g'), ('grs','g'), ('gramme','g'), ('grammes','g'), ('gram','g'), ('grams','g'),
 ('to','t'), ('tonne','t'), ('tonnes','t'), ('ton','t'), ('tons','t'),
 ('q','quintal'), ('qx','quintal'), ('qt','quintal'), ('qtx','quintal'), ('qtl','quintal'), ('quintaux','quintal'), ('quintals','quintal'),
 ('lbs','lb'), ('livre','lb'), ('livres','lb'), ('pound','lb'), ('pounds','lb'),
 ('sacs','sac'), ('bag','sac'), ('bags','sac'), ('tines','tine'), ('plats','plat'), ('paniers','panier'), ('basket','panier'), ('baskets','panier'),
 ('charrettes','charrette'), ('cart','charrette'), ('carts','charrette'),
 ('lt','l'), ('lts','l'), ('ltr','l'), ('litre','l'), ('litres','l'), ('liter','l'), ('liters','l'),
 ('millilitre','ml'), ('millilitres','ml'), ('milliliter','ml'), ('milliliters','ml'),
 ('centilitre','cl'), ('centilitres','cl'), ('centiliter','cl'), ('centiliters','cl'), ('bidons','bidon'), ('futs','fut'),
 ('gallons','gallon'), ('gal','gallon'), ('pieces','piece'), ('pce','piece'), ('pces','piece'), ('pc','piece'), ('pcs','piece'),
 ('unite','piece'), ('unites','piece'), ('tete','piece'), ('tetes','piece'),
 ('douzaines','douzaine'), ('dz','douzaine'), ('dzn','douzaine'), ('dozen','douzaine'), ('dozens','douzaine')"""
_COUNTED = "('dizaine', 10), ('vingtaine', 20), ('cinquantaine', 50), ('centaine', 100), ('millier', 1000), ('million', 1000000)"
_EMPTY = "'', '-', '--', '?', '??', 'n/a', 'na', 'nd', 'n.d.', 'none', 'null', 'voir libelle', 'cf libelle', 'inconnu', '.'"


def _p5_sql() -> str:
    """The stated and named part of p5 in SQL. Plural marks are taken off first, so that brackets are read otherwise than in the query."""
    fold = lambda c: f"lower(strip_accents(trim(regexp_replace({c}, '\\s+', ' ', 'g'))))"
    number = "([0-9]+(?:[.,][0-9]+)?)"
    first, package = f"^(?:x ?)?{number} ?([a-z]+)(?: ?(?:/|par|le|la) ?[a-z]+)?$", f"^[a-z]+ ?(?:de|d''|/|_|-|:|x|a)? ?{number} ?([a-z]+)$"
    counted, named = "^([a-z]+?)s? (?:de |d'')([a-z]+)$", "^(.*?)(?: / |,? cond\\.? | - en | en |\\(|\\[)([^()\\[\\]]+)[)\\]]?$"
    return f"""
with spelt(word, label) as (values {_SPELT}), counting(word, times) as (values {_COUNTED}),
s as (select distinct stock_id, farm_id, regexp_replace(trim(regexp_replace(item_name, '\\s+', ' ', 'g')), '\\((?:s|x|es)\\)', '', 'gi') as item, unit, quantity,
  unit is null or {fold('unit')} in ({_EMPTY}) as empty from stocks where quantity is not null and not isnan(quantity)),
t as (select *, nullif(regexp_extract(item, '{named}', 2), '') as suffix from s),
u as (select *, {fold("case when suffix is null then item else regexp_extract(item, '" + named + "', 1) end")} as name,
  regexp_replace({fold('case when empty then suffix else unit end')}, '\\((?:s|x|es)\\)|\\.$', '', 'g') as w from t),
v as (select u.*, case when regexp_matches(w, '{first}') then regexp_extract(w, '{first}', 2) when regexp_matches(w, '{counted}') and k.times is not null
   then regexp_extract(w, '{counted}', 2) when regexp_matches(w, '{package}') then regexp_extract(w, '{package}', 2) else w end as word,
  case when regexp_matches(w, '{first}') then cast(replace(regexp_extract(w, '{first}', 1), ',', '.') as double)
   when regexp_matches(w, '{counted}') and k.times is not null then k.times
   when regexp_matches(w, '{package}') then cast(replace(regexp_extract(w, '{package}', 1), ',', '.') as double) else 1.0 end as times
  from u left join counting k on k.word = regexp_extract(w, '{counted}', 1)),
x as (select v.*, coalesce(spelt.label, v.word) as label from v left join spelt on spelt.word = v.word),
y as (select x.*, z.region from x left join farms f on f.farm_id = x.farm_id left join zones z on z.zone_id = f.zone_id)
select distinct stock_id, coalesce(i.base_unit, g.base_unit, r.base_unit) as base_unit,
 cast(round(cast(quantity as decimal(14, 6)) * cast(coalesce(i.factor, g.factor, r.factor) * times * 1000 as decimal(18, 3)), 0) as bigint) as base_milli
from y left join unit_reference r on r.unit_label = label and r.item_name is null and r.region is null
left join unit_reference i on i.unit_label = label and lower(strip_accents(i.item_name)) = name
left join unit_reference g on g.unit_label = label and g.region = y.region
where coalesce(i.factor, g.factor, r.factor) is not null"""


SQL: dict[str, str] = {"p5_found": _p5_sql()}
