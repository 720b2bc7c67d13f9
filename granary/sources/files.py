"""File sources: weather, soil and chart JSON, price data sets, document folders, contact cards, JDBC tables.

Schemas are explicit, so nothing is inferred at read time; unknown members are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.text import fold

WEATHER = (
    "metadata struct<zone_name:string, latitude:double, longitude:double, download_date:string>, "
    "daily struct<time:array<string>, temperature_2m_max:array<double>, temperature_2m_min:array<double>, precipitation_sum:array<double>, "
    "et0_fao_evapotranspiration:array<double>>"
)
SOIL = "metadata struct<lat:double, lon:double>, layers map<string, map<string, struct<mean:double, uncertainty:double>>>"
CHART = (
    "results array<struct<url:string, metadata:struct<city:string, raw_data:array<struct<title:string, "
    "series:array<struct<name:string, data:array<struct<category:bigint, y:double>>>>>>>>>"
)
PRICES = (
    "prices map<string, struct<aliases:array<string>, price:double, fair_price:double, volatility:double>>, "
    "offers array<struct<side:string, commodity:string, quantity:double, location:string, contact:string>>, "
    "seasonal map<string, map<string, string>>"
)


def weather(spark: SparkSession, path: str) -> DataFrame:
    """(zone, latitude, longitude, day, t_max, t_min, rain, et0) of column-oriented files, one row per day.

    Arrays of unequal length, and missing ones, are padded with nulls.
    """
    return weather_rows(spark.read.schema(WEATHER).option("multiLine", True).json(path))


def weather_rows(raw: DataFrame) -> DataFrame:
    """The rows of weather() of ``raw`` with the schema WEATHER."""
    names = {
        "time": "time", "temperature_2m_max": "t_max", "temperature_2m_min": "t_min", "precipitation_sum": "rain", "et0_fao_evapotranspiration": "et0",
    }
    # a missing array counts as an empty one; arrays_zip would make the whole file null
    rows = F.arrays_zip(*[F.coalesce(F.col(f"daily.{k}"), F.array()).alias(v) for k, v in names.items()])
    long = raw.select("metadata", F.explode(rows).alias("r"))
    return long.select(
        F.col("metadata.zone_name").alias("zone"), "metadata.latitude", "metadata.longitude", F.col("r.time").try_cast("date").alias("day"),
        "r.t_max", "r.t_min", "r.rain", "r.et0")


def soil(spark: SparkSession, path: str) -> DataFrame:
    """(lat, lon, property, depth, mean, uncertainty) of property and depth maps."""
    return soil_rows(spark.read.schema(SOIL).option("multiLine", True).json(path))


def soil_rows(raw: DataFrame) -> DataFrame:
    """The rows of soil() of ``raw`` with the schema SOIL."""
    a = raw.select("metadata.lat", "metadata.lon", F.explode("layers").alias("property", "depths"))
    b = a.select("lat", "lon", "property", F.explode("depths").alias("depth", "v"))
    return b.select("lat", "lon", "property", "depth", "v.mean", "v.uncertainty")


def charts(spark: SparkSession, path: str) -> DataFrame:
    """(city, title, series, at, value) of chart files; series without data give one row of nulls."""
    return chart_rows(spark.read.schema(CHART).option("multiLine", True).json(path))


def chart_rows(raw: DataFrame) -> DataFrame:
    """The rows of charts() of ``raw`` with the schema CHART."""
    a = raw.select(F.explode_outer("results.metadata").alias("m"))
    b = a.select(F.col("m.city").alias("city"), F.explode_outer("m.raw_data").alias("c"))
    c = b.select("city", F.col("c.title").alias("title"), F.explode_outer("c.series").alias("s"))
    d = c.select("city", "title", F.col("s.name").alias("series"), F.explode_outer("s.data").alias("p"))
    return d.select("city", "title", "series", F.timestamp_millis("p.category").alias("at"), F.col("p.y").alias("value"))


def prices(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    """``defaults(key, price, volatility)`` with the entries of a file put over them, member by member; keys are compared without case and accents.

    A fair price that isn't stated is the price, a volatility 0, aliases the key alone.
    """
    raw = spark.read.schema(PRICES).option("multiLine", True).json(path)
    own = raw.select(F.explode("prices").alias("name", "v")).select(fold(F.col("name")).alias("key"), "v.*")
    base = defaults.withColumn("key", fold(F.col("key")))
    return base.alias("d").join(own.alias("o"), "key", "full").select(
        "key", F.coalesce("o.price", "d.price").alias("price"), F.coalesce("o.fair_price", "o.price", "d.price").alias("fair_price"),
        F.coalesce("o.volatility", "d.volatility", F.lit(0.0)).alias("volatility"),
        F.coalesce(F.when(F.size("o.aliases") > 0, F.col("o.aliases")), F.array("key")).alias("aliases"))


def offers(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    """(side, commodity, quantity, location, contact) of a file if it has any, else of ``defaults``; commodities without case and accents."""
    raw = spark.read.schema(PRICES).option("multiLine", True).json(path)
    own = raw.select(F.explode("offers").alias("o")).select("o.*")
    out = defaults.select(*own.columns) if own.isEmpty() else own
    return out.withColumn("commodity", fold(F.col("commodity")))


def seasons(spark: SparkSession, path: str, defaults: DataFrame) -> DataFrame:
    """(key, name, value) of a file's seasons if it has any, else of ``defaults``."""
    raw = spark.read.schema(PRICES).option("multiLine", True).json(path)
    own = raw.select(F.explode("seasonal").alias("key", "m")).select(fold(F.col("key")).alias("key"), F.explode("m").alias("name", "value"))
    return defaults.select(*own.columns) if own.isEmpty() else own


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, kind, text) of the text and JSON files below a folder; metadata, temporary and log files left out."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    name = F.lower("file_name")
    keep = name.rlike(r"\.(txt|json)$") & ~name.rlike(r"(_meta\.json|\.tmp|\.log|report[^/]*)$")
    return raw.where(keep).select("path", "file_name", F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("kind"), "text")


def binaries(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) of binary files, for a reader given to mapInPandas."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "content")


def extracted(files: DataFrame, readers: list, enough: int = 100) -> DataFrame:
    """(path, text, reader) of ``files(path, content)`` by the first of ``readers`` that gives more than ``enough`` characters.

    A reader is a function from bytes to text, as installed libraries offer them; one
    that raises counts as having found nothing. If none finds enough the longest
    text holds; reader is its place from 0, null without any text.
    """
    def run(frames):
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                best, by = "", None
                for i, read in enumerate(readers):
                    try:
                        text = (read(bytes(content)) or "").strip() if content is not None else ""
                    except Exception:  # a broken file is a row without text, the others go on
                        text = ""
                    if len(text) > len(best):
                        best, by = text, i
                    if len(text) > enough:
                        break
                out.append((path, best or None, by))
            yield pd.DataFrame(out, columns=["path", "text", "reader"]).astype({"reader": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, text string, reader int")


def path_class(path: Column) -> Column:
    """struct(doc_type, category) of a path, by its folders in order."""
    p = F.split(F.lower(path), r"[/\\]")
    one = lambda t, c: F.struct(F.lit(t).alias("doc_type"), F.lit(c).alias("category"))
    return (
        F.when(F.array_contains(p, "meteo"), one("weather", "climate")).when(F.array_contains(p, "soil_grids"), one("soil", "soil"))
        .when(F.array_contains(p, "pdfs"), one("pdf", "technical")).when(F.array_contains(p, "news_articles"), one("news", "news"))
        .otherwise(one("other", "general"))
    )


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """(name, phone) of contact cards; of cards with one phone the first in its file holds."""
    cards = spark.read.option("lineSep", "END:VCARD").text(path)
    return card_rows(cards.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos")).alias("pos")))


def card_rows(cards: DataFrame) -> DataFrame:
    """The rows of contacts() of ``cards(value, pos)``."""
    x = cards.select(
        "pos", F.trim(F.regexp_extract("value", r"(?m)^FN[^:]*:(.*)$", 1)).alias("name"),
        F.regexp_replace(F.regexp_extract("value", r"(?m)^TEL[^:]*:(.*)$", 1), r"[^\d+]", "").alias("phone"))
    x = x.where("phone <> ''")
    return x.groupBy("phone").agg(F.min_by("name", "pos").alias("name")).select("name", "phone")


def jdbc(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in parallel by ranges of a numeric column."""
    r = spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(parts), fetchsize="10000")
    return r.options(**options).load()


def inbox(df: DataFrame, queue: str, order: list[str], limit: int = 10) -> DataFrame:
    """The first messages of each queue, first in first out."""
    w = W.partitionBy(queue).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
