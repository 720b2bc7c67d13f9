"""Text operators on columns: counts, cuts, slugs, keyword hits, message compression."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip_accents

# fixed values: phrases a short message can do without
STOP_PHRASES = (
    "Bonjour,", "Salut,", "Cher agriculteur,", "Cordialement,", "En tant que votre assistant,", "Je vous conseille de",
    "D'après mes analyses,", "Voici ce que je préconise :",
)
# fixed values: words and the signs that stand for them in a short message
ICONS = {
    "attention": "⚠️", "alerte": "🚨", "conseil": "💡", "importance": "❗", "pluie": "🌧️", "soleil": "☀️", "argent": "💰", "franc cfa": "F", "FCFA": "F",
}


def word_count(text: Column) -> Column:
    """Number of words between blanks."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """Tokens as 1.3 per word, cut to a whole number."""
    return F.floor(word_count(text) * F.lit(1.3)).cast("int")


def segments(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters."""
    numbers = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    return F.transform(numbers, lambda i: F.substring(text, i * size + 1, F.lit(size)))


def truncate(text: Column, size: int, mark: str = "...") -> Column:
    """The first ``size`` characters, with a mark if more follow."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def one_line(text: Column, size: int) -> Column:
    """The text on one line, trimmed, at most ``size`` characters."""
    return F.substring(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), 1, size)


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms the text contains, without case."""
    found = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t))
    return F.size(found)


def slug(text: Column) -> Column:
    """Letters and digits without accents, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _normalised_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t in b.column(1).to_pylist():
            t = unicodedata.normalize("NFKD", (t or "").lower().strip())
            out.append(t if t.isascii() else "".join(c for c in t if unicodedata.category(c) != "Mn"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "key"])


def normalised(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key column, key): each text in lower case, trimmed, NFKD without marks; no built-in decomposes."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), text).mapInArrow(_normalised_batches, f"id {kind}, key string").withColumnRenamed("id", key)


def safe_name(text: Column) -> Column:
    """A file name without reserved characters."""
    return F.regexp_replace(text, r'[<>:"/\\|?*]', "_")


def strip_markup(text: Column) -> Column:
    """Text for speech: markdown marks, tags and line breaks removed."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[*_#`~]+", ""), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def compress_message(text: Column, size: int = 320) -> Column:
    """A text for a short message: markup, filling phrases and line breaks out, signs for words, cut with dots at ``size``; empty for null."""
    t = F.coalesce(text, F.lit(""))
    for pattern, kept in ((r"\*\*(.*?)\*\*", "$1"), (r"\*(.*?)\*", "$1"), (r"#+\s", ""), (r"\[(.*?)\]\(.*?\)", "$1"), (r"\n+", " ")):
        t = F.regexp_replace(t, pattern, kept)
    t = F.trim(t)
    for phrase in STOP_PHRASES:
        t = F.replace(t, F.lit(phrase), F.lit(""))
    for word, icon in ICONS.items():
        t = F.regexp_replace(t, rf"(?iU)\b{word}\b", icon)
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size - 3), F.lit("..."))).otherwise(t)


def inbound_query(text: Column) -> Column:
    """The question behind a coded message: M for weather, P for prices, A for an alert."""
    t = F.upper(F.trim(text))
    rest = F.substr(t, F.lit(3))
    return (
        F.when(t.startswith("M "), F.concat(F.lit("Météo pour "), rest)).when(t.startswith("P "), F.concat(F.lit("Prix du marché pour "), rest))
        .when(t.startswith("A "), F.concat(F.lit("Je signale une alerte : "), rest)).otherwise(t)
    )


def confirmation(text: Column) -> Column:
    """CONFIRMED, CANCELLED or null by the first kind of answer a text holds."""
    yes, no = r"(?iU)\b(oui|ok|d'accord|c'est bon|valide|confirme)\b", r"(?iU)\b(non|annule|stop|pas bonne|erreur)\b"
    return F.when(text.rlike(yes), "CONFIRMED").when(text.rlike(no), "CANCELLED")


def first_json_block(text: Column) -> Column:
    """The first {...} block of a text that is JSON, else the text if it is; null if nothing is."""
    is_json = lambda x: F.try_parse_json(x).isNotNull()
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?s)(\{.*?\})"), 1), is_json)
    return F.coalesce(F.get(blocks, F.lit(0)), F.when(is_json(text), text))


def fenced(text: Column) -> Column:
    """What stands in the first code fence of a text, without the word json; the text itself if it has none."""
    parts = F.split(text, "```")
    return F.when(F.size(parts) > 1, F.regexp_replace(parts[1], "^json", "")).otherwise(text)


def surface_m2(text: Column) -> Column:
    """A surface in a text, hectares before square metres, in m²; null without one."""
    number = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), ",", ".").try_cast("double")
    ha = number(r"(\d+(?:[.,]\d+)?)\s*(?:ha|hectare|hectares)")
    m2 = number(r"(\d+(?:[.,]\d+)?)\s*(?:m2|m²|mc|metres?\s*carres?|mètres?\s*carrés?)")
    return F.coalesce(ha * 10000, m2)


def key(text: Column) -> Column:
    """A key as registries compare it: upper case, trimmed."""
    return F.upper(F.trim(text))


def is_phone(text: Column) -> Column:
    """True for international phone numbers, blanks and brackets aside."""
    return F.regexp_replace(text, r"[\s\-()]", "").rlike(r"^\+?[1-9]\d{7,14}$")


def clean_control(text: Column, size: int = 2000) -> Column:
    """Control characters but line breaks and tabs removed, at most ``size`` characters."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F]", ""), 1, size)


def missing_fields(required: tuple[str, ...]) -> Column:
    """The names of required columns that are null."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
