"""Reading units as they are typed: label, stated multiple or package size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import fold, squeeze

# fixed values: spellings (folded) of each unit label
SPELLINGS = {
    "kg": "kg kgs kilo kilos kilogramme kilogrammes kilogram kilograms",
    "g": "g gr grs gramme grammes gram grams",
    "t": "t to tonne tonnes ton tons",
    "quintal": "q qx qt qtx qtl quintal quintaux quintals",
    "lb": "lb lbs livre livres pound pounds",
    "sac": "sac sacs bag bags",
    "tine": "tine tines",
    "plat": "plat plats",
    "panier": "panier paniers basket baskets",
    "charrette": "charrette charrettes cart carts",
    "l": "l lt lts ltr litre litres liter liters",
    "ml": "ml millilitre millilitres milliliter milliliters",
    "cl": "cl centilitre centilitres centiliter centiliters",
    "bidon": "bidon bidons",
    "fut": "fut futs",
    "gallon": "gallon gallons gal",
    "piece": "piece pieces pce pces pc pcs unite unites tete tetes",
    "douzaine": "douzaine douzaines dz dzn dozen dozens",
}
# fixed values: entries that stand for no unit
PLACEHOLDERS = ("", "-", "--", "?", "??", "n/a", "na", "nd", "n.d.", "none", "null", "voir libelle", "cf libelle", "inconnu", ".")
# fixed values: counting words before a unit
COUNTING = {"dizaine": 10.0, "vingtaine": 20.0, "cinquantaine": 50.0, "centaine": 100.0, "millier": 1000.0, "million": 1e6}

_N = r"(\d+(?:[.,]\d+)?)"
NUMBER_FIRST = rf"^(?:x ?)?{_N} ?([a-z]+)(?: ?(?:/|par|le|la) ?[a-z]+)?$"
PACKAGE_FIRST = rf"^[a-z]+ ?(?:de|d'|/|_|-|:|x|a)? ?{_N} ?([a-z]+)$"
COUNTED = r"^([a-z]+?)s? (?:de |d')([a-z]+)$"
#: how a unit is written after an item's name
IN_NAME = r"^(.*?)(?: / |,? cond\.? | - en | en |\(|\[)((?:[^()\[\]]|\((?:s|x|es)\))+?)[)\]]?$"


def is_placeholder(unit: Column) -> Column:
    """True for null, empty and placeholder entries."""
    return unit.isNull() | fold(unit).isin(*PLACEHOLDERS)


def item_and_unit(item: Column) -> tuple[Column, Column]:
    """(item, unit written after it); the unit is null if there is none."""
    s = squeeze(item)
    unit = F.nullif(F.regexp_extract(s, IN_NAME, 2), F.lit(""))
    return F.when(unit.isNotNull(), F.trim(F.regexp_extract(s, IN_NAME, 1))).otherwise(s), unit


def _label(word: Column) -> Column:
    """The label of a spelling; other words stand for themselves, so that a table of units may know them."""
    names = [x for label, words in SPELLINGS.items() for w in words.split() for x in (F.lit(w), F.lit(label))]
    return F.coalesce(F.try_element_at(F.create_map(*names), word), word)


def read_unit(unit: Column) -> Column:
    """struct(label, times): the unit label and the stated multiple or package size (1 without)."""
    u = F.regexp_replace(fold(unit), r"\((?:s|x|es)\)|\.$", "")
    number = lambda p: F.regexp_replace(F.regexp_extract(u, p, 1), ",", ".").try_cast("double")
    names = [x for k, v in COUNTING.items() for x in (F.lit(k), F.lit(v))]
    counted = F.try_element_at(F.create_map(*names), F.regexp_extract(u, COUNTED, 1))
    one = lambda label, times: F.struct(_label(label).alias("label"), times.alias("times"))
    return (
        F.when(u.rlike(NUMBER_FIRST), one(F.regexp_extract(u, NUMBER_FIRST, 2), number(NUMBER_FIRST)))
        .when(u.rlike(COUNTED) & counted.isNotNull(), one(F.regexp_extract(u, COUNTED, 2), counted))
        .when(u.rlike(PACKAGE_FIRST), one(F.regexp_extract(u, PACKAGE_FIRST, 2), number(PACKAGE_FIRST)))
        .otherwise(one(u, F.lit(1.0)))
    )
