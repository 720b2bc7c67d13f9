"""Profiles: nested records merged by two rules, lists keyed by a member, fuzzy words."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def merge_lists(old: Column, new: Column, key: str) -> Column:
    """Old items with new ones put over them by a member (without case); new keys follow in order."""
    fold = lambda x: F.lower(x[key].cast("string"))
    kept = F.filter(F.coalesce(old, F.array()), lambda a: ~F.exists(F.coalesce(new, F.array()), lambda b: fold(a) == fold(b)))
    return F.concat(kept, F.coalesce(new, F.array()))


def deep_merge(old: Column, new: Column, fields: list[str], lists: dict[str, str]) -> Column:
    """A struct of both: scalars from the new where it has them, lists merged by key."""
    out = []
    for f in fields:
        v = merge_lists(old[f], new[f], lists[f]) if f in lists else F.coalesce(new[f], old[f])
        out.append(v.alias(f))
    return F.struct(*out)


def shallow_merge(old: Column, new: Column) -> Column:
    """Maps: members of the new replace those of the old."""
    none = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, none), lambda k, v: ~F.map_contains_key(F.coalesce(new, none), k))
    return F.map_concat(kept, F.coalesce(new, none))


def add_without_case(values: Column, extra: Column) -> Column:
    """A list with the extra values it doesn't hold yet, without regard to case; first spellings stay."""
    return F.aggregate(
        F.coalesce(extra, F.array().cast("array<string>")), F.coalesce(values, F.array().cast("array<string>")),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def correct_words(words: list[str], cutoff: float = 0.8):
    """A function on columns: each word of a text replaced by the closest known one, if it is close enough."""
    known = sorted(set(words))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in memo:
                near = difflib.get_close_matches(w.lower(), known, 1, cutoff)
                memo[w] = w if w.lower() in known or not near else near[0]
            return memo[w]

        return texts.map(lambda t: None if t is None else " ".join(one(w) for w in t.split(" ")))

    return run


PLOT = "crop string, status string, area_ha double, soil_type string, planting_date string"


def add_plot(plots: Column, plot: Column) -> Column:
    """``plots`` (array of PLOT) with ``plot`` added, or the active plot of the same crop updated by what the new one states."""
    same = lambda p: (F.lower(p["crop"]) == F.lower(plot["crop"])) & (p["status"] == "ACTIVE")
    first = F.array_position(F.transform(plots, lambda p: F.coalesce(same(p), F.lit(False))), F.lit(True))
    def updated(p, i):
        fields = [F.coalesce(plot[f], p[f]).alias(f) for f in ("area_ha", "soil_type", "planting_date")]
        return F.when(i + 1 == first, F.struct(p["crop"].alias("crop"), p["status"].alias("status"), *fields)).otherwise(p)
    new = F.struct(plot["crop"].alias("crop"), F.lit("ACTIVE").alias("status"), *(plot[f].alias(f) for f in ("area_ha", "soil_type", "planting_date")))
    return F.when(F.coalesce(first, F.lit(0)) > 0, F.transform(plots, updated)).otherwise(F.concat(F.coalesce(plots, F.array().cast(f"array<struct<{_fields(PLOT)}>>")), F.array(new)))


def _fields(schema: str) -> str:
    return ", ".join(f"{n}:{t}" for n, t in (x.split() for x in schema.split(", ")))


def profile_text(zone: Column, commune: Column, plots: Column, livestock: Column, equipment: Column, budget: Column, water: Column, hands: Column) -> Column:
    """One line on a profile: place, active plots, livestock, at most five pieces of equipment, constraints; empty if nothing is known."""
    some = lambda c: F.nullif(c, F.lit(""))
    place = some(F.concat_ws(", ", some(zone), some(commune)))
    active = F.filter(plots, lambda p: p["status"] == "ACTIVE")
    named = F.transform(active, lambda p: F.concat(
        F.when(p["area_ha"] > 0, F.concat(p["area_ha"].cast("string"), F.lit("ha "))).otherwise(""), F.coalesce(p["crop"], F.lit("?")),
        F.coalesce(F.concat(F.lit(" (semé "), some(p["planting_date"]), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" sol:"), some(p["soil_type"])), F.lit(""))))
    animals = F.transform(livestock, lambda a: F.concat(F.coalesce(a["count"].cast("string"), F.lit("?")), F.lit(" "), F.coalesce(a["type"], F.lit("?"))))
    limits = F.array_compact(F.array(
        F.when(budget > 0, F.concat(F.lit("budget "), F.format_number(budget, 0), F.lit(" FCFA"))), F.concat(F.lit("eau: "), some(water)),
        F.when(hands > 0, F.concat(hands.cast("string"), F.lit(" ouvriers")))))
    joined = lambda label, a: F.concat(F.lit(label), some(F.array_join(a, ", ")))
    parts = F.array_compact(F.array(
        F.concat(F.lit("Zone="), place), joined("Parcelles: ", named), joined("Bétail: ", animals), joined("Équipement: ", F.slice(equipment, 1, 5)), joined("Contraintes: ", limits)))
    return F.when(F.size(parts) > 0, F.concat(F.lit("PROFIL AGRICULTEUR: "), F.array_join(parts, ". "), F.lit("."))).otherwise("")


def prune_components(components: Column, caps: dict) -> Column:
    """``components`` (array of struct(type, image_url, actions, items)) that a channel can show: whole ones left out, lists cut.

    ``caps``: charts, images, interactive (truth values), buttons, list_items (counts, 0 for any number). Charts and
    interactive components (action, list_picker, user_approval) go where the channel can't; cards lose images.
    """
    interactive = ("action", "list_picker", "user_approval")
    kept = F.filter(components, lambda c: ~((c["type"] == "chart") & F.lit(not caps["charts"])) & ~(c["type"].isin(*interactive) & F.lit(not caps["interactive"])))
    def shown(c):
        image = F.when((c["type"] == "card") & F.lit(not caps["images"]), F.lit("")).otherwise(c["image_url"])
        actions = F.when(c["type"] == "card", F.slice(c["actions"], 1, caps["buttons"])).otherwise(c["actions"]) if caps["buttons"] else c["actions"]
        items = F.when(c["type"] == "list_picker", F.slice(c["items"], 1, caps["list_items"])).otherwise(c["items"]) if caps["list_items"] else c["items"]
        return F.struct(c["type"].alias("type"), image.alias("image_url"), actions.alias("actions"), items.alias("items"))
    return F.transform(kept, shown)
