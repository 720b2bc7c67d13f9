"""Quantities in different units to common base units (problem 5).

The unit is the one typed, or where that is empty or a placeholder the one
written after the item's name. A stated package size or multiple goes before the
reference table; of the table's rows one that holds for the item or the region
goes before the general one.

Where no unit is stated, a log-scale mixture assigns one. The amounts of an item
in one base unit are taken as log-normal; a quantity q recorded in unit u with
factor f has log10 q = log10 amount - log10 f, so that the components of the
mixture are offset by known constants and share centre and width. Expectation
maximisation starts from the item's stated amounts and unit frequencies. It runs
on a histogram of log10 q (bins of BIN) for each item: rows are counted by bin
with map-side combine, so its input is bounded by items times bins, however many
rows an item has. A row gets the unit of the greatest posterior and is flagged
uncertain below ``sure``.

basis: ``stated`` (unit field), ``named`` (item's name), ``inferred`` (mixture),
``unknown`` (a unit that neither table nor wording explains, no quantity, or an
item without stated rows). Null quantities, NaN and units without a factor have
null amounts. Rows come out as they come in, repeated ones too.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.text import fold
from granary.functions.units import is_placeholder, item_and_unit, read_unit
from granary.operators.relational import lookup
from granary.plans.staging import bounded_broadcast, stage

BIN = 0.02
WORDINGS = 500_000


def regions_of(farms: DataFrame, zones: DataFrame, regions: DataFrame) -> DataFrame:
    """(farm, farm_region) of each farm in one of ``regions(region)``; of a farm given twice the least region."""
    where = farms.where("farm_id is not null").join(zones.select("zone_id", F.col("region").alias("farm_region")), "zone_id")
    where = where.groupBy(F.col("farm_id").alias("farm")).agg(F.min("farm_region").alias("farm_region"))
    return where.join(F.broadcast(regions), F.col("farm_region") == F.col("region"), "left_semi")  # the reference's few regions


def wordings(stocks: DataFrame, reference: DataFrame) -> DataFrame:
    """What each distinct wording says, read once: (wording, _item, _empty, _label, _base, _factor, _regional).

    The amount is that of the reference's row for the item or its general row;
    _regional is the label if a row of the reference for a region goes before.
    ``reference`` is a parameter table of a few rows.
    """
    w = stocks.select("wording", "item_name", "unit").distinct()
    name, in_name = item_and_unit(F.col("item_name"))
    empty = is_placeholder(F.col("unit"))
    w = w.select("wording", fold(name).alias("_item"), empty.alias("_empty"), F.when(empty, in_name).otherwise(F.col("unit")).alias("_text"))
    # tables of their own keep the reading out of the rows' code
    w = stage(w, "p5-texts").withColumn("_read", read_unit(F.col("_text")))
    w = w.select("wording", "_item", "_empty", F.when(F.col("_text").isNotNull(), F.col("_read.label")).alias("_label"), F.col("_read.times").alias("_times"))
    ref = F.broadcast(reference.select(
        fold(F.col("unit_label")).alias("r_label"), fold(F.col("item_name")).alias("r_item"), "region", "base_unit", "factor"
    ))
    general, items = ref.where("r_item is null and region is null"), ref.where("r_item is not null and region is null")
    regional = ref.where("region is not null and r_item is null").select("r_label").distinct()
    label = F.col("_label")
    w = (
        w.join(general.select("r_label", F.col("base_unit").alias("g_base"), F.col("factor").alias("g_factor")), label == F.col("r_label"), "left").drop("r_label")
        .join(items.select("r_label", "r_item", F.col("base_unit").alias("i_base"), F.col("factor").alias("i_factor")),
              (label == F.col("r_label")) & (F.col("_item") == F.col("r_item")), "left").drop("r_label", "r_item")
        .join(regional.select(F.col("r_label").alias("g_label")), label == F.col("g_label"), "left")
    )
    w = w.select(
        "wording", "_item", "_empty", "_label", "_times", F.coalesce("i_base", "g_base").alias("_base"),
        (F.coalesce("i_factor", "g_factor") * F.col("_times")).alias("_factor"), F.when(F.col("i_factor").isNull(), F.col("g_label")).alias("_regional"),
    )
    return stage(w, "p5-wordings")


def convert(stocks: DataFrame, farms: DataFrame, zones: DataFrame, reference: DataFrame) -> DataFrame:
    """``stocks`` with _item, unit_label, base_unit, factor and basis ``stated``, ``named``, ``missing`` or ``unknown``.

    ``reference(unit_label, item_name, region, base_unit, factor)`` is a small
    table. Only rows whose unit differs by region look up their farm.
    """
    wording = F.concat_ws("\u0001", F.coalesce("item_name", F.lit("\u0000")), F.coalesce("unit", F.lit("\u0000")))
    s = stocks.select("stock_id", "farm_id", "item_name", "quantity", "unit", wording.alias("wording"))
    w = wordings(s, reference).withColumnRenamed("wording", "w_wording")
    s = lookup(s, w, "wording", "w_wording", WORDINGS).drop("wording", "w_wording")
    ref = reference.where("region is not null and item_name is null").select(
        fold(F.col("unit_label")).alias("g_label"), F.col("region").alias("g_region"), F.col("base_unit").alias("g_base"), F.col("factor").alias("g_factor"))
    where = stage(regions_of(farms, zones, ref.select(F.col("g_region").alias("region")).distinct()), "p5-farms")
    s = lookup(s.withColumn("_farm", F.when(F.col("_regional").isNotNull(), F.col("farm_id"))), where, "_farm", "farm")
    s = s.join(F.broadcast(ref), (F.col("_regional") == F.col("g_label")) & (F.col("farm_region") == F.col("g_region")), "left")  # a few rows
    factor = F.coalesce(F.col("g_factor") * F.col("_times"), F.col("_factor"))
    label = F.col("_label")
    basis = (
        F.when(label.isNull(), "missing").when(factor.isNull(), "unknown").when(F.col("_empty"), "named").otherwise("stated")
    )
    return s.select(
        "stock_id", "item_name", "quantity", "unit", "_item", label.alias("unit_label"),
        F.coalesce("g_base", "_base").alias("base_unit"), factor.alias("factor"), basis.alias("basis"),
    )


def milli(quantity, factor):
    """Thousandths of the base unit, rounded half up on the decimal figures."""
    q = F.round(F.nanvl(quantity, F.lit(None).cast("double")).cast("decimal(20,6)") * factor.cast("decimal(18,9)") * 1000, 0)
    return q.cast("bigint")


def known(stocks: DataFrame, farms: DataFrame, zones: DataFrame, reference: DataFrame) -> DataFrame:
    """(stock_id, base_unit, base_milli) of each stock whose quantity and unit are stated or named; the mixture has no part."""
    c = convert(stocks, farms, zones, reference).where("basis in ('stated', 'named')")
    c = c.select("stock_id", "base_unit", milli(F.col("quantity"), F.col("factor")).alias("base_milli"))
    return c.where("base_milli is not null").distinct()


def _fit(g: pd.DataFrame) -> pd.DataFrame:
    """Posterior of each candidate unit for each bin of one item and its most probable unit."""
    units = g[g["kind"] == 0].sort_values("unit_label")
    bins = g[g["kind"] == 1].sort_values("bin")
    if units.empty or bins.empty:
        kinds = {"item": object, "bin": "int32", "unit_label": object, "base_unit": object, "factor": float, "posterior": float}
        return pd.DataFrame({k: pd.Series(dtype=t) for k, t in kinds.items()})
    n = units["n"].to_numpy(float)
    mean = float((units["s1"].sum()) / n.sum())
    var = max(float(units["s2"].sum() / n.sum() - mean**2), 0.01)
    weight = n / n.sum()
    shift = np.log10(units["factor"].to_numpy(float))
    x = bins["bin"].to_numpy(float)[:, None] * BIN + shift[None, :]
    count = bins["n"].to_numpy(float)[:, None]
    base_n, base_mean, base_sq = n.sum(), mean, var + mean**2
    for _ in range(50):
        log = np.log(weight + 1e-12) - (x - mean) ** 2 / (2 * var) - 0.5 * math.log(var)
        log -= log.max(axis=1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(axis=1, keepdims=True)
        soft = post * count
        total = base_n + soft.sum()
        new_mean = (base_n * base_mean + (soft * x).sum()) / total
        new_var = max((base_n * base_sq + (soft * x**2).sum()) / total - new_mean**2, 0.01)
        weight = (n + soft.sum(axis=0)) / total
        done = abs(new_mean - mean) < 1e-6 and abs(new_var - var) < 1e-6
        mean, var = new_mean, new_var
        if done:
            break
    best = post.argmax(axis=1)
    return pd.DataFrame({
        "item": [g["item"].iloc[0]] * len(best), "bin": bins["bin"].to_numpy(), "unit_label": list(units["unit_label"].to_numpy(object)[best]),
        "base_unit": list(units["base_unit"].to_numpy(object)[best]), "factor": units["factor"].to_numpy(float)[best],
        "posterior": post[np.arange(len(best)), best],
    })


def infer_units(converted: DataFrame) -> DataFrame:
    """(item, bin, unit_label, base_unit, factor, posterior) for items with rows without a unit.

    The candidates of an item are the units stated for it, each with its most frequent factor.
    """
    log_q = F.log10("quantity")
    known = converted.where("basis in ('stated', 'named') and quantity > 0 and factor > 0 and _item is not null")
    amount = F.log10(F.col("quantity") * F.col("factor"))
    units = known.groupBy(F.col("_item").alias("item"), "unit_label", "base_unit", "factor").agg(
        F.count("*").alias("n"), F.sum(amount).alias("s1"), F.sum(amount * amount).alias("s2")
    )
    units = units.groupBy("item", "unit_label", "base_unit").agg(
        F.sum("n").alias("n"), F.max_by("factor", F.struct("n", -F.col("factor"))).alias("factor"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")
    )
    # mixtures of one base unit are comparable; the item's most stated base unit is its own
    base = units.groupBy("item", "base_unit").agg(F.sum("n").alias("bn")).groupBy("item").agg(
        F.max_by("base_unit", F.struct("bn", "base_unit")).alias("base_unit")
    )
    units = units.join(base, ["item", "base_unit"], "left_semi")
    bins = converted.where("basis = 'missing' and quantity > 0 and _item is not null").groupBy(
        F.col("_item").alias("item"), F.floor(log_q / BIN + 0.5).cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))
    both = units.select(
        "item", F.lit(0).alias("kind"), F.lit(0).alias("bin"), "unit_label", "base_unit", "n", "factor", "s1", "s2"
    ).unionByName(bins.select("item", F.lit(1).alias("kind"), "bin", "n"), allowMissingColumns=True)
    return both.groupBy("item").applyInPandas(
        _fit, "item string, bin int, unit_label string, base_unit string, factor double, posterior double"
    )


def normalise(
    stocks: DataFrame, farms: DataFrame, zones: DataFrame, reference: DataFrame, sure: float = 0.9
) -> DataFrame:
    """(stock_id, item, quantity, unit, unit_label, base_unit, base_milli, basis, posterior, uncertain) of every row."""
    c = stage(convert(stocks, farms, zones, reference), "p5-converted")
    guess = infer_units(c).select(
        F.col("item").alias("m_item"), F.col("bin").alias("m_bin"), F.col("unit_label").alias("m_label"),
        F.col("base_unit").alias("m_base"), F.col("factor").alias("m_factor"), "posterior",
    )
    is_gap = (F.col("basis") == "missing") & (F.col("quantity") > 0)
    at = F.when(is_gap, F.floor(F.log10("quantity") / BIN + 0.5).cast("int"))
    guess = bounded_broadcast(stage(guess, "p5-guesses"), 1_000_000)
    c = c.withColumn("_bin", at).join(guess, (F.col("_item") == F.col("m_item")) & (F.col("_bin") == F.col("m_bin")), "left")
    inferred = (F.col("basis") == "missing") & F.col("m_factor").isNotNull()
    basis = F.when(inferred, "inferred").when(F.col("basis") == "missing", "unknown").otherwise(F.col("basis"))
    amount = milli(F.col("quantity"), F.when(inferred, F.col("m_factor")).otherwise(F.col("factor")))
    return c.select(
        "stock_id", F.col("_item").alias("item"), "quantity", "unit",
        F.when(inferred, F.col("m_label")).otherwise(F.col("unit_label")).alias("unit_label"),
        F.when(inferred, F.col("m_base")).otherwise(F.col("base_unit")).alias("base_unit"),
        amount.alias("base_milli"), basis.alias("basis"), F.when(inferred, F.col("posterior")).alias("posterior"),
        (inferred & (F.col("posterior") < sure)).alias("uncertain"),
    )


def calibration(
    stocks: DataFrame, farms: DataFrame, zones: DataFrame, reference: DataFrame, sure: float = 0.9, one_in: int = 10
) -> DataFrame:
    """(uncertain, n, right): how often the mixture is right about stated units that were hidden from it, one in ``one_in``.

    ``right`` counts rows whose inferred amount is the stated one.
    """
    c = stage(convert(stocks, farms, zones, reference).dropDuplicates(["stock_id"]).where("basis in ('stated', 'named') and quantity > 0"), "p5-truth")
    hide = F.pmod(F.xxhash64("stock_id"), F.lit(one_in)) == 0
    shown = c.withColumn("basis", F.when(hide, "missing").otherwise(F.col("basis")))
    guess = stage(infer_units(shown), "p5-hidden").select(
        F.col("item").alias("m_item"), F.col("bin").alias("m_bin"), F.col("base_unit").alias("m_base"), F.col("factor").alias("m_factor"), "posterior")
    x = c.where(hide).withColumn("_bin", F.floor(F.log10("quantity") / BIN + 0.5).cast("int"))
    x = x.join(guess, (F.col("_item") == F.col("m_item")) & (F.col("_bin") == F.col("m_bin")))
    right = (F.col("base_unit") == F.col("m_base")) & (F.abs(F.col("factor") / F.col("m_factor") - 1) < 1e-6)
    return x.groupBy((F.col("posterior") < sure).alias("uncertain")).agg(F.count("*").alias("n"), F.count_if(right).alias("right"))
