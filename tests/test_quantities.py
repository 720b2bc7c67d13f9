"""Units: wordings, regions, packages, and the mixture for rows without a unit."""

import random

import pytest
from pyspark.sql import functions as F

from granary.functions.units import is_placeholder, item_and_unit, read_unit
from granary.operators import quantities

REFERENCE = [
    ("kg", None, None, "kg", 1.0), ("g", None, None, "kg", 0.001), ("t", None, None, "kg", 1000.0), ("sac", None, None, "kg", 100.0),
    ("sac", "oignon", None, "kg", 45.0), ("tine", None, None, "kg", 18.0), ("tine", None, "Nord", "kg", 15.0), ("l", None, None, "l", 1.0),
]
STOCK = "stock_id string, farm_id string, item_name string, quantity double, unit string"


def tables(spark, stocks):
    s = spark.createDataFrame(stocks, STOCK).withColumn("region", F.lit("a clashing name")).withColumn("factor", F.lit(9))
    f = spark.createDataFrame([("f1", "z1"), ("f2", "z2"), ("f3", None)], "farm_id string, zone_id string").withColumn("unit", F.lit("x"))
    z = spark.createDataFrame([("z1", "Nord"), ("z2", "Sud")], "zone_id string, region string")
    r = spark.createDataFrame(REFERENCE, "unit_label string, item_name string, region string, base_unit string, factor double")
    return s, f, z, r


@pytest.mark.parametrize("unit, label, times", [
    ("Kg.", "kg", 1), ("SACS", "sac", 1), ("sac(s)", "sac", 1), ("sac de 50 kg", "kg", 50), ("sac_120kg", "kg", 120), ("SAC/5KG", "kg", 5),
    ("50 kg/sac", "kg", 50), ("boîte 25 kg", "kg", 25), ("bidons 10L", "l", 10), ("x100 kg", "kg", 100), ("1000 kg", "kg", 1000),
    ("milliers de kg", "kg", 1000), ("centaines de kg", "kg", 100), ("têtes", "piece", 1), ("Quintaux ", "quintal", 1), ("lot", "lot", 1), ("2,5 kg", "kg", 2.5),
])
def test_wordings(spark, unit, label, times):
    r = spark.createDataFrame([(unit,)], "u string").select(read_unit(F.col("u")).alias("r")).first().r
    assert (r.label, r.times) == (label, times)


def test_item_and_placeholder(spark):
    df = spark.createDataFrame([("urée / quintal",), ("mil, cond. TINES",), ("riz [q]",), ("Maïs (x100 kg)",), ("Arachide - en tonnes",), ("sacs vides",), (None,),
        ("Gombo [sac(s)]",), ("riz / sac(s)",), ("tomate (plat(s))",), ("mil, cond. panier(s)",), ("oignon (sac(s) de 50 kg)",)], "i string")
    item, unit = item_and_unit(F.col("i"))
    got = [tuple(r) for r in df.select(item.alias("a"), unit.alias("b")).collect()]
    assert got == [("urée", "quintal"), ("mil", "TINES"), ("riz", "q"), ("Maïs", "x100 kg"), ("Arachide", "tonnes"), ("sacs vides", None), (None, None),
        ("Gombo", "sac(s)"), ("riz", "sac(s)"), ("tomate", "plat(s)"), ("mil", "panier(s)"), ("oignon", "sac(s) de 50 kg")]
    flags = spark.createDataFrame([("",), ("n/a",), (None,), ("Voir  libellé",), ("kg",)], "u string").select(is_placeholder(F.col("u")).alias("p")).collect()
    assert [r.p for r in flags] == [True, True, True, True, False]


def test_conversion(spark):
    stocks = [
        ("a", "f1", "mil", 2.0, "tine"), ("b", "f2", "mil", 2.0, "tine"), ("c", "f3", "mil", 2.0, "tine"), ("d", "f1", "Oignon", 1.0, "sacs"),
        ("e", "f1", "riz", 1.0, "sac de 50 kg"), ("f", "f1", "riz [T]", 1.5, "-"), ("g", None, "riz", 1.0, "lot"), ("h", "f1", None, 3.0, "kg"),
        ("i", "f1", "riz", None, "kg"), ("j", "f1", "riz", float("nan"), "kg"), ("a", "f1", "mil", 2.0, "tine"), ("k", "f1", "lait", 7.0, "?"),
    ]
    out = quantities.normalise(*tables(spark, stocks))
    assert out.count() == len(stocks)
    got = {r.stock_id: (r.base_unit, r.base_milli, r.basis) for r in out.collect()}
    assert got["a"] == ("kg", 30000, "stated") and got["b"][1] == 36000 and got["c"][1] == 36000
    assert got["d"][1] == 45000 and got["e"][1] == 50000 and got["f"] == ("kg", 1500000, "named")
    assert got["g"][1:] == (None, "unknown") and got["h"][1] == 3000 and got["i"][1] is None and got["j"][1] is None
    assert got["k"][2] == "unknown"  # no stated row of the item to learn from


def test_mixture_assigns_units_by_scale(spark):
    rnd = random.Random(5)
    stocks, truth = [], {}
    for i in range(1500):
        kg = 10 ** rnd.gauss(2.0, 0.15)
        unit, f = rnd.choice((("kg", 1.0), ("g", 0.001), ("t", 1000.0)))
        sid = f"s{i}"
        stocks.append((sid, "f1", "riz", kg / f, unit if i % 3 else None))
        truth[sid] = unit
    out = quantities.normalise(*tables(spark, stocks)).where("basis = 'inferred'").collect()
    assert len(out) == 500
    assert sum(truth[r.stock_id] == r.unit_label for r in out) >= 495
    assert all(not r.uncertain for r in out if r.posterior >= 0.9)


def test_empty(spark):
    assert quantities.normalise(*tables(spark, [])).count() == 0
