"""Agro-meteorology and soil on columns. Rounding is half up; see the README."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: share of rain that reaches the roots, by soil
SOIL_RAIN = {"sandy": 0.5, "clay": 0.7}
# fixed values: mid-season coefficient and greatest bearable temperature of each crop
CROPS = {"maïs": (1.2, 35.0), "mil": (1.0, 42.0), "niébé": (1.0, 36.0)}
# fixed values: water a soil holds at field capacity, in percent
FIELD_CAPACITY = {"sableux": 12.0, "ferrugineux": 22.0, "argileux": 30.0, "limonneux": 25.0}
# fixed values: where weather or satellite readings are missing, unreadable or zero
DEFAULTS = {"t_min": 22.0, "t_max": 32.0, "precip": 0.0, "humidity": 45.0, "wind": 8.0, "ndvi": 0.0, "doy": 180.0, "lat": 12.0}


def default_if_zero(value: Column, default: float) -> Column:
    """A number read from anything; null, unreadable and zero give the default."""
    return F.coalesce(F.nullif(value.try_cast("double"), F.lit(0.0)), F.lit(default))


def hargreaves_et0(t_min: Column, t_max: Column, lat: Column, day: Column) -> Column:
    """Reference evapotranspiration by Hargreaves, in mm a day, two decimals."""
    phi = lat * (math.pi / 180)
    dr = 1 + 0.033 * F.cos(2 * math.pi / 365 * day)
    decl = 0.409 * F.sin(2 * math.pi / 365 * day - 1.39)
    x = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(decl)))
    ws = F.acos(x)
    ra = (24 * 60 / math.pi) * 0.0820 * dr * (ws * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(ws))
    spread = F.sqrt(F.greatest(F.lit(0.0), t_max - t_min))
    return F.round(0.0023 * ((t_max + t_min) / 2 + 17.8) * spread * ra * 0.408, 2)


def delta_t(temp: Column, rh: Column) -> Column:
    """Dry bulb less wet bulb temperature (Stull), one decimal; 0 outside 0..100 % humidity."""
    wet = (
        temp * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(temp + rh) - F.atan(rh - 1.676331)
        + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035
    )
    return F.when(rh.between(0, 100), F.round(temp - wet, 1) + 0.0).otherwise(F.lit(0.0))


def spray_class(delta: Column, rh: Column) -> Column:
    """Conditions for spraying by the difference."""
    return (
        F.when(~rh.between(0, 100), "ERREUR_RH").when(delta.between(2, 8), "OPTIMAL").when(delta > 10, "DANGER_EVAPORATION").otherwise("RISQUE_LESSIVAGE")
    )


def effective_rain(rain: Column, soil: Column) -> Column:
    """Rain that counts for the crop: nothing up to 5 mm, else a share by soil."""
    share = F.lit(0.6)
    for name, v in SOIL_RAIN.items():
        share = F.when(soil == name, v).otherwise(share)
    return F.when(rain > 5, rain * share).otherwise(0.0)


def flood_score(rain_mm: Column, probability: Column, soil: Column) -> Column:
    """0 to 6 by rain, probability of a flood and saturation of the soil."""
    by_rain = F.when(rain_mm >= 30, 2.5).when(rain_mm >= 20, 1.5).when(rain_mm >= 10, 1.0).otherwise(0.0)
    by_probability = F.when(probability >= 0.6, 2.5).when(probability >= 0.4, 1.5).otherwise(0.0)
    return by_rain + by_probability + F.when(soil >= 0.7, 1.0).otherwise(0.0)


def flood_level(score: Column) -> Column:
    return F.when(score >= 4, "CRITIQUE").when(score >= 2.5, "ÉLEVÉ").when(score >= 1.5, "MODÉRÉ").otherwise("FAIBLE")


def rain_risk(mm: Column) -> Column:
    """Risk of ten days' rain; unknown without data."""
    return (
        F.when(mm.isNull(), "UNKNOWN").when(mm < 10, "SECHERESSE").when(mm > 150, "INONDATION").when(mm >= 20, "BONNES_CONDITIONS").otherwise("RAS")
    )


def moisture_status(v: Column) -> Column:
    """Status of soil moisture in m³/m³."""
    return (
        F.when(v.isNull(), "UNKNOWN").when(v > 0.35, "Saturé (Risque d'anoxie)").when(v > 0.20, "Idéal (Humide)").when(v > 0.10, "Modéré").otherwise("Sec")
    )


def texture(sand: Column, clay: Column) -> Column:
    """Soil texture from grams a kilogram."""
    return F.when(sand > 650, "sableux").when(clay > 350, "argileux").when((sand < 400) & (clay < 400), "limonneux").otherwise("ferrugineux")


def ph_class(ph10: Column) -> Column:
    """Class of pH stored as ten times its value."""
    ph = ph10 / 10
    return F.when(ph < 5.5, "Acide").when(ph > 7.8, "Alcalin").otherwise("Équilibré")


def fertility(soc: Column, nitrogen: Column, cec: Column) -> Column:
    """Level by how many of carbon, nitrogen and exchange capacity suffice."""
    points = (soc > 100).cast("int") + (nitrogen > 60).cast("int") + (cec > 100).cast("int")
    return F.element_at(F.array(*map(F.lit, ("Faible", "Moyen", "Bon", "Excellent"))), points + 1)


def irrigation_mm(texture: Column, observation: Column) -> Column:
    """Water to bring 30 cm of soil to field capacity, one decimal."""
    held = F.when(F.lower(observation).contains("sec"), 5.0).otherwise(15.0)
    capacity = F.lit(None).cast("double")
    for name, v in FIELD_CAPACITY.items():
        capacity = F.when(texture == name, v).otherwise(capacity)
    return F.round(F.greatest(F.lit(0.0), (capacity - held) / 100) * 300, 1)


def metrics(raw: dict[str, Column]) -> Column:
    """struct of cleaned readings; ``raw`` has those of DEFAULTS, in any type."""
    r = {k: default_if_zero(raw[k], v) for k, v in DEFAULTS.items()}
    et0 = hargreaves_et0(r["t_min"], r["t_max"], r["lat"], r["doy"].cast("int"))
    avg = (r["t_min"] + r["t_max"]) / 2
    wet = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r["precip"] + r["humidity"] / 10 - et0) / 10))
    return F.struct(
        F.round(r["t_min"], 1).alias("temp_min_c"), F.round(r["t_max"], 1).alias("temp_max_c"), F.round(avg, 1).alias("temp_avg_c"),
        F.round(r["precip"], 1).alias("precip_mm"), F.round(et0, 1).alias("et0_mm"), F.round(wet, 2).alias("soil_moisture_idx"),
        F.round(r["humidity"], 1).alias("humidity_pct"), F.round(r["wind"], 1).alias("wind_speed_kmh"), F.round(r["ndvi"], 2).alias("ndvi_anomaly"),
        ((r["t_max"] >= 38) | (avg >= 32)).alias("heat_stress"),
    )


def hazards(m: Column, flood: Column) -> Column:
    """array of struct(label, severity) of ``metrics``, in the order of the rules; each rule has a label of its own, so none comes twice."""
    rules = (
        ((m["precip_mm"] < 0.1) & (m["et0_mm"] >= 4), "Sécheresse / Harmattan critique", F.when(m["et0_mm"] > 6, "CRITIQUE").otherwise("HAUTE")),
        (flood.isin("ÉLEVÉ", "CRITIQUE"), "Risque d'inondation", flood),
        (m["heat_stress"], "Vague de chaleur extrême", F.lit("ÉLEVÉ")),
        ((m["soil_moisture_idx"] <= 0.2) & (m["precip_mm"] < 5), "Stress hydrique du sol", F.lit("MOYEN")),
        (m["ndvi_anomaly"] <= -0.2, "Stress végétatif détecté", F.lit("ÉLEVÉ")),
        (m["wind_speed_kmh"] >= 35, "Vent fort", F.lit("ÉLEVÉ")),
    )
    return F.array_compact(F.array(*(F.when(when, F.struct(F.lit(label).alias("label"), severity.alias("severity"))) for when, label, severity in rules)))


def simple_alert(record: Column) -> Column:
    """Alert of a day's struct(rainfall_mm, max_temp_c); missing readings give none."""
    return F.when((record["max_temp_c"] > 35) & (record["rainfall_mm"] == 0), "HIGH_HEAT_NO_RAIN").otherwise("NORMAL")
