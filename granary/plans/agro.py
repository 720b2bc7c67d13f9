"""Agro-meteorology over stand-in columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import agro as A
from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Weather readings made of events: minimum, maximum, humidity, rain, latitude, day of the year."""
    v = F.col("value") * 1.00001  # no reading lies on a tie of rounding
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", (v % 12 + 14).alias("t_min"), (v % 15 + 27).alias("t_max"), (v % 100).alias("rh"),
        (v % 130).alias("rain"), (F.lit(9.0) + F.col("user_id") % 6).alias("lat"), F.dayofyear("ts").alias("doy"), F.month("ts").alias("month"),
        ((F.col("user_id") % 10) / 10).alias("flood_prob"), (F.floor(v) % 10 / 10).alias("soil"), (v % 60).alias("wind"), (-(F.floor(v) % 5) / 10).alias("ndvi"),
        F.when(F.col("user_id") % 5 == 0, "0").when(F.col("user_id") % 5 == 1, "n/a").otherwise((v % 12 + 14).cast("string")).alias("t_min_text"),
    )


R = """(select event_id, ts, user_id, value % 12 + 14 as t_min, value % 15 + 27 as t_max, value % 100 as rh, value % 130 as rain,
 9.0::double + user_id % 6 as lat, dayofyear(ts) as doy, month(ts) as month, (user_id % 10) / 10 as flood_prob, cast(floor(value) as bigint) % 10 / 10 as soil,
 value % 60 as wind, -(cast(floor(value) as bigint) % 5) / 10 as ndvi,
 case user_id % 5 when 0 then 22.0::double when 1 then 22.0::double else value % 12 + 14 end as t_min_clean from (select * replace (value * 1.00001 as value) from events))"""
# reference evapotranspiration in SQL
ET0 = """round(0.0023::double * (({tmin} + t_max) / 2 + 17.8) * sqrt(greatest(0.0::double, t_max - {tmin})) * ((24 * 60 / pi()) * 0.0820::double * (1 + 0.033 * cos(2 * pi() / 365 * doy))
 * (acos(greatest(-1.0::double, least(1.0::double, -tan(lat * pi() / 180) * tan(0.409 * sin(2 * pi() / 365 * doy - 1.39))))) * sin(lat * pi() / 180) * sin(0.409 * sin(2 * pi() / 365 * doy - 1.39))
 + cos(lat * pi() / 180) * cos(0.409 * sin(2 * pi() / 365 * doy - 1.39)) * sin(acos(greatest(-1.0::double, least(1.0::double, -tan(lat * pi() / 180)
 * tan(0.409 * sin(2 * pi() / 365 * doy - 1.39)))))))) * 0.408::double, 2)"""
M = f"""(select *, round(t_min_clean, 1) as temp_min_c, round(t_max, 1) as temp_max_c, round((t_min_clean + t_max) / 2, 1) as temp_avg_c, round(rain, 1) as precip_mm, round(et0, 1) as et0_mm,
 round(greatest(0.0::double, least(1.0::double, (rain + case when rh = 0 then 45 else rh end / 10 - et0) / 10)), 2) as soil_moisture_idx,
 round(case when rh = 0 then 45 else rh end, 1) as humidity_pct, round(case when wind = 0 then 8 else wind end, 1) as wind_speed_kmh, round(ndvi, 2) as ndvi_anomaly,
 t_max >= 38 or (t_min_clean + t_max) / 2 >= 32 as heat_stress from (select *, {ET0.format(tmin="t_min_clean")} as et0 from {R}))"""
FLOOD = """(case when rain >= 30 then 2.5 when rain >= 20 then 1.5 when rain >= 10 then 1.0 else 0.0 end + case when flood_prob >= 0.6 then 2.5 when flood_prob >= 0.4 then 1.5 else 0.0 end
 + case when soil >= 0.7 then 1.0 else 0.0 end)"""
LEVEL = "case when {0} >= 4 then 'CRITIQUE' when {0} >= 2.5 then 'ÉLEVÉ' when {0} >= 1.5 then 'MODÉRÉ' else 'FAIBLE' end"


@C.query(f"""
with x as (select *, lat * pi() / 180 as phi, 1 + 0.033 * cos(2 * pi() / 365 * doy) as dr, 0.409 * sin(2 * pi() / 365 * doy - 1.39) as decl from {R}),
y as (select *, acos(greatest(-1.0::double, least(1.0::double, -tan(phi) * tan(decl)))) as ws from x)
select event_id, round(0.0023::double * ((t_max + t_min) / 2 + 17.8) * sqrt(greatest(0.0::double, t_max - t_min))
 * ((24 * 60 / pi()) * 0.0820::double * dr * (ws * sin(phi) * sin(decl) + cos(phi) * cos(decl) * sin(ws))) * 0.408::double, 2) as et0 from y""")
def et0_hargreaves(spark: SparkSession, d: str) -> DataFrame:
    """Reference evapotranspiration of each reading."""
    return readings(spark, d).select("event_id", A.hargreaves_et0(F.col("t_min"), F.col("t_max"), F.col("lat"), F.col("doy")).alias("et0"))


@C.query(f"""
with x as (select event_id, rh, round(t_max - (t_max * atan(0.151977 * sqrt(rh + 8.313659)) + atan(t_max + rh) - atan(rh - 1.676331)
 + 0.00391838 * power(rh, 1.5) * atan(0.023101 * rh) - 4.686035), 1) + 0.0 as delta_t from {R})
select event_id, delta_t, case when delta_t between 2 and 8 then 'OPTIMAL' when delta_t > 10 then 'DANGER_EVAPORATION' else 'RISQUE_LESSIVAGE' end as spraying from x""")
def delta_t(spark: SparkSession, d: str) -> DataFrame:
    """Wet-bulb difference and what it means for spraying."""
    r = readings(spark, d).withColumn("delta_t", A.delta_t(F.col("t_max"), F.col("rh")))
    return r.select("event_id", "delta_t", A.spray_class(F.col("delta_t"), F.col("rh")).alias("spraying"))


@C.query(f"""
select event_id, round(case when rain > 5 then rain * case user_id % 3 when 0 then 0.5 when 1 then 0.7 else 0.6 end else 0 end, 3) as effective from {R}""")
def effective_rain(spark: SparkSession, d: str) -> DataFrame:
    """Rain that counts for the crop by soil."""
    soil = F.element_at(F.array(F.lit("sandy"), F.lit("clay"), F.lit("standard")), (F.col("user_id") % 3 + 1).cast("int"))
    return readings(spark, d).select("event_id", F.round(A.effective_rain(F.col("rain"), soil), 3).alias("effective"))


@C.query(f"""select event_id, cast({FLOOD} as double) as score, {LEVEL.format(FLOOD)} as level from {R}""")
def flood_score(spark: SparkSession, d: str) -> DataFrame:
    """Flood score and level."""
    r = readings(spark, d).withColumn("score", A.flood_score(F.col("rain"), F.col("flood_prob"), F.col("soil")))
    return r.select("event_id", "score", A.flood_level(F.col("score")).alias("level"))


def with_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Readings with the struct m of cleaned metrics."""
    raw = {"t_min": "t_min_text", "t_max": "t_max", "precip": "rain", "humidity": "rh", "wind": "wind", "ndvi": "ndvi", "doy": "doy", "lat": "lat"}
    # a row of its own for the metrics, so that they are computed once however many rules read them
    return readings(spark, d).withColumn("m", F.explode(F.array(A.metrics({k: F.col(v) for k, v in raw.items()}))))


@C.query(f"""select event_id, temp_min_c, temp_max_c, temp_avg_c, precip_mm, et0_mm, soil_moisture_idx, humidity_pct, wind_speed_kmh, ndvi_anomaly, heat_stress from {M}""")
def weather_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metric pack of each reading, with defaults for what is missing, unreadable or zero."""
    return with_metrics(spark, d).select("event_id", "m.*")


@C.query(f"""
with f as (select *, {LEVEL.format(FLOOD)} as flood from {M})
select event_id, 1 as ordinal, 'Sécheresse / Harmattan critique' as label, case when et0_mm > 6 then 'CRITIQUE' else 'HAUTE' end as severity from f where precip_mm < 0.1 and et0_mm >= 4
union all select event_id, 2, 'Risque d''inondation', flood from f where flood in ('ÉLEVÉ', 'CRITIQUE')
union all select event_id, 3, 'Vague de chaleur extrême', 'ÉLEVÉ' from f where heat_stress
union all select event_id, 4, 'Stress hydrique du sol', 'MOYEN' from f where soil_moisture_idx <= 0.2 and precip_mm < 5
union all select event_id, 5, 'Stress végétatif détecté', 'ÉLEVÉ' from f where ndvi_anomaly <= -0.2
union all select event_id, 6, 'Vent fort', 'ÉLEVÉ' from f where wind_speed_kmh >= 35""".replace("select event_id, 1 as ordinal", "select event_id, rank() over (partition by event_id order by o) - 1 as pos, label, severity from (select event_id, 1 as o", 1) + ") x")
def hazards_exploded(spark: SparkSession, d: str) -> DataFrame:
    """The hazards of each reading in the order of the rules; pos counts from 0."""
    flood = A.flood_level(A.flood_score(F.col("rain"), F.col("flood_prob"), F.col("soil")))
    x = with_metrics(spark, d).select("event_id", F.posexplode(A.hazards(F.col("m"), flood)).alias("pos", "h"))
    return x.select("event_id", "pos", "h.label", "h.severity")


@C.query(f"""
with c(crop, kc, bearable) as (values ('maïs', 1.2::double, 35), ('mil', 1.0::double, 42), ('niébé', 1.0::double, 36)),
x as (select *, case user_id % 4 when 0 then 'maïs' when 1 then 'mil' when 2 then 'niébé' else 'igname' end as crop, user_id % 30 as distance, {ET0.format(tmin="t_min")} as et0 from {R}),
y as (select x.*, c.kc, c.bearable, et0 * kc as etc, case when rain > 5 then round(rain * case user_id % 3 when 0 then 0.5::double when 1 then 0.7::double else 0.6::double end, 2) else 0.0::double end as pe from x left join c using (crop))
select event_id, crop, round(etc, 4) as etc, cast(round(cast(pe - etc as decimal(18, 6)), 2) as double) as balance,
 case when kc is null then 'Culture non reconnue' when round(cast(pe - etc as decimal(18, 6)), 2) < -3 then 'NECESSAIRE' else 'SURVEILLANCE' end as irrigation, t_max > bearable as heat,
 case when distance < 10 then 'Confiance élevée' when distance < 20 then 'Confiance moyenne' else 'Confiance faible (Station éloignée)' end as confidence, distance >= 20 as ground_check from y""")
def daily_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Water balance of a crop on a day, its irrigation, heat and how far the station can be trusted."""
    u = F.col("user_id")
    crop = F.element_at(F.array(*map(F.lit, ("maïs", "mil", "niébé", "igname"))), (u % 4 + 1).cast("int"))
    soil = F.element_at(F.array(F.lit("sandy"), F.lit("clay"), F.lit("standard")), (u % 3 + 1).cast("int"))
    kc, bearable = (F.try_element_at(F.create_map(*(x for k, v in A.CROPS.items() for x in (F.lit(k), F.lit(v[i])))), F.lower("crop")) for i in (0, 1))
    x = readings(spark, d).withColumns({"crop": crop, "distance": u % 30}).withColumns({"kc": kc, "bearable": bearable})
    x = x.withColumn("etc", A.hargreaves_et0(F.col("t_min"), F.col("t_max"), F.col("lat"), F.col("doy")) * F.col("kc"))
    x = x.withColumn("balance", F.round((F.round(A.effective_rain(F.col("rain"), soil), 2) - F.col("etc")).cast("decimal(18,6)"), 2).cast("double"))
    return x.select(
        "event_id", "crop", F.round("etc", 4).alias("etc"), "balance",
        F.when(F.col("kc").isNull(), "Culture non reconnue").when(F.col("balance") < -3, "NECESSAIRE").otherwise("SURVEILLANCE").alias("irrigation"),
        (F.col("t_max") > F.col("bearable")).alias("heat"),
        F.when(F.col("distance") < 10, "Confiance élevée").when(F.col("distance") < 20, "Confiance moyenne").otherwise("Confiance faible (Station éloignée)").alias("confidence"),
        (F.col("distance") >= 20).alias("ground_check"))


@C.query("""
select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) filter (value % 15 + 27 > 35 and floor(value) % 3 = 0) as hot_and_dry, count(*) as readings from events group by 1, 2""")
def archive_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Daily series as parallel arrays, one record for each reading, and the alert of each by a function that is a parameter."""
    v = F.col("value")
    series = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.collect_list(F.struct((F.floor(v) % 3).cast("double").alias("rainfall_mm"), (v % 15 + 27).alias("max_temp_c"))).alias("r"))  # one place's day
    records = daily_records(series.select("user_id", "day", F.col("r.rainfall_mm").alias("rain_sum"), F.col("r.max_temp_c").alias("temperature_2m_max")))
    return records.groupBy("user_id", "day").agg(F.count_if(F.col("alert") == "HIGH_HEAT_NO_RAIN").alias("hot_and_dry"), F.count("*").alias("readings"))


def daily_records(series: DataFrame, alert=A.simple_alert) -> DataFrame:
    """One row for each place of the arrays rain_sum and temperature_2m_max, with ``alert`` of its struct(rainfall_mm, max_temp_c)."""
    rows = series.withColumn("x", F.explode(F.arrays_zip("rain_sum", "temperature_2m_max")))
    record = F.struct(F.col("x.rain_sum").alias("rainfall_mm"), F.col("x.temperature_2m_max").alias("max_temp_c"))
    return rows.select(*[c for c in series.columns if c not in ("rain_sum", "temperature_2m_max")], record.alias("record")).select(
        "*", alert(F.col("record")).alias("alert"))


@C.query("""
with o(ordinal, dx, dy) as (values (0, 0, 0), (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)),
g as (select cast(floor(latitude * 10) as bigint) as x, cast(floor(longitude * 10) as bigint) as y, round(avg(size_ha), 6) as mean from farms where size_ha is not null group by 1, 2),
f as (select z.zone_id, o.ordinal, g.mean from zones z cross join o left join g on g.x = cast(floor(z.lat * 10) as bigint) + o.dx and g.y = cast(floor(z.lon * 10) as bigint) + o.dy)
select zone_id, min_by(mean, ordinal) filter (mean is not null) as mean, min(ordinal) filter (mean is not null) as tries,
 max(mean) filter (ordinal = 0) as at_point from f group by 1""")
def point_with_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The value of a grid at a point, else at the first of four neighbours that has one; at_point is the plain lookup."""
    cell = lambda c: F.floor(F.col(c) * 10)
    grid = table(spark, d, "farms").where("size_ha is not null").groupBy(cell("latitude").alias("x"), cell("longitude").alias("y")).agg(F.round(F.avg("size_ha"), 6).alias("mean"))
    offsets = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for i, (a, b) in enumerate(((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))))
    at = table(spark, d, "zones").select("zone_id", "lat", "lon", F.inline(offsets)).select("zone_id", "ordinal", (cell("lat") + F.col("dx")).alias("x"), (cell("lon") + F.col("dy")).alias("y"))
    found = at.join(grid, ["x", "y"], "left")
    has = F.col("mean").isNotNull()
    return found.groupBy("zone_id").agg(
        F.min_by("mean", F.when(has, F.col("ordinal"))).alias("mean"), F.min(F.when(has, F.col("ordinal"))).alias("tries"), F.max(F.when(F.col("ordinal") == 0, F.col("mean"))).alias("at_point"))


@C.query(f"""
select event_id, 'heat' as hazard, 1 as ordinal from {R} where t_max > 40 union all
select event_id, 'heavy_rain', 2 from {R} where rain > 100 union all select event_id, 'dry', 3 from {R} where rain < 10""")
def watcher_alerts(spark: SparkSession, d: str) -> DataFrame:
    """None to three alerts per reading, in one pass."""
    found = F.array_compact(F.array(
        F.when(F.col("t_max") > 40, F.struct(F.lit("heat").alias("hazard"), F.lit(1).alias("ordinal"))),
        F.when(F.col("rain") > 100, F.struct(F.lit("heavy_rain").alias("hazard"), F.lit(2).alias("ordinal"))),
        F.when(F.col("rain") < 10, F.struct(F.lit("dry").alias("hazard"), F.lit(3).alias("ordinal")))))
    return readings(spark, d).select("event_id", F.inline(found))


@C.query(f"""
select user_id, cast(floor((doy - 1) / 10) as bigint) as decade, round(sum(rain), 3) as mm,
 case when sum(rain) < 10 then 'SECHERESSE' when sum(rain) > 150 then 'INONDATION' when sum(rain) >= 20 then 'BONNES_CONDITIONS' else 'RAS' end as risk from {R} group by 1, 2""")
def rain_risk_10d(spark: SparkSession, d: str) -> DataFrame:
    """Ten days' rain per place and its risk."""
    r = readings(spark, d).groupBy("user_id", F.floor((F.col("doy") - 1) / 10).alias("decade")).agg(F.sum("rain").alias("sum"))
    return r.select("user_id", "decade", F.round("sum", 3).alias("mm"), A.rain_risk(F.col("sum")).alias("risk"))


@C.query("""
with p as (select p_partkey, cast(floor(p_retailprice) as bigint) % 1000 as sand, p_size * 10 as clay, p_size + 40 as ph10, p_size * 4 as soc, p_size * 2 as nitro, p_size * 5 as cec, p_type from part),
t as (select *, case when sand > 650 then 'sableux' when clay > 350 then 'argileux' when sand < 400 and clay < 400 then 'limonneux' else 'ferrugineux' end as texture from p)
select p_partkey, texture, case when ph10 / 10.0 < 5.5 then 'Acide' when ph10 / 10.0 > 7.8 then 'Alcalin' else 'Équilibré' end as ph,
 ['Faible', 'Moyen', 'Bon', 'Excellent'][1 + (soc > 100)::int + (nitro > 60)::int + (cec > 100)::int] as fertility,
 case when cec > 150 then 'Élevé (Réservoir)' else 'Faible (Passoire)' end as storage,
 case when (soc > 100)::int + (nitro > 60)::int + (cec > 100)::int < 2 then 'Besoin urgent de fumure organique.' else 'Maintenir le taux de carbone.' end as advice,
 round(greatest(0.0::double, (case texture when 'sableux' then 12 when 'argileux' then 30 when 'limonneux' then 25 else 22 end - case when p_type = 'ECONOMY' then 5.0::double else 15.0::double end) / 100) * 300, 1) as irrigation_mm
from t""")
def soil_texture_class(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis of a soil: texture, pH, fertility, storage of nutrients, water needed."""
    size = F.col("p_size")
    x = table(spark, d, "part").withColumn("texture", A.texture(F.col("p_retailprice").cast("bigint") % 1000, size * 10))
    level = A.fertility(size * 4, size * 2, size * 5)
    return x.select(
        "p_partkey", "texture", A.ph_class(size + 40).alias("ph"), level.alias("fertility"),
        F.when(size * 5 > 150, "Élevé (Réservoir)").otherwise("Faible (Passoire)").alias("storage"),
        F.when(level.isin("Faible", "Moyen"), "Besoin urgent de fumure organique.").otherwise("Maintenir le taux de carbone.").alias("advice"),
        A.irrigation_mm(F.col("texture"), F.when(F.col("p_type") == "ECONOMY", "sol sec").otherwise("humide")).alias("irrigation_mm"))


@C.query("""
with s as (select user_id, max_by(value, (ts, event_id)) / 500 as v from events group by 1)
select user_id, round(v, 6) as v, case when v > 0.35 then 'Saturé (Risque d''anoxie)' when v > 0.20 then 'Idéal (Humide)' when v > 0.10 then 'Modéré' else 'Sec' end as status from s""")
def moisture_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest soil moisture of each place and its status."""
    s = table(spark, d, "events").groupBy("user_id").agg((F.max_by("value", F.struct("ts", "event_id")) / 500).alias("v"))
    return s.select("user_id", F.round("v", 6).alias("v"), A.moisture_status(F.col("v")).alias("status"))


@C.query("""
with k(crop, word, points) as (values ('mais', 'chenilles', 1), ('mais', 'jaunissement', 2), ('coton', 'chenilles', 2), ('coton', 'floraison', 1), ('riz', 'eaux', 1)),
s as (select doc_id, crop, sum(points) as score from documents join k using (crop) where contains(lower(text), word) group by 1, 2)
select doc_id, crop, score from s""".replace("join k using (crop)", "d join (select crop as kcrop, word, points from k) on kcrop = lower(strip_accents(d.crop))"))
def symptom_scores(spark: SparkSession, d: str) -> DataFrame:
    """Points of the symptoms named in a text for its crop."""
    from granary.functions.text import fold

    k = spark.createDataFrame(
        [("mais", "chenilles", 1), ("mais", "jaunissement", 2), ("coton", "chenilles", 2), ("coton", "floraison", 1), ("riz", "eaux", 1)],
        "kcrop string, word string, points int")
    x = table(spark, d, "documents").select("doc_id", "crop", "text").join(F.broadcast(k), fold(F.col("crop")) == F.col("kcrop"))  # five rows
    return x.where(F.contains(F.lower("text"), F.col("word"))).groupBy("doc_id", "crop").agg(F.sum("points").alias("score"))


@C.query("""
with w as (select zone_id, date_diff('day', date '2024-01-01', date '2024-01-01') as x, lat, lon from zones)
select zone_id, case when lat between 9.4 and 15.1 and lon between -5.6 and 2.5 then 'inside' else 'outside' end as place, round(lat, 1) as lat1 from w""")
def zone_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Zones inside a bounding box."""
    inside = F.col("lat").between(9.4, 15.1) & F.col("lon").between(-5.6, 2.5)
    return table(spark, d, "zones").select("zone_id", F.when(inside, "inside").otherwise("outside").alias("place"), F.round("lat", 1).alias("lat1"))
