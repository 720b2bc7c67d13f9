"""Validation, mapping, set, date and graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import graph, profiles, textops
from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()


@C.query("""
with recursive e as (select 1000 + n_regionkey as src, n_nationkey as dst from nation union select n_nationkey, 1000 + (n_nationkey + 1) % 5 from nation),
w(node, depth) as (select 1000, 0 union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 4)
select node, min(depth) as depth from w group by 1""")
def link_bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """Depth of each node reached in a cyclic link graph."""
    n = table(spark, d, "nation")
    edges = n.select((F.lit(1000) + F.col("n_regionkey")).alias("src"), F.col("n_nationkey").alias("dst")).unionByName(
        n.select(F.col("n_nationkey").alias("src"), (F.lit(1000) + (F.col("n_nationkey") + 1) % 5).alias("dst")))
    return graph.bfs_depth(edges, spark.createDataFrame([(1000,)], "node int"), 4)


@C.query("""
select c_custkey, case c_mktsegment when 'BUILDING' then 'construction' when 'FURNITURE' then 'meubles' when 'MACHINERY' then 'machines' else 'autre' end as category from customer""")
def enum_map(spark: SparkSession, d: str) -> DataFrame:
    """One enumeration mapped to another, with a default."""
    m = F.create_map(*[F.lit(x) for x in ("BUILDING", "construction", "FURNITURE", "meubles", "MACHINERY", "machines")])
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.try_element_at(m, F.col("c_mktsegment")), F.lit("autre")).alias("category"))


@C.query("""
select distinct farm_id, array_to_string(list_filter([case when name is null then 'name' end, case when zone_id is null then 'zone_id' end, case when latitude is null or isnan(latitude) then 'latitude' end,
 case when size_ha is null or isnan(size_ha) then 'size_ha' end], lambda x: x is not null), ',') as missing from farms""")
def required_fields(spark: SparkSession, d: str) -> DataFrame:
    """The required fields a farm lacks."""
    f = table(spark, d, "farms").select(
        "farm_id", "name", "zone_id", F.nanvl("latitude", F.lit(None).cast("double")).alias("latitude"), F.nanvl("size_ha", F.lit(None).cast("double")).alias("size_ha"))
    return f.select("farm_id", F.array_join(textops.missing_fields(("name", "zone_id", "latitude", "size_ha")), ",").alias("missing")).distinct()


PHONE = "case c_custkey % 4 when 0 then '+226 70 12 34 ' || lpad(cast(c_custkey % 100 as varchar), 2, '0') when 1 then '(0)70-12' when 2 then '22670' || c_custkey || '1234' else 'abc' end"


@C.query(f"""
with x as (select c_custkey, {PHONE} as phone from customer)
select c_custkey, regexp_full_match(regexp_replace(phone, '[\\s\\-()]', '', 'g'), '\\+?[1-9][0-9]{{7,14}}') as ok from x""")
def phone_validation(spark: SparkSession, d: str) -> DataFrame:
    """Phone numbers that can be dialled."""
    k = F.col("c_custkey")
    phone = (
        F.when(k % 4 == 0, F.concat(F.lit("+226 70 12 34 "), F.lpad((k % 100).cast("string"), 2, "0"))).when(k % 4 == 1, "(0)70-12")
        .when(k % 4 == 2, F.concat(F.lit("22670"), k.cast("string"), F.lit("1234"))).otherwise("abc")
    )
    return table(spark, d, "customer").select("c_custkey", textops.is_phone(phone).alias("ok"))


@C.query("""
select o_orderkey, month(o_orderdate) between 6 and 9 as rainy, dayofyear(o_orderdate) as day_of_year, strftime(o_orderdate, '%d/%m') as short_day,
 o_orderdate + case o_orderstatus when 'O' then interval 1 day when 'P' then interval 2 day else interval 3 day end as valid_until from orders""")
def date_keys(spark: SparkSession, d: str) -> DataFrame:
    """Season, day of the year, short day and validity of dates, by the kind of hazard."""
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.month(t).between(6, 9).alias("rainy"), F.dayofyear(t).alias("day_of_year"), F.date_format(t, "dd/MM").alias("short_day"),
        (t + F.make_dt_interval(F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3))).alias("valid_until"))


@C.query("""select source from documents where source is not null union select source from mix_targets""")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    """Union without repetition."""
    return table(spark, d, "documents").where("source is not null").select("source").union(table(spark, d, "mix_targets").select("source")).distinct()


@C.query("""(select source, 'no documents' as gap from mix_targets except select source, 'no documents' from documents) union all
 (select source, 'no target' from documents where source is not null except select source, 'no target' from mix_targets)""")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    """What one side has and the other lacks, both ways: a conformity check."""
    a = table(spark, d, "mix_targets").select("source")
    b = table(spark, d, "documents").where("source is not null").select("source").distinct()
    return a.join(b, "source", "left_anti").distinct().select("source", F.lit("no documents").alias("gap")).unionByName(
        b.join(a, "source", "left_anti").select("source", F.lit("no target").alias("gap")))


@C.query("""
select zone_id, array_to_string(list_sort(list_distinct(list(lower(crop)))), ',') as crops from documents where crop is not null and zone_id is not null group by 1""")
def crops_of_zones(spark: SparkSession, d: str) -> DataFrame:
    """Distinct crops of each zone, sorted."""
    x = table(spark, d, "documents").where("crop is not null and zone_id is not null")
    return x.groupBy("zone_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("crop"))), ",").alias("crops"))


@C.query("""
select distinct farm_id, coalesce(nullif(size_ha, 0), 1) * 10000 as square_metres from farms where size_ha is not null and not isnan(size_ha)""")
def surface_default(spark: SparkSession, d: str) -> DataFrame:
    """Surfaces in square metres; zero counts as missing."""
    f = table(spark, d, "farms").where("size_ha is not null and not isnan(size_ha)")
    return f.select("farm_id", (F.coalesce(F.nullif("size_ha", F.lit(0.0)), F.lit(1.0)) * 10000).alias("square_metres")).distinct()


@C.query("""
select vec_id, round(list_sum(list_transform(embedding[1:7], lambda x: cast(x as double))), 5) as first_week from embeddings""")
def forecast_sum(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the first seven entries of an array."""
    total = F.aggregate(F.slice("embedding", 1, 7), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(total, 5).alias("first_week"))


@C.query("""
select n_nationkey, array_to_string(list_concat([x for x in ['ALGERIA', 'Peru'] if lower(x) <> lower(n_name)], [n_name]), ',') as merged from nation""")
def merge_keyed_lists(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of records merged by a key without case."""
    old = F.array(F.struct(F.lit("ALGERIA").alias("k")), F.struct(F.lit("Peru").alias("k")))
    new = F.array(F.struct(F.col("n_name").alias("k")))
    return table(spark, d, "nation").select(
        "n_nationkey", F.array_join(F.transform(profiles.merge_lists(old, new, "k"), lambda x: x["k"]), ",").alias("merged"))


@C.query("""select doc_type, count(*) as files, sum(n_chars) as bytes, round(sum(n_chars) / 1048576.0, 6) as mb from documents where created_at < timestamptz '2023-01-01 00:00:00+00' group by 1""")
def cleanup_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a cleanup would remove: files, bytes, megabytes."""
    old = table(spark, d, "documents").where("created_at < timestamp'2023-01-01 00:00:00 UTC'")
    return old.groupBy("doc_type").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.round(F.sum("n_chars") / 1048576.0, 6).alias("mb"))
