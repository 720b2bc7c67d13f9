"""Marketplace queries: who offers, who asks, what is in stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import fold
from granary.operators import relational as R
from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()


def near(column: str, zone: int) -> str:
    """SQL: the zone itself or one of the same region (an existence join)."""
    return (
        f"({column} = {zone} OR {column} IN (SELECT z2.n_nationkey FROM nation z1 JOIN nation z2 "
        f"ON z1.n_regionkey = z2.n_regionkey WHERE z1.n_nationkey = {zone}))"
    )


@C.query(f"""
select p_partkey, p_name, p_retailprice, quantity_for_sale, s_suppkey, s_name, n_name as zone_name
from (select l_partkey, l_suppkey, sum(l_quantity) as quantity_for_sale from lineitem group by 1, 2)
join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey left join nation on n_nationkey = s_nationkey
where p_name ilike '%red%' and quantity_for_sale > 0 and {near('s_nationkey', 3)}
order by p_retailprice, p_partkey, s_suppkey limit 10""")
def products_for_buyer(spark: SparkSession, d: str) -> DataFrame:
    """Products by name near a zone, cheapest first. The part filter goes before the aggregate."""
    nation = table(spark, d, "nation")
    home = nation.where("n_nationkey = 3").select(F.col("n_regionkey").alias("r"))
    close = nation.join(F.broadcast(home), F.col("n_regionkey") == F.col("r"), "left_semi").select("n_nationkey")  # 25 rows
    sellers = table(spark, d, "supplier").join(F.broadcast(close), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    parts = table(spark, d, "part").where(F.col("p_name").ilike("%red%"))
    listing = (
        table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
        .join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        .groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity_for_sale")).where("quantity_for_sale > 0")
    )
    names = nation.select("n_nationkey", F.col("n_name").alias("zone_name"))
    return (
        listing.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(names), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select("p_partkey", "p_name", "p_retailprice", "quantity_for_sale", "s_suppkey", "s_name", "zone_name")
        .orderBy("p_retailprice", "p_partkey", "s_suppkey").limit(10)
    )


@C.query(f"""
select o_orderkey, c_custkey, c_name, n_name as zone_name, o_orderdate from orders
join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
where o_orderstatus = 'O' and {near('c_nationkey', 5)}
and exists (select 1 from lineitem join part on p_partkey = l_partkey where l_orderkey = o_orderkey and p_name ilike '%blue%')
order by o_orderdate desc, o_orderkey limit 20""")
def buyers_for_product(spark: SparkSession, d: str) -> DataFrame:
    """Open demands of buyers near a zone for a product, newest first."""
    for n in ("orders", "customer", "nation", "lineitem", "part"):
        table(spark, d, n).createOrReplaceTempView(n)
    wanted = spark.sql("SELECT l_orderkey FROM lineitem LEFT SEMI JOIN part ON p_partkey = l_partkey AND p_name ILIKE '%blue%'")
    wanted.createOrReplaceTempView("wanted")
    return spark.sql(f"""
        SELECT o_orderkey, c_custkey, c_name, n_name AS zone_name, o_orderdate
        FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
        WHERE o_orderstatus = 'O' AND {near('c_nationkey', 5)} AND o_orderkey IN (SELECT l_orderkey FROM wanted)
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")


@C.query("""
select s_nationkey as zone, round(nullif(avg(p_retailprice), 0), 2) as avg_price, count(*) as listings
from (select distinct l_partkey, l_suppkey from lineitem) join part on p_partkey = l_partkey
join supplier on s_suppkey = l_suppkey group by 1""")
def avg_price_by_zone(spark: SparkSession, d: str) -> DataFrame:
    """Average price of the listings of each zone; null where there is none."""
    listing = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return (
        listing.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").alias("zone"))
        .agg(F.round(F.nullif(F.avg("p_retailprice"), F.lit(0.0)), 2).alias("avg_price"), F.count("*").alias("listings"))
    )


@C.query("""
select l_partkey, l_orderkey, l_linenumber, l_extendedprice from (
 select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as r from lineitem)
where r <= 3""")
def latest_prices_topn(spark: SparkSession, d: str) -> DataFrame:
    """The three latest prices of each product."""
    order = [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return R.top_k(lines, ["l_partkey"], order, 3).select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@C.query("""
select o_orderkey, o_totalprice, o_orderdate from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'
order by o_orderdate desc nulls last, o_orderkey limit 20""")
def open_offers_optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Open offers; filters are added only for arguments that are given."""
    args = {"o_orderpriority": "1-URGENT", "o_custkey": None}
    df = table(spark, d, "orders").where("o_orderstatus = 'O'")
    for column, value in args.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice", "o_orderdate")


@C.query("select s_suppkey, s_name, s_nationkey from supplier where s_nationkey = 7")
def null_tolerant_param(spark: SparkSession, d: str) -> DataFrame:
    """A parameter that filters only when it isn't null."""
    table(spark, d, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(
        "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE (:zone IS NULL OR s_nationkey = :zone) AND (:name IS NULL OR s_name = :name)",
        args={"zone": 7, "name": None},
    )


@C.query("""select s_suppkey, s_name from supplier where exists
 (select 1 from lineitem where l_suppkey = s_suppkey and l_quantity >= 50)""")
def producers_with_stock(spark: SparkSession, d: str) -> DataFrame:
    """Producers with at least one large lot (semi join)."""
    lots = table(spark, d, "lineitem").where("l_quantity >= 50").select("l_suppkey")
    return table(spark, d, "supplier").join(lots, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


@C.query("""select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)""")
def buyers_without_orders(spark: SparkSession, d: str) -> DataFrame:
    """Buyers who never ordered (anti join)."""
    o = table(spark, d, "orders").select("o_custkey")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@C.query("""
select event_id, c_custkey from events join customer on c_mktsegment = case event_type when 'purchase' then 'BUILDING'
 when 'error' then 'MACHINERY' when 'signup' then 'FURNITURE' end and c_nationkey = user_id % 25
where value > 300 and (event_type <> 'error' or c_acctbal > 0)""")
def alert_targets_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Users an alert goes to: the extra predicate depends on the alert's type."""
    topic = F.when(F.col("event_type") == "purchase", "BUILDING").when(F.col("event_type") == "error", "MACHINERY").when(
        F.col("event_type") == "signup", "FURNITURE")
    e = table(spark, d, "events").where("value > 300").withColumn("topic", topic).where("topic is not null")
    c = table(spark, d, "customer")
    return (
        e.join(c, (F.col("topic") == F.col("c_mktsegment")) & (F.col("user_id") % 25 == F.col("c_nationkey")))
        .where("event_type <> 'error' or c_acctbal > 0").select("event_id", "c_custkey")
    )


@C.query("""
select l_partkey, round(sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end), 2) as balance, count(*) as n_moves
from lineitem group by 1""")
def stock_ledger_balance(spark: SparkSession, d: str) -> DataFrame:
    """Current stock as the signed sum of a movement ledger."""
    kind = F.when(F.col("l_returnflag") == "R", "OUT").when(F.col("l_returnflag") == "A", "ADJUSTMENT").otherwise("IN")
    out = R.balance(table(spark, d, "lineitem"), ["l_partkey"], kind, F.col("l_quantity"))
    return out.withColumn("balance", F.round("balance", 2))


@C.query("""
select o_orderkey, round(sum(l_quantity * p_retailprice), 2) as total_amount, count(*) as n_items
from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey group by 1""")
def order_totals_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Order totals from quantities and the price at sale."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    priced = lines.join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    totals = priced.groupBy("l_orderkey").agg(
        F.round(F.sum(F.col("l_quantity") * F.col("p_retailprice")), 2).alias("total_amount"), F.count("*").alias("n_items"))
    return table(spark, d, "orders").select("o_orderkey").join(totals, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@C.query("""
select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)""")
def order_lines_without_product(spark: SparkSession, d: str) -> DataFrame:
    """Order lines whose product is not on sale: the error set of an order."""
    on_sale = table(spark, d, "part").where("p_size < 40").select("p_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(on_sale, F.col("l_partkey") == F.col("p_partkey"), "left_anti")


@C.query("""
select o_orderkey, case when m.k is not null then 'MATCHED' else o_orderstatus end as status from orders
left join (select distinct l_orderkey as k from lineitem where l_discount >= 0.09) m on m.k = o_orderkey""")
def match_alerts_update(spark: SparkSession, d: str) -> DataFrame:
    """Demands whose status changes because an offer matches."""
    offers = table(spark, d, "lineitem").where("l_discount >= 0.09").select(F.col("l_orderkey").alias("k")).distinct()
    return table(spark, d, "orders").join(offers, F.col("o_orderkey") == F.col("k"), "left").select(
        "o_orderkey", F.when(F.col("k").isNotNull(), "MATCHED").otherwise(F.col("o_orderstatus")).alias("status"))


@C.query("""
with w as (select event_id, 'Brand#' || (user_id % 40) as brand from events),
c as (select p_brand, min_by(p_partkey, (p_retailprice, p_partkey)) as p_partkey, min(p_retailprice) as p_retailprice from part group by 1)
select event_id, brand, p_partkey, p_retailprice, case when p_partkey is null then 'ALERT' else 'ORDER' end as action from w left join c on p_brand = brand""")
def order_or_alert(spark: SparkSession, d: str) -> DataFrame:
    """For each wish the cheapest product, or a search alert if there is none."""
    wishes = table(spark, d, "events").select("event_id", F.concat(F.lit("Brand#"), F.col("user_id") % 40).alias("brand"))
    cheapest = table(spark, d, "part").groupBy("p_brand").agg(
        F.min(F.struct("p_retailprice", "p_partkey")).alias("x")).select("p_brand", "x.p_partkey", "x.p_retailprice")
    return R.lookup(wishes, cheapest, "brand", "p_brand").select(
        "event_id", "brand", "p_partkey", "p_retailprice", F.when(F.col("p_partkey").isNull(), "ALERT").otherwise("ORDER").alias("action"))


@C.query("""
select distinct stock_id, item_name from stocks where lower(strip_accents(trim(item_name))) = 'niebe'""")
def stocks_of_item(spark: SparkSession, d: str) -> DataFrame:
    """Stocks of an item whatever its case and accents."""
    s = table(spark, d, "stocks").where(fold(F.col("item_name")) == "niebe")
    return s.select("stock_id", "item_name").distinct()


@C.query("""
select z.region, count(distinct f.farm_id) as farms, count(distinct s.stock_id) as stocks from farms f
left join zones z on z.zone_id = f.zone_id left join stocks s on s.farm_id = f.farm_id group by 1""")
def farms_and_stocks_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Farms and stocks of each region; one farm with a tenth of the stocks is combined before the shuffle."""
    per_farm = table(spark, d, "stocks").select("farm_id", "stock_id").distinct().groupBy("farm_id").agg(F.count("*").alias("n"))
    farms = table(spark, d, "farms").select("farm_id", "zone_id").distinct()
    zones = table(spark, d, "zones").select("zone_id", "region")
    return farms.join(per_farm, "farm_id", "left").join(F.broadcast(zones), "zone_id", "left").groupBy("region").agg(  # 56 zones
        F.count("*").alias("farms"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("stocks"))


# fixed values: kilograms of each unit by exact name, and by the first name that is contained
UNIT_TO_KG = {"sac": 100.0, "sacs": 100.0, "tine": 18.0, "tines": 18.0, "plat": 2.5, "plats": 2.5, "kg": 1.0, "tonne": 1000.0, "tonnes": 1000.0}
UNIT_PARTS = (("sac", 100.0), ("sac_100", 100.0), ("sac_50", 50.0), ("tin", 15.0), ("panier", 25.0), ("tonnes", 1000.0), ("kg", 1.0))


@C.query("""
with x as (select distinct unit, lower(trim(unit)) as u, replace(lower(coalesce(unit, 'none')), 's', '') as w from stocks)
select unit, case u when 'sac' then 100.0 when 'sacs' then 100.0 when 'tine' then 18.0 when 'tines' then 18.0 when 'plat' then 2.5 when 'plats' then 2.5 when 'tonne' then 1000.0 when 'tonnes' then 1000.0 else 1.0 end::double as exact_kg,
 case when contains(w, 'sac') then 100.0 when contains(w, 'tin') then 15.0 when contains(w, 'panier') then 25.0 when contains(w, 'tonnes') then 1000.0 when contains(w, 'kg') then 1.0 else 100.0 end::double as contained_kg from x""")
def unit_to_kg(spark: SparkSession, d: str) -> DataFrame:
    """Both readings of typed units: by exact name (else 1), and by the first contained name with every s taken out (else 100)."""
    x = table(spark, d, "stocks").select("unit").distinct()
    exact = F.coalesce(F.try_element_at(F.create_map(*(v for k, kg in UNIT_TO_KG.items() for v in (F.lit(k), F.lit(kg)))), F.lower(F.trim("unit"))), F.lit(1.0))
    bare = F.replace(F.lower(F.coalesce("unit", F.lit("none"))), F.lit("s"), F.lit(""))
    return x.select("unit", exact.alias("exact_kg"), R.first_match(x, bare, list(UNIT_PARTS), 100.0).alias("contained_kg"))


@C.query("""
with o as (select farm_id, item_name, zone_id, case when size_ha > 2 then 'National' else coalesce(zone_id, 'aucune') end as place from stocks join farms using (farm_id) where item_name is not null)
select place, count(*) as n from o where (place = 'National' or lower(place) = lower('z01')) and contains(lower(item_name), 'ma') group by 1""")
def regional_or_national(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a region or of the whole country whose category contains a word, counted by place."""
    f = table(spark, d, "farms").select("farm_id", F.when(F.col("size_ha") > 2, "National").otherwise(F.coalesce("zone_id", F.lit("aucune"))).alias("place"))
    here = (F.col("place") == "National") | (F.lower("place") == F.lower(F.lit("z01")))
    x = table(spark, d, "stocks").where("item_name is not null").join(f.where(here), "farm_id")
    return x.where(F.contains(F.lower("item_name"), F.lit("ma"))).groupBy("place").agg(F.count("*").alias("n"))


@C.query("""
with s as (select distinct stock_id, item_name, quantity, unit, farm_id, replace(lower(coalesce(unit, 'none')), 's', '') as w from stocks),
v as (select *, list_filter([case when coalesce(item_name, '') = '' then 'produit' end, case when quantity is null then 'quantité' end, case when farm_id is null then 'lieu' end], lambda x: x is not null) as missing,
 case when quantity < 0 or isnan(quantity) then 'Quantité invalide' end as error,
 quantity * case when contains(w, 'sac') then 100.0::double when contains(w, 'tin') then 15.0 when contains(w, 'panier') then 25.0 when contains(w, 'tonnes') then 1000.0 when contains(w, 'kg') then 1.0 else 100.0 end as kg from s)
select stock_id, item_name, unit, array_to_string(missing, ',') as missing, error, case when len(missing) = 0 and error is null then 'WAITING_CONFIRMATION' else 'MISSING_INFO' end as status,
 case when len(missing) = 0 and error is null then round(kg, 2) end as quantity_kg from v""")
def registration_validation(spark: SparkSession, d: str) -> DataFrame:
    """What a registration lacks, what is wrong with it, and its amount in kilograms once it only waits for confirmation."""
    s = table(spark, d, "stocks").select("stock_id", "item_name", "quantity", "unit", "farm_id").distinct()
    bare = F.replace(F.lower(F.coalesce("unit", F.lit("none"))), F.lit("s"), F.lit(""))
    missing = F.array_compact(F.array(
        F.when(F.coalesce("item_name", F.lit("")) == "", "produit"), F.when(F.col("quantity").isNull(), "quantité"), F.when(F.col("farm_id").isNull(), "lieu")))
    error = F.when((F.col("quantity") < 0) | F.isnan("quantity"), "Quantité invalide")
    x = s.withColumns({"m": missing, "error": error, "kg": F.col("quantity") * R.first_match(s, bare, list(UNIT_PARTS), 100.0)})
    ok = (F.size("m") == 0) & F.col("error").isNull()
    return x.select(
        "stock_id", "item_name", "unit", F.array_join("m", ",").alias("missing"), "error", F.when(ok, "WAITING_CONFIRMATION").otherwise("MISSING_INFO").alias("status"),
        F.when(ok, F.round("kg", 2)).alias("quantity_kg"))


@C.query("""
select p_partkey, case when p_name like '%green%' then 1 when p_name like '%red%' then 2 when p_name like '%e%' then 3 else 0 end as ordinal from part""")
def theta_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first entry of a list that a text contains."""
    df = table(spark, d, "part")
    return df.select("p_partkey", R.first_match(df, F.col("p_name"), [("green", 1), ("red", 2), ("e", 3)], 0).alias("ordinal"))


@C.query("select p_partkey, upper(substr(md5(cast(p_partkey as varchar)), 1, 8)) as short_code from part")
def product_short_code(spark: SparkSession, d: str) -> DataFrame:
    """The first eight characters of an id as short code."""
    return table(spark, d, "part").select(
        "p_partkey", F.upper(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 8)).alias("short_code"))


@C.query("""
select p_partkey, unnest([p_name, p_brand, lower(p_brand)]) as alias from part""")
def alias_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per alias of a product."""
    return table(spark, d, "part").select(
        "p_partkey", F.explode(F.array("p_name", "p_brand", F.lower("p_brand"))).alias("alias"))


@C.query("""
with a as (select n_nationkey as id, lower(n_name) as k, 0 as rank from nation union all select n_nationkey, lower(n_name[8:]) || ' ' || n_regionkey, 1 from nation),
b as (select k, min_by(id, (rank, id)) as id from a group by 1),
t as (select event_id, case event_id % 3 when 0 then 'Nation_' || (user_id % 30) when 1 then (user_id % 25) || ' ' || (user_id % 5) else 'zzz' end as term from events)
select event_id, term, b.id from t left join b on b.k = lower(term)""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Terms to records: the key goes before an alias, both without case."""
    n, u = table(spark, d, "nation"), F.col("user_id")
    a = n.select(F.lower("n_name").alias("k"), F.lit(0).alias("rank"), F.col("n_nationkey").alias("id")).unionByName(
        n.select(F.concat_ws(" ", F.lower(F.substr("n_name", F.lit(8))), "n_regionkey").alias("k"), F.lit(1).alias("rank"), F.col("n_nationkey").alias("id")))
    a = a.groupBy("k").agg(F.min(F.struct("rank", "id")).alias("x")).select("k", "x.id")
    term = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Nation_"), u % 30)).when(F.col("event_id") % 3 == 1, F.concat_ws(" ", u % 25, u % 5)).otherwise("zzz")
    terms = table(spark, d, "events").select("event_id", term.alias("term")).withColumn("low", F.lower("term"))
    return R.lookup(terms, a, "low", "k").select("event_id", "term", "id")
