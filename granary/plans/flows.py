"""Request flows as columns: routing, experts fanned out and in, retries, validation, urgency, alert cycles, totals."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.plans.catalog import Catalog
from granary.sources.tables import table

C = Catalog()
EXPERTS = ("sentinelle", "formation", "market")
# fixed values: words that send a request past the cache
URGENT = (
    "urgence", "urgent", "emergency", "maladie", "disease", "inondation", "flood", "criquet", "locust", "invasion", "famine", "sécheresse",
    "drought", "alerte", "alert", "danger", "mort", "dead", "dying", "mourir", "épidémie", "epidemic", "contamination",
)
# fixed values: payload members that force a rebuild
ATTACHMENTS = ("image", "attachment", "photo")


def route(intent: Column, needs: dict[str, Column]) -> Column:
    """The path of a request by its intent and the experts it needs: sentinelle, formation, market, marketplace."""
    s, f, m, mp = (F.coalesce(needs[k], F.lit(False)) for k in ("sentinelle", "formation", "market", "marketplace"))
    active = reduce(lambda a, b: a + b, (x.cast("int") for x in (s, f, m, mp)))
    intent = F.coalesce(intent, F.lit("COUNCIL"))
    return (
        F.when(intent == "REJECT", "REJECT").when(intent == "CHAT", "EXECUTE_CHAT").when(mp & (active == 1), "SOLO_MARKETPLACE")
        .when((intent == "COUNCIL") | (active > 1), "PARALLEL_EXPERTS").when(s, "SOLO_SENTINELLE").when(f, "SOLO_FORMATION")
        .when(m, "SOLO_MARKET").otherwise("PARALLEL_EXPERTS")
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests: intent by type, needs by the value's binary figures."""
    n = F.floor("value").cast("int")
    intent = F.when(F.col("event_type") == "click", "SOLO").when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "purchase", "CHAT").when(
        F.col("event_type") == "view", "COUNCIL")
    bit = lambda i: F.shiftright(n, i).bitwiseAND(F.lit(1)) == 1
    return table(spark, d, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", intent.alias("intent"),
        *(bit(i).alias(k) for i, k in enumerate(("sentinelle", "formation", "market", "marketplace"))))


Q = """(select event_id, ts, user_id, event_type, value, case event_type when 'click' then 'SOLO' when 'error' then 'REJECT' when 'purchase' then 'CHAT' when 'view' then 'COUNCIL' end as intent,
 (cast(floor(value) as bigint) & 1) > 0 as s, (cast(floor(value) as bigint) & 2) > 0 as f, (cast(floor(value) as bigint) & 4) > 0 as m, (cast(floor(value) as bigint) & 8) > 0 as mp from events)"""


@C.query(f"""
with x as (select *, s::int + f::int + m::int + mp::int as n from {Q})
select event_id, case when intent = 'REJECT' then 'REJECT' when intent = 'CHAT' then 'EXECUTE_CHAT' when mp and n = 1 then 'SOLO_MARKETPLACE'
 when intent is null or intent = 'COUNCIL' or n > 1 then 'PARALLEL_EXPERTS' when s then 'SOLO_SENTINELLE' when f then 'SOLO_FORMATION' when m then 'SOLO_MARKET'
 else 'PARALLEL_EXPERTS' end as route from x""")
def route_requests(spark: SparkSession, d: str) -> DataFrame:
    """The path of each request."""
    r = requests(spark, d)
    return r.select("event_id", route(F.col("intent"), {k: F.col(k) for k in (*EXPERTS, "marketplace")}).alias("route"))


def fan_out_in(r: DataFrame, key: str, answer) -> DataFrame:
    """(key, lead, experts, alerts): the experts a request needs asked and their answers gathered.

    A request that needs none asks sentinelle. ``answer(expert)`` gives
    struct(response, has_alerts) as a column; empty answers are dropped. The lead is
    formation, else market, else sentinelle, by need.
    """
    wanted = F.filter(F.array(*(F.when(F.col(e), F.lit(e)) for e in EXPERTS)), lambda e: e.isNotNull())
    wanted = F.when(F.size(wanted) == 0, F.array(F.lit(EXPERTS[0]))).otherwise(wanted)
    lead = F.when(F.col("formation"), "formation").when(F.col("market"), "market").otherwise("sentinelle")
    asked = F.transform(wanted, lambda e: F.struct(e.alias("expert"), (e == lead).alias("is_lead"), answer(e).alias("a")))
    got = F.filter(asked, lambda x: F.coalesce(x["a"]["response"], F.lit("")) != "")
    return r.select(
        key, lead.alias("lead"), F.array_join(F.transform(got, lambda x: x["expert"]), "+").alias("experts"),
        F.coalesce(F.exists(got, lambda x: x["a"]["has_alerts"]), F.lit(False)).alias("alerts"), F.exists(got, lambda x: x["is_lead"]).alias("lead_answered"))


@C.query(f"""
with a as (select event_id, s, f, m, unnest([case when s or not (f or m) then 'sentinelle' end, case when f then 'formation' end, case when m then 'market' end]) as expert,
 unnest([0, 1, 2]) as o, value from {Q}),
b as (select *, case when (event_id + o) % 5 = 0 then '' else expert || ' ' || event_id end as response, value > 10 and expert = 'sentinelle' as has_alerts,
 expert = case when f then 'formation' when m then 'market' else 'sentinelle' end as is_lead from a where expert is not null)
select event_id, case when any_value(f) then 'formation' when any_value(m) then 'market' else 'sentinelle' end as lead,
 coalesce(string_agg(expert, '+' order by o) filter (response <> ''), '') as experts, coalesce(bool_or(has_alerts) filter (response <> ''), false) as alerts,
 coalesce(bool_or(is_lead) filter (response <> ''), false) as lead_answered from b group by event_id""")
def expert_fan_in(spark: SparkSession, d: str) -> DataFrame:
    """The experts that answered each request, whether the lead did, and whether one raised an alert."""
    def answer(e: Column) -> Column:
        ordinal = F.when(e == "sentinelle", 0).when(e == "formation", 1).otherwise(2)
        text = F.when((F.col("event_id") + ordinal) % 5 == 0, "").otherwise(F.concat(e, F.lit(" "), F.col("event_id")))
        return F.struct(text.alias("response"), ((F.col("value") > 10) & (e == "sentinelle")).alias("has_alerts"))

    return fan_out_in(requests(spark, d), "event_id", answer)


@C.query("""
with x as (select event_id, user_id % 5 as found_at from events)
select event_id, least(found_at, 2) as rewrites, case when found_at <= 2 then 'CONTEXT_FOUND' else 'MAX_RETRIES' end as status,
 repeat('retrieve>rewrite>', least(found_at, 2)::int) || case when found_at <= 2 then 'retrieve>compose' else 'retrieve>rewrite>compose' end as path from x""")
def bounded_retries(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval with at most two rewrites: the steps that each request takes. The loop is a counter, unrolled."""
    found_at = F.col("user_id") % 5
    x = table(spark, d, "events").select("event_id", found_at.alias("found_at"), F.lit(0).alias("rewrites"), F.lit("").alias("path"), F.lit("NO_CONTEXT").alias("status"))
    for _ in range(3):
        open_ = F.col("status").isin("NO_CONTEXT", "RETRY_SEARCH")
        found, spent = F.col("found_at") <= F.col("rewrites"), F.col("rewrites") >= 2
        x = x.select(
            "event_id", "found_at",
            F.when(open_ & ~found & ~spent, F.col("rewrites") + 1).otherwise(F.col("rewrites")).alias("rewrites"),
            F.when(~open_, F.col("path")).when(found, F.concat("path", F.lit("retrieve>compose"))).when(spent, F.concat("path", F.lit("retrieve>rewrite>compose")))
            .otherwise(F.concat("path", F.lit("retrieve>rewrite>"))).alias("path"),
            F.when(~open_, F.col("status")).when(found, "CONTEXT_FOUND").when(spent, "MAX_RETRIES").otherwise("RETRY_SEARCH").alias("status"))
    return x.select("event_id", F.col("rewrites").cast("long").alias("rewrites"), "status", "path")


def message_errors(sender: Column, intent: Column, kind: Column, handshake: Column, reference: Column) -> Column:
    """What is wrong with a message; empty if nothing is."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(none(sender), "sender_id requis"), F.when(none(intent), "intent requis"),
        F.when((kind == "handshake") & none(handshake), "handshake_status requis pour HANDSHAKE"),
        F.when((kind == "response") & none(reference), "reference_id requis pour RESPONSE")))


@C.query("""
with m as (select event_id, case when user_id % 7 > 0 then 'agent' end as sender, case when event_type <> 'view' then event_type end as intent,
 case event_type when 'signup' then 'handshake' when 'click' then 'response' else 'request' end as kind, case when value > 5 then 'proposed' end as handshake, case when event_id % 3 > 0 then 'ref' end as reference from events),
e as (select event_id, list_filter([case when sender is null then 'sender_id requis' end, case when intent is null then 'intent requis' end,
 case when kind = 'handshake' and handshake is null then 'handshake_status requis pour HANDSHAKE' end, case when kind = 'response' and reference is null then 'reference_id requis pour RESPONSE' end], lambda x: x is not null) as errors from m)
select event_id, case when len(errors) = 0 then 'ok' else 'INVALID_MESSAGE' end as status, array_to_string(errors, '; ') as details from e""")
def message_validation(spark: SparkSession, d: str) -> DataFrame:
    """Status of each message and the list of its errors."""
    t = F.col("event_type")
    errors = message_errors(
        F.when(F.col("user_id") % 7 > 0, "agent"), F.when(t != "view", t), F.when(t == "signup", "handshake").when(t == "click", "response").otherwise("request"),
        F.when(F.col("value") > 5, "proposed"), F.when(F.col("event_id") % 3 > 0, "ref"))
    x = table(spark, d, "events").select("event_id", errors.alias("errors"))
    return x.select("event_id", F.when(F.size("errors") == 0, "ok").otherwise("INVALID_MESSAGE").alias("status"), F.array_join("errors", "; ").alias("details"))


def urgent(text: Column) -> Column:
    """True if a text holds an urgent word, without case."""
    return F.exists(F.array(*map(F.lit, URGENT)), lambda w: F.contains(F.lower(text), w))


def _urgent_payload(x: dict) -> bool:
    for v in x.values():
        if isinstance(v, str) and any(w in v.lower() for w in URGENT) or isinstance(v, dict) and _urgent_payload(v):
            return True
    return any(x.get(k) for k in ATTACHMENTS)


@F.pandas_udf(T.BooleanType())
def urgent_payload(payloads: pd.Series) -> pd.Series:
    """True if a JSON object holds an urgent word in a text at any depth of objects, or an attachment. Anything else gives false."""
    def one(p) -> bool:
        try:
            x = json.loads(p) if p else None
        except ValueError:
            return False
        return isinstance(x, dict) and _urgent_payload(x)

    return payloads.map(one)


@C.query("select doc_id, regexp_matches(lower(text), '" + "|".join(URGENT) + "') as bypass from documents where text is not null")
def urgent_bypass(spark: SparkSession, d: str) -> DataFrame:
    """Whether a request goes past the cache for an urgent word in its whole text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", urgent(F.col("text")).alias("bypass"))


@C.query()
def urgent_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose payload holds an urgent word at any depth or an attachment."""
    return table(spark, d, "raw_records").where("payload is not null").select("record_id", "payload").distinct().select(
        "record_id", urgent_payload(F.col("payload")).alias("bypass"))


@C.query("""
with x as (select event_id, event_type, max(case when event_type in ('signup', 'purchase') then ts end) over (partition by user_id order by ts range between interval 6 hour preceding and current row) as built, ts from events)
select event_id, built is not null as hit, case when built is not null then cast(date_diff('second', built, ts) / 60 as bigint) end as age_minutes from x where event_type = 'view'""".replace("cast(date_diff('second', built, ts) / 60 as bigint)", "(epoch_us(ts) - epoch_us(built)) // 60000000"))
def context_cache(spark: SparkSession, d: str) -> DataFrame:
    """Reads of a context cache: a hit if the user's context was built within the time to live, and its age."""
    ttl = 6 * 3600 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-ttl, 0)
    x = table(spark, d, "events").withColumn("at", at).withColumn("built", F.max(F.when(F.col("event_type").isin("signup", "purchase"), F.col("at"))).over(w))
    age = F.floor((F.col("at") - F.col("built")) / 60_000_000)
    return x.where("event_type = 'view'").select("event_id", F.col("built").isNotNull().alias("hit"), age.alias("age_minutes"))


@C.query("""
select user_id, strftime(ts, '%Y-%m-%d') as day, count(*) as steps, case when count(*) filter (event_type = 'error') > 0 then 'error' else 'completed' end as status,
 min(event_id) filter (event_type = 'error') as first_error, round(sum(value), 4) as cost from events group by 1, 2""")
def trace_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Traces from start to end: steps, whether completed or failed, the first failing step. Aggregates only, so no trace is gathered."""
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("steps"), F.when(F.count_if(failed) > 0, "error").otherwise("completed").alias("status"),
        F.min(F.when(failed, F.col("event_id"))).alias("first_error"), F.round(F.sum("value"), 4).alias("cost"))


@C.query("""
with p as (select o_orderkey, c_nationkey, c_mktsegment from orders join customer on c_custkey = o_custkey where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 50),
t as (select o_orderkey, count(c.c_custkey) as sent_count from p left join customer c on c.c_nationkey = p.c_nationkey and c.c_mktsegment = p.c_mktsegment and c.c_acctbal > 0 group by 1),
u(segment, url) as (values ('AUTOMOBILE', 'audio/auto.mp3'), ('BUILDING', 'audio/building.mp3'))
select p.o_orderkey, true as processed, t.sent_count, u.url from p join t using (o_orderkey) left join u on u.segment = p.c_mktsegment""")
def broadcast_cycle(spark: SparkSession, d: str) -> DataFrame:
    """One cycle of alerts: the 50 oldest pending ones, their targets counted, the audio of their language, and marked as processed."""
    c = table(spark, d, "customer")
    pending = table(spark, d, "orders").where("o_orderstatus = 'O'").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey", "c_mktsegment")
    pending = pending.orderBy("o_orderdate", "o_orderkey").limit(50)
    targets = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("targets"))
    audio = spark.createDataFrame([("AUTOMOBILE", "audio/auto.mp3"), ("BUILDING", "audio/building.mp3")], "segment string, url string")
    x = pending.join(targets, (F.col("c_nationkey") == F.col("n")) & (F.col("c_mktsegment") == F.col("s")), "left")
    x = x.join(F.broadcast(audio), F.col("c_mktsegment") == F.col("segment"), "left")  # a row for each language
    return x.select("o_orderkey", F.lit(True).alias("processed"), F.coalesce("targets", F.lit(0).cast("long")).alias("sent_count"), "url")


@C.query(f"""
with e as (select event_id, unnest([case when s or not (f or m or mp) then 'sentinelle' end, case when f then 'formation' end, case when m then 'market' end, case when mp then 'marketplace' end]) as expert, value, intent from {Q}),
k as (select case when expert in ('market', 'marketplace') then 'audit:MARKET_ADVICE' when expert = 'formation' then 'audit:ADVICE_GIVEN' when value > 10 then 'alerts' end as sink from e where expert is not null
 union all select 'surplus_offers' from e where expert in ('market', 'marketplace') and value > 12)
select sink, count(*) as n from k where sink is not null group by 1""")
def persist_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a flow writes to each sink, by expert: audit lines, offers, alerts of high severity."""
    flags = (*EXPERTS, "marketplace")
    named = F.array(*(F.when(F.col(e), F.lit(e)) for e in flags))
    named = F.array_compact(named)
    experts = F.when(F.size(named) == 0, F.array(F.lit("sentinelle"))).otherwise(named)
    x = requests(spark, d).select("value", F.explode(experts).alias("expert"))
    market, severe = F.col("expert").isin("market", "marketplace"), F.col("value") > 10
    sinks = F.array_compact(F.array(
        F.when(market, "audit:MARKET_ADVICE").when(F.col("expert") == "formation", "audit:ADVICE_GIVEN").when((F.col("expert") == "sentinelle") & severe, "alerts"),
        F.when(market & (F.col("value") > 12), "surplus_offers")))
    return x.select(F.explode(sinks).alias("sink")).groupBy("sink").agg(F.count("*").alias("n"))


@C.query("""
with z as (select user_id, count(*) filter (event_type in ('view', 'click')) as found, count(*) filter (event_type = 'click') as persisted, count(*) filter (event_type = 'error') as errors from events group by 1)
select sum(found)::bigint as found, sum(persisted)::bigint as persisted, sum(errors)::bigint as errors, count(*) filter (errors > 0) as zones_with_errors from z""")
def monitoring_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all zones of what was found, persisted and failed; a failing zone doesn't stop the others."""
    t = F.col("event_type")
    z = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(t.isin("view", "click")).alias("found"), F.count_if(t == "click").alias("persisted"), F.count_if(t == "error").alias("errors"))
    return z.agg(F.sum("found").alias("found"), F.sum("persisted").alias("persisted"), F.sum("errors").alias("errors"), F.count_if(F.col("errors") > 0).alias("zones_with_errors"))


@C.query("select coalesce(sum(len(pdf_links)), 0)::bigint as documents, count(*) as scrapers from publications")
def results_total(spark: SparkSession, d: str) -> DataFrame:
    """Documents over all results: the sum of the sizes of their lists."""
    p = table(spark, d, "publications")
    return p.agg(F.coalesce(F.sum(F.when(F.col("pdf_links").isNotNull(), F.size("pdf_links"))), F.lit(0)).cast("long").alias("documents"), F.count("*").alias("scrapers"))


@C.query("""
with s as (select event_type, count(distinct user_id) as n from events group by 1) select count(*) as topics, sum(n)::bigint as subscriptions, max(n) as largest from s""")
def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    """Topics and the subscriptions to them."""
    s = table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n"))
    return s.agg(F.count("*").alias("topics"), F.sum("n").alias("subscriptions"), F.max("n").alias("largest"))


@C.query("select p_partkey, round(p_retailprice * 1.5 + p_size * 20.0::double + 500, 4) as total from part")
def cost_total(spark: SparkSession, d: str) -> DataFrame:
    """The sum over a map of costs."""
    costs = F.create_map(F.lit("produit"), F.col("p_retailprice") * 1.5, F.lit("main d'œuvre"), F.col("p_size") * 20.0, F.lit("transport"), F.lit(500.0))
    return table(spark, d, "part").select("p_partkey", F.round(F.aggregate(F.map_values(costs), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@C.query("select stock_id, item_name, epoch_us(created_at) as created_us from stocks where farm_id = 'farm_union_centrale' and item_name is not null order by item_name, created_at desc, stock_id")
def stocks_in_order(spark: SparkSession, d: str) -> DataFrame:
    """All stocks of a farm by item, the latest first."""
    s = table(spark, d, "stocks").where("farm_id = 'farm_union_centrale' and item_name is not null")
    s = s.select("stock_id", "item_name", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"))
    return s.orderBy("item_name", F.desc_nulls_last("created_us"), "stock_id")


@C.query("select c_custkey as id, c_name as name, c_nationkey as zone_id, lower(c_mktsegment) as role from customer")
def public_users(spark: SparkSession, d: str) -> DataFrame:
    """The public part of an entity: balance and other private columns stay out."""
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("zone_id"), F.lower("c_mktsegment").alias("role"))


@C.query("""
select p_partkey, p_retailprice as price, round(avg(l_extendedprice / l_quantity), 4) as fair_price, round(p_retailprice - avg(l_extendedprice / l_quantity), 4) as spread
from part join lineitem on l_partkey = p_partkey where l_quantity > 0 group by 1, 2""")
def price_spread(spark: SparkSession, d: str) -> DataFrame:
    """Public view of prices with the spread from the mean paid."""
    paid = table(spark, d, "lineitem").where("l_quantity > 0").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("fair"))
    return table(spark, d, "part").join(paid, F.col("p_partkey") == F.col("l_partkey")).select(
        "p_partkey", F.col("p_retailprice").alias("price"), F.round("fair", 4).alias("fair_price"), F.round(F.col("p_retailprice") - F.col("fair"), 4).alias("spread"))


PRODUCTS = (("compost", "Dédougou, Houndé", "paillage"), ("semences", "Banfora", "compost"), ("engrais", "Koudougou", "compost"), ("paillage", "Gourcy", None))


@C.query("""
with k(name, sellers, alternative) as (values ('compost', 'Dédougou, Houndé', 'paillage'), ('semences', 'Banfora', 'compost'), ('engrais', 'Koudougou', 'compost'), ('paillage', 'Gourcy', null))
select doc_id, string_agg(name || ': ' || sellers, ' | ' order by name) as availability,
 coalesce(string_agg(alternative, ', ' order by name), 'Consulter un revendeur local') as alternatives from documents join k on contains(lower(text), name) group by doc_id""")
def product_availability(spark: SparkSession, d: str) -> DataFrame:
    """Products of a table that a recommendation names, where they are sold, and the alternatives to them: a join on containment, not on keys."""
    k = F.broadcast(spark.createDataFrame(PRODUCTS, "name string, sellers string, alternative string"))  # the list of products
    x = table(spark, d, "documents").select("doc_id", "text").join(k, F.contains(F.lower("text"), F.col("name")))
    rows = F.sort_array(F.collect_list(F.struct("name", "sellers", "alternative")))  # at most the products of one text
    x = x.groupBy("doc_id").agg(rows.alias("r"))
    return x.select(
        "doc_id", F.array_join(F.transform("r", lambda p: F.concat(p["name"], F.lit(": "), p["sellers"])), " | ").alias("availability"),
        F.coalesce(F.nullif(F.array_join(F.transform("r", lambda p: p["alternative"]), ", "), F.lit("")), F.lit("Consulter un revendeur local")).alias("alternatives"))


@C.query("""
select p_partkey, case when p_size > 40 then p_retailprice * 1.1 else p_retailprice end as price, case when p_size > 40 then timestamp '2024-03-01' else timestamp '2024-01-01' end as updated_at from part""")
def updated_rows(spark: SparkSession, d: str) -> DataFrame:
    """An update of some rows that also sets when they were changed."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("price"), F.lit("2024-01-01").cast("timestamp_ntz").alias("updated_at"))
    return changed(p, F.col("p_size") > 40, {"price": F.col("price") * 1.1}, F.lit("2024-03-01").cast("timestamp_ntz")).drop("p_size")


def changed(df: DataFrame, where: Column, values: dict[str, Column], now: Column, at: str = "updated_at") -> DataFrame:
    """``df`` with new values in the rows that ``where`` holds for, and ``at`` set to ``now`` there."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in {**values, at: now}.items()})
