"""Messages, memory, caches and logs over the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators import relational as R
from granary.operators.prefix import running_sum
from granary.plans.catalog import Catalog
from granary.plans.flows import urgent
from granary.sources.tables import table

C = Catalog()


def day() -> Column:
    """The calendar day of an event."""
    return F.date_format("ts", "yyyy-MM-dd")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@C.query("""
select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r
 from events) where r = 1""")
def upsert_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    """ON CONFLICT (key) DO UPDATE as latest row per key, by an aggregate that combines map-side."""
    e = events(spark, d).select("user_id", "event_type", "ts", "event_id", "value")
    return R.latest_by_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@C.query("""
with t as (select user_id, event_type, max(props) as status, max(value) as score from events where ts is null or ts < timestamp '2024-01-16' group by 1, 2),
u as (select user_id, event_type, max(value) as score from events where ts >= timestamp '2024-01-16' group by 1, 2)
select coalesce(u.user_id, t.user_id) as user_id, coalesce(u.event_type, t.event_type) as event_type, t.status, coalesce(u.score, t.score) as score
from t full join u on t.user_id is not distinct from u.user_id and t.event_type is not distinct from u.event_type""")
def upsert_column_subset(spark: SparkSession, d: str) -> DataFrame:
    """Every event: those from a day on update the score of the earlier ones' keys and keep the status."""
    e = events(spark, d)
    key, late = ["user_id", "event_type"], F.coalesce(F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'"), F.lit(False))
    t = e.where(~late).groupBy(*key).agg(F.max("props").alias("status"), F.max("value").alias("score"))
    u = e.where(late).groupBy(*key).agg(F.max("value").alias("score"))
    return R.upsert(t, u.withColumn("status", F.lit(None).cast("string")), key)


@C.query("""
select md5(text) as data_hash, min(doc_id) as doc_id from documents where md5(text) not in (select md5(text) from documents where doc_id < 100)
group by 1""")
def insert_or_ignore_hash(spark: SparkSession, d: str) -> DataFrame:
    """Insert unless the content hash is known; one row per hash."""
    docs = table(spark, d, "documents").select(F.md5("text").alias("data_hash"), "doc_id")
    return R.insert_or_ignore(docs.where("doc_id < 100"), docs, "data_hash").select("data_hash", "doc_id")


@C.query("""
select event_id, substr(sha256(cast(user_id as varchar) || ':' || event_type || ':' || strftime(ts, '%Y-%m-%d')), 1, 16) as key,
case when value < 1 then 'REJECTED' when row_number() over (partition by user_id, event_type, strftime(ts, '%Y-%m-%d'), value < 1 order by ts, event_id) = 1
 then 'ACCEPTED' else 'DUPLICATE' end as status from events""")
def idempotent_ack_status(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgement of each message: rejected if invalid, else accepted once per key, else duplicate."""
    e = events(spark, d).withColumn("key", F.substring(F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), "event_type", day()), 256), 1, 16))
    first = e.where("value >= 1").groupBy("key").agg(F.min(F.struct("ts", "event_id")).alias("x")).select(
        F.col("x.event_id").alias("first_id"))
    return e.join(first, F.col("event_id") == F.col("first_id"), "left").select(
        "event_id", "key", F.when(F.col("value") < 1, "REJECTED").when(F.col("first_id").isNotNull(), "ACCEPTED").otherwise("DUPLICATE").alias("status"))


@C.query("""
select sha256(event_type || ':' || cast(user_id as varchar) || ':' || props) as hash_signature, count(*) as n from events group by 1""")
def audit_signature(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 signatures of audit rows and how often each would repeat."""
    sig = F.sha2(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), "props"), 256)
    return events(spark, d).groupBy(sig.alias("hash_signature")).agg(F.count("*").alias("n"))


@C.query("""
select event_type as type, user_id % 5 as zone, strftime(ts, '%Y-%m-%d') as day, min(event_id) as event_id, count(*) as n
from events where value > 250 group by 1, 2, 3""")
def alert_day_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One alert per (type, zone, day)."""
    return events(spark, d).where("value > 250").groupBy(
        F.col("event_type").alias("type"), (F.col("user_id") % 5).alias("zone"), day().alias("day")
    ).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@C.query("""
with m as (select event_id as message_id, event_type as intent, event_type || '_' || (user_id % 3) as intent_zone, user_id % 40 as sender
 from events where value > 350),
s as (select n_nationkey as agent, case n_regionkey when 0 then 'click' when 1 then 'view' when 2 then 'error' else 'purchase' end as topic, 'intent' as kind from nation
 union all select n_nationkey, 'purchase_' || (n_nationkey % 3), 'intent_zone' from nation)
select distinct message_id, agent from m join s on (kind = 'intent' and topic = intent) or (kind = 'intent_zone' and topic = intent_zone)
where agent <> sender""")
def pubsub_fanout(spark: SparkSession, d: str) -> DataFrame:
    """One copy of a message per subscriber of its intent or its intent and zone, never the sender."""
    m = events(spark, d).where("value > 350").select(
        F.col("event_id").alias("message_id"), F.col("event_type").alias("intent"),
        F.concat_ws("_", "event_type", (F.col("user_id") % 3).cast("string")).alias("intent_zone"), (F.col("user_id") % 40).alias("sender"))
    n = table(spark, d, "nation")
    topic = F.when(F.col("n_regionkey") == 0, "click").when(F.col("n_regionkey") == 1, "view").when(F.col("n_regionkey") == 2, "error").otherwise("purchase")
    s = n.select(F.col("n_nationkey").alias("agent"), topic.alias("topic"), F.lit("intent").alias("kind")).unionByName(
        n.select(F.col("n_nationkey").alias("agent"), F.concat(F.lit("purchase_"), (F.col("n_nationkey") % 3).cast("string")).alias("topic"),
                 F.lit("intent_zone").alias("kind")))
    return R.fan_out(m, s, [("intent", "intent"), ("intent_zone", "intent_zone")])


@C.query("""
select distinct user_id from events where event_type = 'purchase' intersect
(select distinct user_id from events where user_id % 5 = 1 union select distinct user_id from events where value > 400)""")
def registry_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Agents with an intent and (a zone or all zones): an intersection of id sets."""
    e = events(spark, d)
    ids = lambda c: e.where(c).select("user_id")
    return ids("event_type = 'purchase'").intersect(ids("user_id % 5 = 1").union(ids("value > 400")))


@C.query("""
select s_suppkey, rank, greatest(0, 100 - cast(floor(s_acctbal / 100) as bigint)) as score from (
 select *, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) as rank from supplier) where rank <= 5""")
def scored_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each zone by response time, with rank and score."""
    top = R.top_k(table(spark, d, "supplier"), ["s_nationkey"], [F.asc("s_acctbal"), F.asc("s_suppkey")], 5)
    return top.select("s_suppkey", "rank", F.greatest(F.lit(0).cast("bigint"), 100 - F.floor(F.col("s_acctbal") / 100)).alias("score"))


@C.query("""
select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, ts desc, event_id) r from events where value > 10) where r <= 5""")
def episodic_recall_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five most relevant episodes of each user above a relevance gate, newest first among equals."""
    e = events(spark, d).where("value > 10")
    return R.top_k(e, ["user_id"], [F.desc("value"), F.desc("ts"), F.asc("event_id")], 5).select("user_id", "event_id", "value")


@C.query("""
select event_id, round(value / 500 * case when event_type in ('error', 'purchase') then sqrt(0.95) else 0.95 end, 6) as relevance
from events where value / 500 > 0.1""")
def memory_decay(spark: SparkSession, d: str) -> DataFrame:
    """Relevance decay, slower for severe episodes; below the gate nothing is touched."""
    r = F.col("value") / 500
    factor = F.when(F.col("event_type").isin("error", "purchase"), F.sqrt(F.lit(0.95))).otherwise(0.95)
    return events(spark, d).where(r > 0.1).select("event_id", F.round(r * factor, 6).alias("relevance"))


@C.query("""select doc_id from documents where source not in ('radio_rurale', 'alerte_meteo') and length(text) >= 500""")
def significance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Exchanges worth remembering: intent not trivial and answer long enough."""
    return table(spark, d, "documents").where(~F.col("source").isin("radio_rurale", "alerte_meteo") & (F.length("text") >= 500)).select("doc_id")


@C.query("""
select event_id as conversation_id, 'user' as role, event_type as content, 1 as turn from events
union all select event_id, 'assistant', props, 2 from events""")
def exchange_to_messages(spark: SparkSession, d: str) -> DataFrame:
    """One exchange to two message rows."""
    rows = F.array(
        F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"), F.lit(1).alias("turn")),
        F.struct(F.lit("assistant").alias("role"), F.col("props").alias("content"), F.lit(2).alias("turn")))
    return events(spark, d).select(F.col("event_id").alias("conversation_id"), F.inline(rows))


@C.query("""select user_id, strftime(ts, '%Y-%m-%d') as session, string_agg(event_type, '>' order by ts, event_id) as trace from events group by 1, 2""")
def trace_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each session in order, concatenated; duplicates stay."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return events(spark, d).groupBy("user_id", day().alias("session")).agg(F.array_join(F.transform(steps, lambda x: x["event_type"]), ">").alias("trace"))


@C.query("""
select event_id, count(*) over (partition by user_id order by ts range between interval 59 second preceding and current row) > 1 as limited,
 count(*) over (partition by user_id order by ts range between interval 1 hour preceding and current row) as in_hour from events""")
def rate_limit_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Calls in a sliding window before each call."""
    hour = 3600 * 1_000_000
    e = events(spark, d).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    # an hour of a user is a group; the hour before comes along, so that no group holds all calls of a busy user
    both = F.array(F.struct(F.floor(F.col("at") / hour).alias("slot"), F.lit(True).alias("own")), F.struct((F.floor(F.col("at") / hour) + 1).alias("slot"), F.lit(False).alias("own")))
    e = e.select("*", F.inline(both))
    w = lambda sec: W.partitionBy("user_id", "slot").orderBy("at").rangeBetween(-sec * 1_000_000, 0)
    e = e.select("event_id", "own", (F.count("*").over(w(59)) > 1).alias("limited"), F.count("*").over(w(3600)).alias("in_hour"))
    return e.where("own").drop("own")


@C.query("""
with a as (select *, sum(case when event_type <> 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from events)
select user_id, run, count(*) as failures, min(event_id) as first_event, count(*) >= 5 as open from a where event_type = 'error' group by 1, 2""")
def circuit_breaker_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive failures; five open the circuit (gaps and islands)."""
    fine = F.when(F.col("event_type") != "error", 1).otherwise(0)
    a = running_sum(events(spark, d).withColumn("fine", fine), "user_id", F.date_trunc("hour", "ts"), ["ts", "event_id"], "fine", "run")
    return a.where("event_type = 'error'").groupBy("user_id", "run").agg(
        F.count("*").alias("failures"), F.min("event_id").alias("first_event"), (F.count("*") >= 5).alias("open"))


@C.query("""
select event_type as category, count(*) as total, count(*) filter (value < 250) as success, count(*) filter (value >= 250) as failed,
 round(100.0 * count(*) filter (value < 250) / count(*), 2) as rate from events group by 1""")
def category_success_rate(spark: SparkSession, d: str) -> DataFrame:
    """Totals, successes and rate per category."""
    ok = F.count_if(F.col("value") < 250)
    return events(spark, d).groupBy(F.col("event_type").alias("category")).agg(
        F.count("*").alias("total"), ok.alias("success"), F.count_if(F.col("value") >= 250).alias("failed"),
        F.round(F.try_divide(ok * 100.0, F.count("*")), 2).alias("rate"))


@C.query("""
select user_id, case when bool_and(value < 250) then 'SUCCESS' when bool_and(value >= 250) then 'ERROR' else 'PARTIAL' end as status from events group by 1""")
def overall_status(spark: SparkSession, d: str) -> DataFrame:
    """One status from many: all good, all bad, or mixed."""
    good = F.col("value") < 250
    return events(spark, d).groupBy("user_id").agg(
        F.when(F.every(good), "SUCCESS").when(F.every(~good), "ERROR").otherwise("PARTIAL").alias("status"))


@C.query("select user_id, count(*) as errors from events where event_type = 'error' group by 1")
def log_errors_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Errors per source."""
    return events(spark, d).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"))


@C.query("select event_id, user_id, value from events where value > 100 order by value desc, event_id limit 20")
def slow_requests(spark: SparkSession, d: str) -> DataFrame:
    """The twenty slowest requests over a threshold (a top-k report)."""
    return events(spark, d).where("value > 100").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "user_id", "value")


@C.query("""select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""")
def status_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Counts by category and day."""
    return events(spark, d).groupBy("event_type", day().alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@C.query("""select event_id, ts from (select * from events order by ts desc, event_id desc limit 10) order by ts, event_id""")
def last_buffer_entries(spark: SparkSession, d: str) -> DataFrame:
    """The last ten entries, in order (a top-k report)."""
    return events(spark, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).orderBy("ts", "event_id").select("event_id", "ts")


@C.query("""
with c as (select md5(event_type || ':' || user_id) as key, event_id, ts, value from events),
q as (select distinct md5(event_type || ':' || user_id) as key from events where value > 480)
select key, max_by(event_id, (ts, event_id)) as event_id from q join c using (key) where ts > timestamp '2024-01-20' group by 1""")
def cache_lookup_ttl(spark: SparkSession, d: str) -> DataFrame:
    """The latest unexpired cache entry of each requested key."""
    key = F.md5(F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).alias("key")
    c = events(spark, d).where("ts > timestamp_ntz'2024-01-20'").select(key, "event_id", "ts")
    q = events(spark, d).where("value > 480").select(key).distinct()
    return c.join(q, "key", "left_semi").groupBy("key").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@C.query("""
select doc_id, not regexp_matches(lower(text), 'urgence|urgent|emergency|maladie|disease|inondation|flood|criquet|locust|invasion|famine|sécheresse|drought|alerte|alert|danger|mort|dead|dying|mourir|épidémie|epidemic|contamination') as cacheable,
 epoch_us(created_at) + 300000000 as expires_us, epoch_us(created_at) + 300000000 < epoch_us(timestamptz '2024-01-15 00:00:00+00') as expired from documents where text is not null""")
def cache_policy(spark: SparkSession, d: str) -> DataFrame:
    """Urgent texts bypass the cache; others expire after a time to live."""
    until = F.unix_micros("created_at") + 300_000_000
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", (~urgent(F.col("text"))).alias("cacheable"), until.alias("expires_us"), (until < F.unix_micros(F.lit("2024-01-15T00:00:00Z").cast("timestamp"))).alias("expired"))


@C.query("""select user_id, max_by(event_type, (ts, event_id)) as last_status, max(ts) as last_seen from events group by 1""")
def heartbeat_latest(spark: SparkSession, d: str) -> DataFrame:
    """Last status and time of each agent."""
    return events(spark, d).groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"), F.max("ts").alias("last_seen"))


@C.query("""select event_id, user_id from (select *, row_number() over (partition by user_id order by ts, event_id) r from events) where r <= 10""")
def dequeue_fifo(spark: SparkSession, d: str) -> DataFrame:
    """The ten oldest messages of each queue."""
    return R.top_k(events(spark, d), ["user_id"], [F.asc("ts"), F.asc("event_id")], 10).select("event_id", "user_id")


@C.query("""select user_id, count(*) as backlog, count(*) > 100 as warning from events group by 1""")
def queue_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Backlog of each queue and a warning over a limit."""
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("backlog"), (F.count("*") > 100).alias("warning"))


@C.query("""
select event_type, coalesce(round(100.0 * count(*) filter (value < 300) / nullif(count(*), 0), 2), 0) as progress from events group by 1""")
def checkpoint_progress(spark: SparkSession, d: str) -> DataFrame:
    """Percentage done per category, 0 for none."""
    return events(spark, d).groupBy("event_type").agg(
        F.coalesce(F.round(F.try_divide(F.count_if(F.col("value") < 300) * 100.0, F.count("*")), 2), F.lit(0.0)).alias("progress"))


@C.query("""
select event_id from events where event_type = 'view' except (select event_id from events where value < 100 union select event_id from events where value > 400)""")
def pending_tasks(spark: SparkSession, d: str) -> DataFrame:
    """All less completed less failed (anti joins)."""
    e = events(spark, d)
    done = e.where("value < 100 or value > 400").select("event_id")
    return e.where("event_type = 'view'").select("event_id").join(done, "event_id", "left_anti")


@C.query("""select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k from events""")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    """A member of a JSON payload."""
    return events(spark, d).select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@C.query("""select try_cast(json_extract_string(props, '$.k') as integer) % 4 as bucket, count(*) as n, count(distinct user_id) as users from events group by 1""")
def registry_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and distinct counts per bucket."""
    k = F.from_json("props", "k int")["k"]
    return events(spark, d).groupBy((k % 4).alias("bucket")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@C.query("""
select coalesce(event_type, 'ALL') as dataset, count(*) as n from events group by rollup(event_type)""")
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    """Size of each data set and the total."""
    return events(spark, d).rollup("event_type").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("ALL")).alias("dataset"), "n")


@C.query("""select event_id, least(2.0 * power(2, user_id % 8), 60.0) as delay, case when event_type = 'error' and value > 250 then 'fatal' when event_type = 'error' then 'retry' else 'none' end as class from events""")
def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Capped exponential delay and error class."""
    e = F.col("event_type") == "error"
    return events(spark, d).select(
        "event_id", F.least(2.0 * F.pow(F.lit(2.0), F.col("user_id") % 8), F.lit(60.0)).alias("delay"),
        F.when(e & (F.col("value") > 250), "fatal").when(e, "retry").otherwise("none").alias("class"))


@C.query("""select event_id from events where ts >= timestamp '2024-01-30' - interval 7 day""")
def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    """What a retention of seven days keeps."""
    return events(spark, d).where("ts >= timestamp_ntz'2024-01-30' - INTERVAL 7 DAY").select("event_id")


@C.query("""
select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 4) as mean from events group by 1, 2""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and means by type."""
    return events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


@C.query("""
with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as new from events),
t as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
select user_id, min(ts) as start, count(*) as n from t group by user_id, session""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions closed by half an hour of silence."""
    return events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), "n")
