"""Streams over files agree with their batch meaning."""

from pyspark.sql import functions as F

from granary.streaming import messages as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def source(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return S.stream(spark, path, schema, "ts")


def events(spark):
    t = [r[0] for r in spark.sql("select explode(sequence(timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 05:00:00', interval 10 minutes))").collect()]
    return [(i, x, i % 3, "view" if i % 2 else "buy", float(i)) for i, x in enumerate(t)]


def test_idempotent_and_windows(spark, tmp_path):
    rows = events(spark)
    s = source(spark, tmp_path, rows + rows[:5])
    S.run_once(S.idempotent(s, ["event_id"]), "once")
    assert spark.table("once").count() == len(rows)
    S.run_once(S.windowed(s, "event_type", "value"), "hours", "complete")
    got = {(r.start, r.event_type): r.n for r in spark.table("hours").collect()}
    want = spark.createDataFrame(rows + rows[:5], SCHEMA).groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").count().collect()
    assert got == {(r.start, r.event_type): r["count"] for r in want}
    S.run_once(S.sessions(s, "user_id"), "runs", "complete")
    assert spark.table("runs").agg(F.sum("n")).first()[0] == len(rows) + 5


def test_fan_out(spark, tmp_path):
    schema = "message_id long, ts timestamp, intent string, zone string, sender string"
    rows = spark.sql("select 1L, timestamp'2024-01-01', 'buy', 'n', 'a1' union all select 2L, timestamp'2024-01-01', 'sell', 's', 'a9'").collect()
    s = source(spark, tmp_path, [tuple(r) for r in rows], schema)
    subs = spark.createDataFrame([("buy", "a1"), ("buy", "a2"), ("sell_s", "a2"), ("x", "a3")], "topic string, agent string")
    S.run_once(S.fan_out(s, subs), "copies")
    assert {tuple(r) for r in spark.table("copies").collect()} == {(1, "a2"), (2, "a2")}


def test_state_machine(spark, tmp_path):
    legal = {"PROPOSED": ("COUNTER", "ACCEPTED", "REJECTED"), "COUNTER": ("COUNTER", "ACCEPTED", "REJECTED")}
    moves = [("h1", "COUNTER"), ("h1", "COUNTER"), ("h1", "ACCEPTED"), ("h2", "COUNTER"), ("h2", "COUNTER"), ("h2", "COUNTER"), ("h3", "REJECTED"), ("h3", "COUNTER")]
    t = spark.sql("select timestamp'2024-01-01 00:00:00' as t").first().t
    import datetime as dt

    rows = [(k, m, t + dt.timedelta(seconds=i)) for i, (k, m) in enumerate(moves)]
    s = source(spark, tmp_path, rows, "k string, move string, ts timestamp")
    out = S.state_machine(s, "k", legal, "PROPOSED", {"COUNTER": 2})
    S.run_once(out, "states", checkpoint=str(tmp_path / "cp"))
    got = [(r.k, r.state, r.turns, r.ok) for r in spark.table("states").collect()]
    assert [x for x in got if x[0] == "h1"] == [("h1", "COUNTER", 1, True), ("h1", "COUNTER", 2, True), ("h1", "ACCEPTED", 3, True)]
    assert [x[3] for x in got if x[0] == "h2"] == [True, True, False]
    assert [x[1:] for x in got if x[0] == "h3"] == [("REJECTED", 1, True), ("REJECTED", 1, False)]


def test_silent_keys_time_out(spark, tmp_path):
    import datetime as dt

    schema = "k string, move string, ts timestamp"
    t = spark.sql("select timestamp'2024-01-01 00:00:00' as t").first().t
    path = str(tmp_path / "in")
    for i, (k, hours) in enumerate((("a", 0), ("b", 5), ("c", 6))):
        spark.createDataFrame([(k, "COUNTER", t + dt.timedelta(hours=hours)), (k, "COUNTER", t + dt.timedelta(hours=hours - 1))], schema).coalesce(1).write.mode("append").parquet(path)
    legal = {"PROPOSED": ("COUNTER",), "COUNTER": ("COUNTER",)}
    s = S.stream(spark, path, schema, "ts", files_per_batch=1)
    S.run_once(S.state_machine(s, "k", legal, "PROPOSED", {"COUNTER": 2}), "timeouts", checkpoint=str(tmp_path / "cp"))
    got = [(r.k, r.state, r.turns) for r in spark.table("timeouts").collect()]
    assert ("a", "TIMED_OUT", 2) in got and not [x for x in got if x[0] == "c" and x[1] == "TIMED_OUT"]


def test_live_and_batches(spark, tmp_path):
    rows = events(spark)
    s = source(spark, tmp_path, rows)
    S.run_once(S.live(s, "ts", "2024-01-01 05:00:00"), "alive")
    assert spark.table("alive").count() == sum(1 for r in rows if r[1] > rows[-1][1] - (rows[6][1] - rows[0][1]))
    out = str(tmp_path / "out")
    S.each_batch(s, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.option("recursiveFileLookup", True).parquet(out).count() == len(rows)


def test_context_cache(spark, tmp_path):
    import datetime as dt

    t = spark.sql("select timestamp'2024-01-01 00:00:00' as t").first().t
    at = lambda s: t + dt.timedelta(seconds=s)
    rows = [("a", 1, False, at(0)), ("a", 2, False, at(200)), ("a", 3, True, at(250)), ("a", 4, False, at(540)), ("a", 5, False, at(900)), ("b", 6, False, at(10))]
    s = source(spark, tmp_path, rows, "k string, id long, urgent boolean, ts timestamp")
    S.run_once(S.context_cache(s, "k"), "cache", checkpoint=str(tmp_path / "cp"))
    assert {r.id: r.hit for r in spark.table("cache").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}
