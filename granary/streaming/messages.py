"""Structured Streaming over messages: deduplication, fan-out, windows, keyed state.

Event time must be a TIMESTAMP; NTZ columns are cast under UTC. State is bounded
by watermarks or timeouts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: str, time: str, files_per_batch: int = 100) -> DataFrame:
    """A file stream with its event time as TIMESTAMP."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn(time, F.col(time).cast("timestamp"))


def idempotent(messages: DataFrame, keys: list[str], time: str = "ts", within: str = "24 hours") -> DataFrame:
    """Each key once within the delay; state is dropped after it."""
    return messages.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def live(messages: DataFrame, time: str, now: str, ttl: str = "1 hour") -> DataFrame:
    """Messages that haven't expired."""
    return messages.where(F.col(time) + F.expr(f"INTERVAL {ttl}") > F.lit(now).cast("timestamp"))


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(message_id, agent) by stream-static joins; ``subscriptions(topic, agent)`` are rows of unique pairs."""
    keys = F.array_distinct(F.array("intent", F.concat_ws("_", "intent", "zone")))
    m = messages.select("message_id", "sender", F.explode(keys).alias("topic"))
    return m.join(subscriptions, "topic").where("agent <> sender").select("message_id", "agent")


def windowed(messages: DataFrame, key: str, value: str, time: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; rows later than the watermark are dropped."""
    return messages.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("window.start").alias("start"), key, "n", "total")


def sessions(messages: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by key, closed by silence."""
    return messages.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("start"), key, "n")


def state_machine(
    moves: DataFrame, key: str, legal: dict[str, tuple[str, ...]], first: str, limited: dict[str, int], timeout_ms: int = 3_600_000,
    late: str = "10 minutes",
) -> DataFrame:
    """(key, state, turns, ok) after each move of ``moves(key, move, ts)``.

    ``legal`` maps a state to the moves it takes; a move's name is the state it
    leads to. ``limited`` bounds how often a move may be taken. Illegal moves
    change nothing. A key without moves for ``timeout_ms`` of event time ends as TIMED_OUT.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, turns, _, _ = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "state": ["TIMED_OUT"], "turns": [turns], "ok": [True]})
            return
        at, turns, used, last = state.get if state.exists else (first, 0, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for move in rows["move"]:
            ok = move in legal.get(at, ()) and not (move in limited and used >= limited[move])
            if ok:
                at, turns = move, turns + 1
                used += move in limited
            out.append((k[0], at, turns, bool(ok)))
        if legal.get(at):
            last = max(last, int(rows["ts"].max().timestamp() * 1000))  # late moves don't bring the end forward
            state.update((at, turns, used, last))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "state", "turns", "ok"])

    return moves.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        step, f"{key} string, state string, turns int, ok boolean", "state string, turns int, used int, last long", "append",
        GroupStateTimeout.EventTimeTimeout)


def context_cache(requests: DataFrame, key: str, ttl_ms: int = 300_000, late: str = "10 minutes") -> DataFrame:
    """(key, id, hit) of ``requests(key, id, urgent, ts)``: a hit if the key's context was built within the time to live.

    A miss builds it. Urgent requests go past the cache and build it anew. State goes when its time to live is over.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        built = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable").itertuples():
            at = int(row.ts.timestamp() * 1000)
            hit = built is not None and not row.urgent and 0 <= at - built <= ttl_ms
            if not hit:
                built = at
            out.append((k[0], row.id, hit))
        state.update((built,))
        state.setTimeoutTimestamp(max(built + ttl_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, "id", "hit"])

    return requests.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        step, f"{key} string, id long, hit boolean", "built long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all that is there into a memory table, for tests and backfills."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    w.start().awaitTermination()


def each_batch(df: DataFrame, write, checkpoint: str):
    """A sink that writes each batch by a function (batch, id); replays of an id must be harmless."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
