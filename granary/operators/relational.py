"""Relational building blocks: upserts without MERGE, ledgers, first matches, fan-out, top-k.

All are compositions of joins, aggregates and bounded windows. Where a group may
be large the latest or first row is taken by an aggregate (max_by), which
combines map-side, and not by a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.plans.staging import is_bounded

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 500_000


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order`` (nulls least). Ties go to the greatest whole row."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    rank = F.struct(*[F.col(c) for c in order], row)
    return df.groupBy(*keys).agg(F.max_by(row, rank).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """``target`` with ``updates`` applied by key: given columns replaced where the update has a value, new keys added.

    Each side must hold a key once; ``latest_by_key`` makes it so.
    """
    columns = columns or [c for c in target.columns if c not in keys]
    t, u = target.alias("t"), updates.alias("u")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = []
    for c in target.columns:
        if c in keys or (c in columns and c in updates.columns):
            out.append(F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}")).alias(c))
        elif c in updates.columns:
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"u.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}").alias(c))
    return t.join(u, cond, "full").select(*out)


def insert_or_ignore(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows whose key the target doesn't have, one per key (the least row)."""
    row = F.struct(*[F.col(c) for c in new.columns])
    once = new.groupBy(F.col(key).alias("_key")).agg(F.min(row).alias("_row")).select("_row.*")
    return once.join(target.select(key).distinct(), key, "left_anti").select(*new.columns)


def balance(moves: DataFrame, keys: list[str], kind: Column, quantity: Column) -> DataFrame:
    """Signed sum of a ledger: IN adds, OUT takes away, ADJUSTMENT is signed itself."""
    signed = F.when(kind == "OUT", -quantity).otherwise(quantity)
    return moves.groupBy(*keys).agg(F.sum(signed).alias("balance"), F.count("*").alias("n_moves"))


def first_match(df: DataFrame, text: Column, table: list[tuple[str, object]], default: object) -> Column:
    """The value of the first entry, in order, whose key the text contains; a ``CASE``, so no join."""
    out = F.lit(default)
    for key, value in reversed(table):
        out = F.when(text.contains(key), F.lit(value)).otherwise(out)
    return out


def fan_out(messages: DataFrame, subscriptions: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """(message_id, agent): one copy per subscriber whose topic equals any of the message's keys; never the sender.

    ``on`` pairs a message column with the kind of subscription; each is an equi-join.
    """
    parts = []
    for column, kind in on:
        s = subscriptions.where(F.col("kind") == kind).select("topic", "agent")
        parts.append(messages.join(s, messages[column] == s["topic"]).where("agent <> sender").select("message_id", "agent"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes each group before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def lookup(df: DataFrame, table: DataFrame, key: str, other: str, rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` left-joined to ``table``, which has each value of ``other`` at most once.

    A table of checked size is broadcast. A larger one is joined by a shuffle of
    the rows that aren't hot; keys with more than ``hot_rows`` rows are at most
    all rows over hot_rows, so that their entries are broadcast again, and rows
    without a key aren't shuffled at all.
    """
    on = F.col(key) == F.col(other)
    if is_bounded(table, rows):
        return df.join(F.broadcast(table), on, "left")
    hot = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = F.broadcast(hot.select("_hot"))
    is_hot = F.col(key) == F.col("_hot")
    few = F.broadcast(table.join(hot, F.col(other) == F.col("_hot"), "left_semi"))
    often = df.join(hot, is_hot, "left_semi").join(few, on, "left")
    seldom = df.where(F.col(key).isNotNull()).join(hot, is_hot, "left_anti").join(table, on, "left")
    none = df.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(t).alias(c) for c, t in table.dtypes))
    return often.unionByName(seldom).unionByName(none)
