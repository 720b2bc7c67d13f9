"""Filling fixed-capacity containers with items (problem 8).

Method: mixture-controlled packing. Each source is a queue in a fixed
pseudo-random order. Deficit round-robin serves the queues in rounds, each by its
target proportion, and fills windows of ``window_tokens``; an item is served in
the round in which the queue's served tokens first fall short of its quanta, and
what it takes too much or too little is carried on to the next window. A queue
that is used up leaves the round, and the others take its part in proportion, so
that windows stay full.

In closed form: an item with b tokens before it in a queue of proportion w and T
tokens is served at level L = b / w, when all queues have given
G(L) = sum of min(w' L, T') tokens; its window is floor(G(L) / window). As the
prefix sums b run over all partitions, so does the carry. Within a window
(bounded by its tokens) items go best-fit decreasing into containers.

Without ``targets`` the proportions are those of the items themselves, so that
all queues end together (G(L) = L) and every window has the corpus's mixture. With
``targets`` the sources without a target form one queue that keeps the share it
has of all tokens; the targets share the rest in proportion. A target without
items has no queue.

Every item is assigned exactly once. An item larger than the capacity is cut
into full containers and one rest, which is packed like an item; no other item
is cut. Empty texts take no room; they are spread over the windows (over more
than there are if a window would get more than EMPTY_ITEMS). Null texts aren't
items. Null sources form a queue of their own, or are without a target.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.prefix import prefix_sum

WINDOW_TOKENS = 1 << 20
EMPTY_ITEMS = 50_000
SCHEMA = "max_size long, container string, slot int, doc long, piece_no int, token_start long, n_tokens long"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item: the fullest that still takes it, items by falling size.

    A bit set over free room finds it: the lowest set bit at or above the size.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    room: dict[int, list[int]] = {}
    free, made, out = 0, 0, [0] * len(sizes)
    for i in order:
        s = sizes[i]
        fits = free >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            c = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
        else:
            r, c, made = capacity, made, made + 1
        out[i] = c
        room.setdefault(r - s, []).append(c)
        free |= 1 << (r - s)
    return out


def _pack(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["n_tokens", "doc", "piece_no"], ascending=[False, True, True])
    cap, window = int(g["max_size"].iloc[0]), int(g["window"].iloc[0])
    c = pd.Series(best_fit_decreasing([int(x) for x in g["n_tokens"]], cap), index=g.index)
    g = g.assign(container=f"{cap}-{window}-" + c.astype(str))
    g["slot"] = (g.groupby("container").cumcount() + 1).astype("int32")
    return g[["max_size", "container", "slot", "doc", "piece_no", "token_start", "n_tokens"]]


def pack(
    items: DataFrame, capacities: DataFrame, targets: DataFrame | None = None, window_tokens: int = WINDOW_TOKENS
) -> DataFrame:
    """Containers of each capacity for ``items(doc, source, n_tokens)``.

    ``capacities(max_size)`` and the optional ``targets(source, target_share)`` are parameter tables of some rows.
    """
    caps = capacities.select(F.col("max_size").cast("long").alias("max_size")).where("max_size > 0").distinct()
    each = items.dropDuplicates(["doc"]).crossJoin(F.broadcast(caps))  # caps: a parameter table of a few rows
    whole = F.col("n_tokens") <= F.col("max_size")
    full = F.expr("n_tokens div max_size")
    cut = each.where(~whole).select(
        "max_size", "doc", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("k")
    ).select(
        "max_size", F.format_string("%d-d%d-%d", "max_size", "doc", "k").alias("container"), F.lit(1).alias("slot"), "doc",
        F.col("k").cast("int").alias("piece_no"), (F.col("k") * F.col("max_size")).alias("token_start"),
        F.col("max_size").alias("n_tokens"),
    )
    rest = each.where(whole | (F.col("n_tokens") % F.col("max_size") > 0)).select(
        "max_size", "doc", "source",
        F.when(whole, 0).otherwise(full).cast("int").alias("piece_no"),
        F.when(whole, F.lit(0)).otherwise(full * F.col("max_size")).cast("long").alias("token_start"),
        F.when(whole, F.col("n_tokens")).otherwise(F.col("n_tokens") % F.col("max_size")).alias("n_tokens"),
    )
    if targets is None:
        rest = rest.withColumn("queue", F.col("source"))
        aim = None
    else:
        aim = targets.where("target_share > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("aim"))
        named = F.broadcast(aim.select(F.col("source").alias("queue")))  # targets: a parameter table
        rest = rest.join(named, F.col("source") == F.col("queue"), "left")
    some, empty = rest.where("n_tokens > 0"), rest.where("n_tokens = 0")
    queue = ["max_size", "queue"]
    ahead = prefix_sum(some, queue, "doc", F.col("n_tokens"), "before")
    every = W.partitionBy("max_size")  # the queues of a size
    q = some.groupBy(*queue).agg(F.sum("n_tokens").alias("queue_tokens"))
    if aim is None:
        overall = q.groupBy("max_size").agg(F.sum("queue_tokens").alias("all_tokens"))
        q = q.join(overall, "max_size").withColumn("weight", F.col("queue_tokens") / F.col("all_tokens"))
    else:  # at most as many queues as targets, and one
        q = q.join(aim.withColumnRenamed("source", "queue"), "queue", "left").withColumn("all_tokens", F.sum("queue_tokens").over(every))
        others = F.coalesce(F.sum(F.when(F.col("aim").isNull(), F.col("queue_tokens"))).over(every), F.lit(0)) / F.col("all_tokens")
        aimed = F.col("aim") / F.sum("aim").over(every) * (1 - others)
        q = q.withColumn("weight", F.coalesce(aimed, others))
        q = q.withColumn("queues", F.collect_list(F.struct("weight", "queue_tokens")).over(every))
    width = F.col("all_tokens") / F.greatest(F.lit(1), F.round(F.col("all_tokens") / window_tokens))
    q = q.select(F.col("max_size").alias("q_size"), F.col("queue").alias("q_queue"), "weight", width.alias("width"), *(["queues"] if aim is not None else []))
    level = F.col("before") / F.col("weight")
    if aim is not None:
        level = F.aggregate("queues", F.lit(0.0), lambda n, x: n + F.least(x["weight"] * F.col("before") / F.col("weight"), x["queue_tokens"].cast("double")))
    columns = ["max_size", "window", "doc", "piece_no", "token_start", "n_tokens"]
    served = ahead.join(q, (F.col("max_size") == F.col("q_size")) & F.col("queue").eqNullSafe(F.col("q_queue"))).withColumn(
        "window", F.floor(level / F.col("width"))).select(*columns)
    sizes = empty.groupBy(F.col("max_size").alias("e_size")).agg(F.count("*").alias("n_empty"))
    windows = some.groupBy(F.col("max_size").alias("w_size")).agg(F.greatest(F.lit(1), F.round(F.sum("n_tokens") / window_tokens)).cast("long").alias("n_windows"))
    sizes = sizes.join(windows, F.col("e_size") == F.col("w_size"), "left").select(
        "e_size", F.greatest(F.coalesce("n_windows", F.lit(1)), F.ceil(F.col("n_empty") / EMPTY_ITEMS)).alias("n_windows"))
    spread = empty.join(F.broadcast(sizes), F.col("max_size") == F.col("e_size")).withColumn(  # a row for each capacity
        "window", F.pmod(F.xxhash64("doc"), F.col("n_windows"))).select(*columns)
    return cut.unionByName(served.unionByName(spread).groupBy("max_size", "window").applyInPandas(_pack, SCHEMA))


def window_shares(packed: DataFrame, items: DataFrame, targets: DataFrame) -> DataFrame:
    """(max_size, window, source, target_share, tokens, share): the mixture of each window; sources without a target are null.

    Items that were cut at the capacity fill containers of their own and belong to no window.
    """
    of = F.split("container", "-")
    p = packed.where(~of[1].startswith("d")).select("max_size", of[1].cast("long").alias("window"), "doc", "n_tokens")
    aim = F.broadcast(targets.select("source", "target_share").dropDuplicates(["source"]))  # targets: a parameter table
    p = p.join(items.select("doc", "source").dropDuplicates(["doc"]), "doc").join(aim, "source", "left")
    got = p.groupBy("max_size", "window", F.when(F.col("target_share").isNotNull(), F.col("source")).alias("source"), "target_share").agg(
        F.sum("n_tokens").alias("tokens"))
    whole = F.sum("tokens").over(W.partitionBy("max_size", "window"))  # a window's sources: the targets and null
    return got.select("*", F.round(F.try_divide(F.col("tokens"), whole), 6).alias("share"))


def fill_report(packed: DataFrame) -> DataFrame:
    """(max_size, containers, items, tokens, fill): how full the containers of each size are."""
    per = packed.groupBy("max_size", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    return per.groupBy("max_size").agg(
        F.count("*").alias("containers"), F.sum("n").alias("items"), F.sum("t").alias("tokens"),
        F.max("t").alias("largest"),
    ).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("max_size")), 6))
