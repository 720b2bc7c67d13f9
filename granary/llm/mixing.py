"""Mixing sources to target weights (problem 9).

Method: systematic sampling. Each document of a source gets the same expected
number of copies e (tokens wanted of the source over tokens it has); the
expected copies are prefix-summed within the source, one random offset u is
added, and a copy is emitted for each integer crossed:
copies = floor(before + e + u) - floor(before + u). A document so comes out
floor(e) or ceil(e) times. The prefix sums are cut into buckets
(``granary.operators.prefix``), ordered by size inside, which spreads the copies
evenly over short and long documents and keeps the token shares close.

The total is ``budget`` tokens, by default all tokens of the sources with a
target, so that a small source doesn't hold the others down. It is filled like
water: each source gives its share times one common level, but at most
max_repeats times what it has; the level is raised until the total is reached or
every source gives all it may. Where no source is at its cap the shares are the
targets; elsewhere the report shows target, share reachable at this total and
share given. With ``exact`` the total is cut to the largest at which every source
with documents has its share. Targets without documents can't be reached: their
share is spread over the others in proportion. Documents of sources without a
target, with a null source, or without tokens stay out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.prefix import prefix_sum


def plan(items: DataFrame, targets: DataFrame, budget: int | None = None, exact: bool = False) -> DataFrame:
    """(source, target_share, share, max_repeats, n_docs, tokens, planned, copies): what each source is to give.

    ``targets`` is a parameter table of some sources; windows run over its rows only.
    """
    have = items.where("source is not null and n_tokens > 0").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")
    )
    t = targets.where("target_share > 0 and max_repeats > 0").join(have, "source", "left")
    there = F.col("tokens").isNotNull()
    every = W.partitionBy()
    t = t.withColumn("share", F.when(there, F.col("target_share") / F.sum(F.when(there, F.col("target_share"))).over(every)).otherwise(0.0))
    t = t.withColumn("_cap", F.col("max_repeats") * F.col("tokens").cast("double")).withColumn("_level", F.col("_cap") / F.col("share"))
    size = F.lit(float(budget)) if budget is not None else F.sum("tokens").over(every).cast("double")
    size = F.least(size, F.min("_level").over(every)) if exact else size
    # sources in the order in which they reach their caps; before each the caps reached and the shares still open
    earlier = W.orderBy(F.col("_level").asc_nulls_last(), "source").rowsBetween(W.unboundedPreceding, -1)
    closed = F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    open_share = F.lit(1.0) - F.coalesce(F.sum("share").over(earlier), F.lit(0.0))
    t = t.withColumns({"_size": size, "_closed": closed, "_open": open_share})
    fills = there & (F.col("_closed") + F.col("_level") * F.col("_open") >= F.col("_size"))
    level = F.min(F.when(fills, F.struct("_level", F.try_divide(F.col("_size") - F.col("_closed"), F.col("_open")).alias("at")))).over(every)["at"]
    planned = F.when(there, F.coalesce(F.least(F.col("_cap"), F.col("share") * level), F.col("_cap")))
    t = t.withColumn("planned", F.coalesce(planned, F.lit(0.0)))
    copies = F.least(F.col("planned") / F.col("tokens"), F.col("max_repeats").cast("double"))
    return t.withColumn("copies", F.coalesce(copies, F.lit(0.0))).drop("_cap", "_level", "_size", "_closed", "_open")


def mix(items: DataFrame, targets: DataFrame, budget: int | None = None, exact: bool = False, seed: int = 11) -> DataFrame:
    """(source, doc, copy_no, n_tokens) of ``items(doc, source, n_tokens)`` for ``targets(source, target_share, max_repeats)``."""
    p = plan(items, targets, budget, exact).where("copies > 0").select(F.col("source").alias("p_source"), "copies", "max_repeats")
    some = items.where("n_tokens > 0").dropDuplicates(["doc"])
    some = some.join(p, F.col("source") == F.col("p_source")).drop("p_source")
    ranked = prefix_sum(some, ["source"], "doc", F.lit(1), "rank", order=["n_tokens"], seed=seed)
    u = F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    crossed = F.floor((F.col("rank") + 1) * F.col("copies") + u) - F.floor(F.col("rank") * F.col("copies") + u)
    n = F.least(crossed, F.col("max_repeats")).cast("int")
    return ranked.withColumn("n", n).where("n > 0").select(
        "source", "doc", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"), "n_tokens"
    )


def shares(items: DataFrame, targets: DataFrame, mixed: DataFrame, budget: int | None = None, exact: bool = False) -> DataFrame:
    """The report: for each target the tokens and documents it has and gave, target, reachable and actual share, most copies."""
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("given_tokens"), F.count("*").alias("given_copies"), F.max("copy_no").alias("most_copies")
    )
    zero = F.lit(0).cast("long")
    every = W.partitionBy()  # the targets' rows
    of_all = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0))
    return plan(items, targets, budget, exact).join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("n_docs", zero).alias("n_docs"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("given_tokens", zero).alias("given_tokens"),
        F.coalesce("given_copies", zero).alias("given_copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        of_all("planned").alias("reachable_share"), of_all("given_tokens").alias("actual_share"),
    )
