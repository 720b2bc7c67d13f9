"""Mixed timestamp formats and time zones to one form (problem 4).

A value is read into clock time and zone (``granary.functions.timestamps``). An
explicit offset gives the instant at once. Otherwise the source's zone, that is
its offset history, is needed. It is chosen among candidates by counting
violations: an explicit offset of the source that the history doesn't have at
that instant; a clock time that the history never shows; a value that would lie
after its page's ingestion; a publication that would lie after the
modification. A declared zone is the only candidate of its source; a source
without one gets the history with the fewest violations, marked ``estimated``
and, where the runner-up has as few, ``tied``.

A clock time that the history shows twice or never names no instant. A zone
abbreviation is one of the source's own clock and must be in force then.

Counts are aggregated by (source, zone) with map-side combine, so a hot source
costs no more than others. Null values, dates without a time of day, and text
that isn't a date give no row. Equal rows count once.
"""

from __future__ import annotations

import datetime as dt
import functools
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions import timestamps as T
from granary.operators.relational import lookup

DAY = 86_400_000_000


@functools.lru_cache(maxsize=8)
def _shown_over_years(zones: tuple[str, ...], first: int, last: int) -> dict[str, list[tuple[int, str]]]:
    """(offset in microseconds, abbreviation) of each zone every 20 days."""
    days = [dt.datetime(first, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=20 * i) for i in range((last - first + 1) * 365 // 20)]
    out = {}
    for z in zones:
        tz = ZoneInfo(z)
        local = [t.astimezone(tz) for t in days]
        out[z] = [(int(x.utcoffset().total_seconds()) * 1_000_000, x.tzname() or "") for x in local]
    return out


def abbreviations(zones: list[str], first: int = 1990, last: int = 2037) -> list[tuple[str, str, int]]:
    """(zone, abbreviation, offset in microseconds) of each zone's clock over the years."""
    seen = _shown_over_years(tuple(sorted(set(zones))), first, last)
    return sorted({(z, name.lower(), offset) for z, x in seen.items() for offset, name in x if name.isalpha()})


def all_zones() -> list[str]:
    """The names of all zones that are places: some hundreds."""
    return sorted(z for z in available_timezones() if "/" in z and z.split("/")[0] not in ("Etc", "SystemV", "posix", "right", "US"))


def offset_histories(preferred: list[str], first: int = 2000, last: int = 2037) -> list[str]:
    """One zone for each distinct history of offsets over the years, one of ``preferred`` if it has that history."""
    zones = sorted({*all_zones(), *preferred})
    seen = _shown_over_years(tuple(zones), first, last)
    out: dict[tuple[int, ...], str] = {}
    for z in [*sorted(preferred), *zones]:
        out.setdefault(tuple(o for o, _ in seen[z]), z)
    return sorted(out.values())


def shown(utc: Column, zone: Column) -> Column:
    """The clock time (microseconds) that a zone shows at an instant (microseconds)."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))


def instants(local: Column, zone: Column) -> tuple[Column, Column]:
    """The two readings of a clock time in a zone, by the offsets in force a day before and after; null if not shown."""
    readings = []
    for side in (-1, 1):
        near = local + side * DAY
        utc = local - (shown(near, zone) - near)
        readings.append(F.when(shown(utc, zone) == local, utc))
    return readings[0], readings[1]


def only_instant(local: Column, zone: Column) -> Column:
    """The instant of a clock time that the zone shows exactly once, else null."""
    a, b = instants(local, zone)
    return F.when(a.isNull(), b).when(b.isNull() | (a == b), a)


def read(values: DataFrame) -> DataFrame:
    """``values(page, field, source, day_order, value)`` with local, offset, named and instant where explicit."""
    v = values.where("value is not null").withColumn("_p", T.parts(F.col("value")))
    v = v.withColumn("local", T.local_micros(F.col("_p"), F.col("day_order")))
    v = v.withColumn("_zone", F.coalesce(F.col("_p")[8], F.lit("")))
    v = v.withColumn("offset", T.offset_micros(F.col("_zone")))
    v = v.withColumn("named", F.when(F.col("offset").isNull() & (F.col("_zone") != ""), F.col("_zone")))
    epoch = T.epoch_micros(F.col("value"))
    return v.withColumn("instant", F.coalesce(epoch, F.col("local") - F.col("offset"))).drop("_p", "_zone")


def resolved(zone: Column, short_offset: Column) -> Column:
    """The instant of a row of read() on a zone's clock; ``short_offset`` is that of its named abbreviation there."""
    by_name = F.col("local") - short_offset
    by_name = F.when(shown(by_name, zone) == F.col("local"), by_name)
    return F.coalesce("instant", F.when(F.col("named").isNotNull(), by_name).otherwise(only_instant(F.col("local"), zone)))


def zone_violations(
    r: DataFrame, declared: DataFrame, candidates: DataFrame, ingestion: str, short: DataFrame | None = None,
    order: tuple[str, str] = ("date_published", "date_modified"),
) -> DataFrame:
    """(source, zone, declared, seen, violations) of each source and candidate zone.

    ``r`` is the result of read(); ``declared(source, zone)``; ``candidates(zone)``
    names of zones; ``ingestion`` names the field that bounds the others, by explicit
    instants and by the declared clocks of its sources (``short`` as for
    normalise()); ``order`` two fields of which the first isn't after the second.
    """
    have = declared.select(F.col("source").alias("d_source"), F.col("zone").alias("d_zone"))
    x = lookup(r, have, "source", "d_source")
    short_offset = F.lit(None).cast("long")
    if short is not None:
        s = short.select(F.col("zone").alias("s_zone"), F.col("name").alias("s_name"), F.col("offset").alias("s_offset"))
        x = x.join(F.broadcast(s), (F.col("d_zone") == F.col("s_zone")) & (F.col("named") == F.col("s_name")), "left")  # a name of two offsets gives two rows, for the maximum only
        short_offset = F.col("s_offset")
    whole = W.partitionBy("page")  # a page's few values
    known = resolved(F.col("d_zone"), short_offset)
    first, second = (F.col("field") == f for f in order)
    plain = F.col("instant").isNull() & F.col("named").isNull()
    x = x.select(
        "*", F.max(F.when(F.col("field") == ingestion, known)).over(whole).alias("_ingested"),
        F.max(F.when(second, F.col("instant"))).over(whole).alias("_second"),
        F.max(F.when(second & plain, F.col("local"))).over(whole).alias("_second_local"),
        F.min(F.when(first, F.col("instant"))).over(whole).alias("_first"),
    ).where("source is not null and local is not null and named is null")
    x = x.withColumns({
        "_second": F.when(first, F.col("_second")), "_first": F.when(second, F.col("_first")),
        # a pair of clock times counts once, at its first field
        "_second_local": F.when(first & F.col("_second").isNull(), F.col("_second_local")),
    })
    # equal readings of a source give equal violations: combined before candidates are tried
    slot = ["source", "d_zone", "local", "offset", "instant", "field", "_ingested", "_first", "_second", "_second_local"]
    x = x.groupBy(*slot).agg(F.count("*").alias("n"))
    # only sources without a declared zone try the candidates, a table of at most as many rows as there are zones
    tried = x.where("d_zone is null").crossJoin(F.broadcast(candidates.select("zone").distinct()))
    x = x.where("d_zone is not null").withColumn("zone", F.col("d_zone")).unionByName(tried)
    a, b = instants(F.col("local"), F.col("zone"))
    early, latest = F.least(a, b), F.greatest(a, b)
    second_latest = F.coalesce("_second", F.greatest(*instants(F.col("_second_local"), F.col("zone"))))
    late = (F.col("field") != ingestion) & (early > F.col("_ingested"))
    crossed = F.coalesce(early > second_latest, F.lit(False)) | F.coalesce(latest < F.col("_first"), F.lit(False))
    wrong = F.when(F.col("offset").isNotNull(), shown(F.col("instant"), F.col("zone")) != F.col("local")).otherwise(
        (a.isNull() & b.isNull()) | F.coalesce(late, F.lit(False)) | crossed
    )
    return x.groupBy("source", "zone", F.col("d_zone").isNotNull().alias("declared")).agg(
        F.sum("n").alias("seen"), F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("violations")
    )


def zone_histories(violations: DataFrame) -> DataFrame:
    """(source, zone, declared, seen, violations, tied): the candidate with the fewest violations."""
    by = W.partitionBy("source").orderBy("violations", "zone")  # a few candidates per source
    v = violations.select("*", F.row_number().over(by).alias("_rank"), F.lead("violations").over(by).alias("_next"))
    return v.where("_rank = 1").select(
        "source", "zone", "declared", "seen", "violations", F.coalesce(F.col("_next") == F.col("violations"), F.lit(False)).alias("tied")
    )


def normalise(r: DataFrame, histories: DataFrame, short: DataFrame) -> DataFrame:
    """(page, field, value, utc_micros, basis, tied) of each value that names one instant.

    basis is ``explicit``, ``declared`` or ``estimated``; an estimated value is
    ``tied`` where another zone is as likely, so that its instant is a guess; ``short(zone, name, offset)``
    are the abbreviations of the zones' clocks, a table bounded by the number of zones.
    """
    h = histories.select(*(F.col(c).alias(f"h_{c}") for c in ("source", "zone", "declared", "tied")))
    s = short.select(F.col("zone").alias("s_zone"), F.col("name").alias("s_name"), F.col("offset").alias("s_offset"))
    x = lookup(r, h, "source", "h_source")  # one row per source; there may be many sources
    x = x.join(F.broadcast(s), (F.col("h_zone") == F.col("s_zone")) & (F.col("named") == F.col("s_name")), "left")
    utc = resolved(F.col("h_zone"), F.col("s_offset"))
    basis = F.when(F.col("instant").isNotNull(), "explicit").when(F.col("h_declared"), "declared").otherwise("estimated")
    tied = (basis == "estimated") & F.coalesce("h_tied", F.lit(False))
    return x.select("page", "field", "value", utc.alias("utc_micros"), basis.alias("basis"), tied.alias("tied")).where("utc_micros is not null").distinct()


def utc_text(micros: Column) -> Column:
    """An instant as yyyy-MM-ddTHH:mm:ss.SSSSSSZ; the session's zone is UTC."""
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
