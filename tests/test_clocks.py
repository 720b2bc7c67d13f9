"""Timestamps: every format, the clock's gaps and repetitions, zones declared and estimated."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from granary.operators import clocks
from granary.plans import cleaning

ZONES = ["Europe/Paris", "America/New_York", "Europe/London", "Asia/Kolkata"]
CASES = [  # value, source, day order, instant or None
    ("2023-01-06T22:46:42.225417", "paris", "DMY", "2023-01-06T21:46:42.225417Z"),
    ("2023-06-24T22:10:03+00:00", None, None, "2023-06-24T22:10:03.000000Z"),
    ("1707896146", None, None, "2024-02-14T07:35:46.000000Z"),
    (" 1652588935187 ", "paris", "DMY", "2022-05-15T04:28:55.187000Z"),
    ("2021-08-22t06:01:45z", None, None, "2021-08-22T06:01:45.000000Z"),
    ("20240808T201138-0400", "paris", "DMY", "2024-08-09T00:11:38.000000Z"),
    ("D:20221207043816+05'30'", None, None, "2022-12-06T23:08:16.000000Z"),
    ("D:20220821180454Z", None, None, "2022-08-21T18:04:54.000000Z"),
    ("2025/01/01 03:51 UTC+5:30", "paris", "DMY", "2024-12-31T22:21:00.000000Z"),
    ("2021-09-08T15:43:15+02:00[Europe/Paris]", None, None, "2021-09-08T13:43:15.000000Z"),
    ("21/10/2024 11h28", "paris", "DMY", "2024-10-21T09:28:00.000000Z"),
    ("07/16/2021 1:09 PM", "york", "MDY", "2021-07-16T17:09:00.000000Z"),
    ("11/05/22 05:41", "paris", "DMY", "2022-05-11T03:41:00.000000Z"),
    ("le 26 octobre 2024 à 2h27", "paris", "DMY", "2024-10-26T00:27:00.000000Z"),
    ("Publié le 1er mars 2022, 7:49", "paris", "DMY", "2022-03-01T06:49:00.000000Z"),
    ("May 1, 2025 at 4:56 a.m.", "york", "MDY", "2025-05-01T08:56:00.000000Z"),
    ("Sun, 31 Oct 2021 02:53:04 +0100", None, None, "2021-10-31T01:53:04.000000Z"),
    ("Wed, 10 Apr 2024 10:05:14 GMT", None, None, "2024-04-10T10:05:14.000000Z"),
    ("2023-06-06 22:45:08 CEST", "paris", "DMY", "2023-06-06T20:45:08.000000Z"),
    ("2022-11-27 01:13:44 IST", "delhi", "DMY", "2022-11-26T19:43:44.000000Z"),
    ("2022-11-27 01:13:44 IST", None, None, None),  # whose abbreviation?
    ("2023-10-29 02:30:00 CET", "paris", "DMY", "2023-10-29T01:30:00.000000Z"),  # told apart by its name
    ("2023-10-29 02:30:00", "paris", "DMY", None),  # shown twice
    ("2023-03-26 02:30:00", "paris", "DMY", None),  # never shown
    ("2022-03-27T01:23:19", "london", "DMY", None),
    ("2021-04-19", "paris", "DMY", None),
    ("21 décembre 2022", "paris", "DMY", None),
    ("2023-13-05 08:00", "paris", "DMY", None),
    ("2024-02-30T10:00:00Z", None, None, None),
    ("0000-00-00 00:00:00", "paris", "DMY", None),
    ("07/16/2021 10:00", "paris", "DMY", None),  # no sixteenth month
    ("2024-01-01T25:00:00Z", None, None, None),
    ("hier", "paris", "DMY", None),
    ("il y a 3 heures", "paris", "DMY", None),
    ("25:71", "paris", "DMY", None),
    ("", "paris", "DMY", None),
    (None, "paris", "DMY", None),
    ("2023-01-06T22:46:42", None, None, None),
]
DECLARED = [("paris", "Europe/Paris"), ("york", "America/New_York"), ("london", "Europe/London"), ("delhi", "Asia/Kolkata")]


def normalised(spark, rows, declared):
    v = spark.createDataFrame(rows, "page long, field string, source string, day_order string, value string")
    d = spark.createDataFrame(declared, "source string, zone string")
    c = spark.createDataFrame([(z,) for z in ZONES], "zone string")
    s = spark.createDataFrame(clocks.abbreviations(ZONES), "zone string, name string, offset long")
    r = clocks.read(v)
    h = clocks.zone_histories(clocks.zone_violations(r, d, c, "scraped_at"))
    out = clocks.normalise(r, h, s)
    return h, out.select("page", "field", clocks.utc_text(out["utc_micros"]).alias("utc"), "basis")


def test_formats(spark):
    rows = [(i, "date_published", s, o, v) for i, (v, s, o, _) in enumerate(CASES)]
    rows += [(1000 + i, "date_published", s, "DMY", "2023-01-02T03:04:05") for i, (s, _) in enumerate(DECLARED)]
    _, out = normalised(spark, rows + rows[:5], DECLARED)
    got = {r.page: r.utc for r in out.collect() if r.page < 1000}
    for i, (value, *_, want) in enumerate(CASES):
        assert got.get(i) == want, value


def test_zone_is_estimated_from_ingestion_and_offsets(spark):
    rows = []
    for i in range(30):
        day = f"2023-07-{i % 28 + 1:02d}"
        rows += [(i, "date_published", "new", "DMY", f"{day}T15:{i:02d}:00"), (i, "scraped_at", "bot", None, f"{day}T10:00:00Z"),
                 (i, "date_modified", "new", "DMY", f"{day}T15:30:00+05:30")]
    h, out = normalised(spark, rows, DECLARED)
    got = {r.source: r for r in h.collect()}
    assert got["new"].zone == "Asia/Kolkata" and not got["new"].declared and got["new"].violations == 0
    one = [r for r in out.collect() if r.page == 0 and r.field == "date_published"][0]
    assert one.utc == "2023-07-01T09:30:00.000000Z" and one.basis == "estimated"


def test_ingestion_on_a_declared_clock_is_evidence(spark):
    # scraped 09:45 UTC; only India's clock shows 15:00 before that
    rows = [x for i in range(1, 20) for x in (
        (i, "date_published", "new", "DMY", f"2023-07-{i:02d}T15:00:00"), (i, "scraped_at", "paris", "DMY", f"2023-07-{i:02d}T11:45:00"))]
    h, out = normalised(spark, rows, DECLARED)
    new = {r.source: r for r in h.collect()}["new"]
    assert (new.zone, new.violations, new.tied) == ("Asia/Kolkata", 0, False)


@pytest.mark.parametrize("published, modified", [
    ("2023-07-{:02d}T15:00:00", "2023-07-{:02d}T09:45:00Z"), ("2023-07-{:02d}T15:00:00Z", "2023-07-{:02d}T12:00:00")])
def test_publication_is_not_after_modification(spark, published, modified):
    rows = [x for i in range(1, 20) for x in (
        (i, "date_published", "new", "DMY", published.format(i)), (i, "date_modified", "new", "DMY", modified.format(i)))]
    v = spark.createDataFrame(rows, "page long, field string, source string, day_order string, value string")
    d = spark.createDataFrame([], "source string, zone string")
    c = spark.createDataFrame([(z,) for z in ("America/New_York", "Asia/Kolkata")], "zone string")
    got = {r.zone: r.violations for r in clocks.zone_violations(clocks.read(v), d, c, "scraped_at").collect()}
    by_order = 19  # and as many explicit offsets of zero, which neither clock has
    wrong = "America/New_York" if modified.endswith("Z") else "Asia/Kolkata"
    right = ({*got} - {wrong}).pop()
    assert got[wrong] - got[right] == by_order


def test_ties_are_marked(spark):
    v = [(1, "date_published", "new", "DMY", "2023-07-02T15:00:00"), (2, "date_published", "paris", "DMY", "2023-07-02T15:00:00")]
    v = spark.createDataFrame(v, "page long, field string, source string, day_order string, value string")
    d = spark.createDataFrame(DECLARED, "source string, zone string")
    c, s = d.select("zone"), spark.createDataFrame(clocks.abbreviations(ZONES), "zone string, name string, offset long")
    r = clocks.read(v)
    out = clocks.normalise(r, clocks.zone_histories(clocks.zone_violations(r, d, c, "scraped_at", s)), s)
    assert {(x.page, x.basis, x.tied) for x in out.collect()} == {(1, "estimated", True), (2, "declared", False)}


@pytest.mark.parametrize("rows", [[]])
def test_empty(spark, rows):
    h, out = normalised(spark, rows, DECLARED)
    assert h.count() == 0 and out.count() == 0


def test_accuracy_without_declared_zones(spark):
    """Sites without a declared zone: the estimate reads nearly all values as the true clock does, or is marked as tied."""
    rnd = random.Random(3)
    truth = {f"s{i}": z for i, z in enumerate(("Europe/Paris", "America/New_York", "Asia/Kolkata", "Africa/Abidjan", "Australia/Sydney", "America/Sao_Paulo"))}
    rows, want, page = [], {}, 0
    for source, zone in truth.items():
        tz = ZoneInfo(zone)
        for _ in range(300):
            page += 1
            t = dt.datetime(2019, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=rnd.randrange(4 * 365 * 1440))
            local = t.astimezone(tz)
            with_offset = rnd.random() < 0.05
            rows.append((page, "date_published", source, None, local.isoformat(timespec="seconds") if with_offset else local.strftime("%Y-%m-%dT%H:%M:%S")))
            rows.append((page, "scraped_at", "bot", None, (t + dt.timedelta(minutes=rnd.randrange(1, 3000))).strftime("%Y-%m-%dT%H:%M:%SZ")))
            if not with_offset:
                want[page] = t.strftime("%Y-%m-%dT%H:%M:%S.000000Z")
    v = spark.createDataFrame(rows, "page long, field string, source string, day_order string, value string")
    zones = clocks.offset_histories([])
    assert 100 < len(zones) < 600
    c, d = spark.createDataFrame([(z,) for z in zones], "zone string"), spark.createDataFrame([], "source string, zone string")
    s = spark.createDataFrame(clocks.abbreviations(zones), "zone string, name string, offset long")
    r = clocks.read(v)
    h = clocks.zone_histories(clocks.zone_violations(r, d, c, "scraped_at", s))
    out = clocks.normalise(r, h, s).where("field = 'date_published' and basis = 'estimated'")
    got = {x.page: x.utc for x in out.select("page", clocks.utc_text(out["utc_micros"]).alias("utc")).collect()}
    right = sum(got.get(p) == u for p, u in want.items())
    print("right", right, "of", len(want), {x.source: (x.zone, x.tied) for x in h.collect()})
    assert right >= 0.97 * len(want)


def test_found_chooses_a_history_for_every_source(spark, tmp_path, monkeypatch):
    """p4_found runs the whole method; its rows are the normalised ones that aren't estimates."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("sites", [("paris.example", "Europe/Paris", "DMY"), ("odd.example", "Nowhere/Land", "DMY")], "host string, tz string, day_order string")
    write("scrapers", [("bot", "UTC")], "scraper_id string, tz string")
    rows = []
    for i in range(28):
        day = f"2023-07-{i + 1:02d}"
        rows += [(i, f"https://{h}/p", "bot", f"{day} 10:00:00", f"{day} 15:{i:02d}:00", f"{day}T15:30:00+05:30") for h in ("new.example", "odd.example")]
        rows.append((100 + i, "https://www.paris.example/p", "bot", f"{day} 10:00:00", f"{day} 11:{i:02d}:00", None))
    rows.append((200, None, None, "2023-07-01 10:00:00", "2023-07-01 09:00:00", "2023-07-01T09:00:00Z"))
    write("web_articles", rows, "page_id long, url string, scraper_id string, scraped_at string, date_published string, date_modified string")

    used, normalise = {}, clocks.normalise

    def spy(r, histories, short):
        used.update({h.source: h for h in histories.collect()})
        return normalise(r, histories, short)

    monkeypatch.setattr(clocks, "normalise", spy)
    got = {tuple(r) for r in cleaning.p4_found(spark, str(tmp_path)).collect()}
    assert {k: (h.declared, h.violations) for k, h in used.items()} == {
        "site:new.example": (False, 0), "site:odd.example": (False, 0), "site:paris.example": (True, 0), "scraper:bot": (True, 0)}
    for k in ("site:new.example", "site:odd.example"):  # only an offset of 5:30 has no violations
        assert dt.datetime(2023, 7, 1, tzinfo=ZoneInfo(used[k].zone)).utcoffset() == dt.timedelta(hours=5, minutes=30)
    every = cleaning.p4_normalised(spark, str(tmp_path)).collect()
    assert got == {(r.page_id, r.field_name, r.utc) for r in every if r.basis != "estimated"}
    assert {r.basis for r in every} == {"explicit", "declared", "estimated"} and (200, "date_modified", "2023-07-01T09:00:00.000000Z") in got
    assert (100, "date_published", "2023-07-01T09:00:00.000000Z") in got and not [x for x in got if x[0] < 100 and x[1] == "date_published"]
