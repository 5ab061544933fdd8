"""Mixed timestamp forms, zones and their estimation."""

import zoneinfo
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.operators import timestamps as ts

CONFIG = "source_id string, timezone string"


def us(*parts, minutes=0):
    return int((datetime(*parts, tzinfo=timezone.utc) - timedelta(minutes=minutes)).timestamp() * 1_000_000)


CASES = [
    ("2024-09-22T12:42:47Z", us(2024, 9, 22, 12, 42, 47)), ("2024-09-22T12:42:47", us(2024, 9, 22, 10, 42, 47)), ("  2024-09-22 12:42:47 Z\n", us(2024, 9, 22, 12, 42, 47)),
    ("2025-02-03t03:09:57z", us(2025, 2, 3, 3, 9, 57)), ("20230228T171821Z", us(2023, 2, 28, 17, 18, 21)), ("2023-08-18T16:58:22.942020123+05:30", us(2023, 8, 18, 11, 28, 22) + 942020),
    ("2022-01-12 10:47:12-0330", us(2022, 1, 12, 14, 17, 12)), ("2022-12-23T20:59+09", us(2022, 12, 23, 11, 59)), ("2022-11-28T02:56:18[Asia/Tokyo]", us(2022, 11, 27, 17, 56, 18)),
    ("Tue, 26 May 2026 09:34:40 GMT", us(2026, 5, 26, 9, 34, 40)), ("Saturday, 13-Aug-22 21:38:33 GMT", us(2022, 8, 13, 21, 38, 33)), ("Sat, 07 Jun 2025 17:19:30 EDT", us(2025, 6, 7, 21, 19, 30)),
    ("2022-08-16 14:24:23 +0200 CEST", us(2022, 8, 16, 12, 24, 23)), ("August 29, 2023 1:34 AM", us(2023, 8, 28, 23, 34)), ("Wednesday, April 17, 2024 at 12:47 PM", us(2024, 4, 17, 10, 47)),
    ("26. September 2025, 16:20 Uhr", us(2025, 9, 26, 14, 20)), ("28 août 2023 à 22h40", us(2023, 8, 28, 20, 40)), ("2025年6月26日 05:37", us(2025, 6, 26, 3, 37)), ("2022年8月14日 6時43分", us(2022, 8, 14, 4, 43)),
    ("21 April 2024", us(2024, 4, 20, 22)), ("03.05.2024", us(2024, 5, 2, 22)), ("21/07/2023 04:22", us(2023, 7, 21, 2, 22)), ("05/12/2023 04:22", us(2023, 12, 5, 3, 22)), ("2024/11/15 01:26", us(2024, 11, 15, 0, 26)),
    ("1725788116", 1725788116 * 10**6), ("1675278927207", 1675278927207 * 1000), ("1762058457566116", 1762058457566116), ("1681214314.587", 1681214314587000), ("1663890501993.0", 1663890501993000),
    # twice or never in Berlin, impossible, vague, too short a number, unknown zones
    ("2024-10-27T02:30:00", None), ("2024-03-31T02:30:00", None), ("2024-02-30", None), ("2025-13-04T08:00:00Z", None), ("2024-06-12T25:10:00Z", None), ("0000-00-00 00:00:00", None), ("2 days ago", None),
    ("spring 2024", None), ("Q3 2025", None), ("12345", None), ("", None), (None, None), ("2024-01-01T10:00:00 XYZ", None), ("2024-01-01T10:00:00[No/Zone]", None), ("x" * 100_000, None),
]


def test_forms(spark):
    rows = [(k, "Some_Source ", v) for k, (v, _) in enumerate(CASES)]
    rows = rows + [(len(rows), "some-source", "13/01/2024 10:00")]
    df = spark.createDataFrame(rows, "row_id long, source_id string, value string")
    config = spark.createDataFrame([("some-source", "Europe/Berlin")], CONFIG)
    parsed = ts.parse(df, "value", "source_id", None, ["row_id"])
    found = {r.row_id: r.utc_us for r in ts.to_instants(parsed, ts.known_zones(config, "source_id", "timezone"), ["row_id"]).collect()}
    for k, (value, expected) in enumerate(CASES):
        assert found.get(k) == expected, value


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    items = spark.createDataFrame([(1, "a", "2024-01-01", None, "x", 1), (1, "a", "2024-01-01", None, "x", 1), (2, None, "2024-01-01", None, "x", 1)], "row_id long, source_id string, published_at string, first_seen_at timestamp, local string, utc_us int")
    empty = spark.createDataFrame([], "row_id long, source_id string, cdate string, lastModified string")
    config = spark.createDataFrame([("a", "UTC"), ("b", "Nowhere/City"), (None, None)], CONFIG)
    found = sorted((r.tbl, r.row_id, r.utc_us) for r in ts.normalised(items, empty, empty, config).collect())
    assert found == [("items", 1, us(2024, 1, 1))] * 2  # repeated rows repeat, a source without a zone gives nothing
    assert ts.normalised(items.limit(0), empty, empty, config).count() == 0


ZONES = {"tokyo": "Asia/Tokyo", "york": "America/New_York", "utc": "UTC", "paris": "Europe/Paris", "kathmandu": "Asia/Kathmandu", "sydney": "Australia/Sydney", "lima": "America/Lima"}


def observed(days=55, zoned=False):
    """(row_id, source, local time, received): one value a day from 2025 on and source, received minutes later, one in seventy too early."""
    rows = []
    for day in range(days):
        for name, zone in ZONES.items():
            moment = datetime(2025, 1, 3, 12, tzinfo=timezone.utc) + timedelta(days=5 * day, minutes=37 * day % 1440)
            local = moment.astimezone(zoneinfo.ZoneInfo(zone))
            lag = timedelta(minutes=-30 if len(rows) % 71 == 7 else 4 + 11 * (len(rows) % 13))
            rows.append((len(rows), name, local.strftime("%Y-%m-%dT%H:%M:%S%z" if zoned else "%Y-%m-%dT%H:%M:%S"), moment + lag))
    return rows


def same_clock(a, b):
    days = [datetime(2025, m, d, 12) for m in range(1, 11) for d in (1, 15)]
    return all(zoneinfo.ZoneInfo(a).utcoffset(d) == zoneinfo.ZoneInfo(b).utcoffset(d) for d in days)


def test_missing_zone_is_estimated(spark):
    """Zones hidden from the operator are found again from the times of receipt, of all histories of offsets, though some rows violate the order."""
    schema = "row_id long, source_id string, value string, got timestamp"
    parsed = ts.parse(spark.createDataFrame(observed(), schema), "value", "source_id", "got", ["row_id"])
    known = ts.parse(spark.createDataFrame(observed(zoned=True), schema), "value", "source_id", "got", ["row_id"])
    profile = ts.lag_profile(ts.instants_named(ts.zoneless(known, ts.slash_order(known))))
    local = ts.zoneless(parsed, ts.slash_order(parsed))
    for given in (profile, ts.lag_profile(known.where("false").select("us", "received"))):
        best = {r.source: r.tz for r in ts.estimate_zones(local, ts.histories(), given).collect()}
        if given is profile:
            assert all(same_clock(best[s], z) for s, z in ZONES.items()), best
        assert best.keys() == ZONES.keys()
    assert ts.estimate_zones(local.limit(0), ts.histories(), profile).count() == 0


def test_found_without_any_configuration(spark):
    """A table without configured zones: every local time is placed by the estimate."""
    rows = observed()
    named = [(len(rows) + r, "zoned", v, got) for r, _, v, got in observed(zoned=True)]
    items = spark.createDataFrame([(r, s, v, got) for r, s, v, got in rows + named], "row_id long, source_id string, published_at string, first_seen_at timestamp")
    empty = spark.createDataFrame([], "row_id long, source_id string, cdate string, lastModified string")
    found = {r.row_id: r.utc_us for r in ts.normalised(items, empty, empty, spark.createDataFrame([], CONFIG)).collect()}
    for row, source, value, _ in rows:
        local = datetime.strptime(value, "%Y-%m-%dT%H:%M:%S").replace(tzinfo=zoneinfo.ZoneInfo(ZONES[source]))
        assert found[row] == int(local.timestamp()) * 10**6, (source, value)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.datetimes(datetime(1901, 1, 1), datetime(2199, 12, 31)), min_size=1, max_size=40))
def test_local_clock_against_python(spark, times):
    df = spark.createDataFrame([(t.year, t.month, t.day, t.hour, t.minute, t.second, t.microsecond) for t in times], "y int, mo int, d int, h int, mi int, s int, f long")
    found = [r[0] for r in df.select(ts.local_us(*[F.col(c) for c in df.columns])).collect()]
    assert found == [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times]


def test_day_month_order_needs_evidence(spark):
    df = spark.createDataFrame([(1, "us", "12/25/2024 10:00"), (2, "us", "01/02/2024 10:00"), (3, "none", "01/02/2024 10:00"), (4, "none", "05/05/2024 10:00")], "row_id long, source_id string, value string")
    config = spark.createDataFrame([("us", "UTC"), ("none", "UTC")], CONFIG)
    parsed = ts.parse(df, "value", "source_id", None, ["row_id"])
    found = {r.row_id: r.utc_us for r in ts.to_instants(parsed, ts.known_zones(config, "source_id", "timezone"), ["row_id"]).collect()}
    assert found == {1: us(2024, 12, 25, 10), 2: us(2024, 1, 2, 10), 4: us(2024, 5, 5, 10)}


pytestmark = pytest.mark.filterwarnings("ignore")
