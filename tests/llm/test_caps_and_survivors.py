"""Contributor caps against a plain sort, survivorship against hand-made groups."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewright.llm import contributor_caps as cc
from tidewright.llm import survivorship

SCHEMA = "k string, v double, i long, cut string, last int"


def brute(rows, cap):
    gone, groups = set(), {}
    for k, v, i, *_ in rows:
        if k is not None:
            groups.setdefault(k, []).append((v is None or v != v, -(v if v is not None and v == v else 0.0), i))
    for k, found in groups.items():
        gone |= {(k, i) for _, _, i in sorted(found)[cap:]}
    return gone


def found(spark, rows, cap, midpoints=16):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.k, r.i) for r in cc.over_cap(df, F.col("k"), F.col("v"), F.col("i"), cap, midpoints).collect()}


def test_bisection_equals_sort(spark):
    rng = random.Random(4)
    values = [None, float("nan"), 0.0, -0.0, 1.5, 1.5, 1.5, 7.25, -3.0, 1e308, -1e308, 5e-324]
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([*values, rng.random()]), i, "x", 1) for i in range(400)]
    for cap in (0, 1, 7, 60, 1000):
        assert found(spark, rows, cap) == brute(rows, cap), cap


def test_all_tied_and_all_null(spark):
    rows = [("t", 2.0, i, None, None) for i in range(100)] + [("n", None, i, None, None) for i in range(200, 260)]
    assert found(spark, rows, 10) == brute(rows, 10)


def test_repeated_rows_go_together_and_empty_tables(spark):
    rows = [("a", 1.0, 5, None, None)] * 3 + [("a", 2.0, 1, None, None)]
    assert found(spark, rows, 2) == {("a", 5)}  # the three can't be told apart and don't all fit
    assert found(spark, [], 3) == set()


def test_two_caps(spark):
    items = spark.createDataFrame([("a", 9.0 - i, i, None, None) for i in range(5)] + [("b", 1.0, 10, None, None), ("c", 0.5, 11, None, None)], SCHEMA)
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", None)], "k string, g string")
    got = {(r.row_id, r.cap) for r in cc.over_two_caps(items, F.col("k"), groups, F.col("v"), F.col("i"), 3, 3).collect()}
    assert got == {(3, "source"), (4, "source"), (10, "category")}


LINK = "struct<url:string,link_type:string,source_id:string,tier:int,title:string>"
STORY = f"row_id long, digest_date date, story_id string, title string, primary_link {LINK}, published_at timestamp, n int"


def link(url, tier):
    return (url, "blog", "s", tier, None)


def test_survivors(spark):
    d, t = date(2024, 5, 1), datetime(2024, 5, 1, 23, 59, 59)
    rows = [
        (1, d, "a", "Zed: A Method for Long Texts - Velora Blog", link("about:blank", 0), datetime(2024, 5, 2, 0, 0), 0),
        (2, d, "a", "Zed: A Method for", link("https://x.example/1", None), t, 0),
        (3, d, "a", "Zed: A Method for Long Texts", link("https://x.example/2", 2), None, 0),
        (4, d, "a", "[R] Zed: A Method for Long Texts", link("https://", 0), t, 0),
        (5, d, "a", "ZÃ©d: A Method for Long Texts...", None, datetime(2030, 1, 1), 0),
        (6, d, "one", "x", None, None, 0), (7, d, None, "x", None, None, 0), (8, d, None, "x", None, None, 0),
        (9, d, "bad", None, link("n/a", 0), None, 0), (10, d, "bad", "  ", None, None, 0),
    ]
    got = {(r.story_id, r.field_name): r.row_id for r in survivorship.surviving_fields(spark.createDataFrame(rows, STORY)).collect()}
    assert got == {("a", "title"): 3, ("a", "primary_link"): 3, ("a", "published_at"): 2, ("bad", "title"): 9, ("bad", "primary_link"): 9, ("bad", "published_at"): 9}
    assert survivorship.surviving_fields(spark.createDataFrame([], STORY)).count() == 0
