"""Identifiers by titles against plain Python, on forms that the queries' SQL can't follow."""

import hashlib
import re
import unicodedata
from datetime import datetime

from pyspark.sql import functions as F

from tidewright.functions import ids
from tidewright.plans.catalogue import QUERIES

TITLES = ["Ｆｕｌｌ Width: ﬁne Results", "Full Width fine results", "Café models", "Café models", "A non‑breaking title…", "模型　发布", "x" * 99 + "é tail", "plain, title!", None]


def normal(title):
    text = unicodedata.normalize("NFKD", title).lower()
    for sign in "!@#$%^&*()[]{}|\\;:'\",.<>?/`~":
        text = text.replace(sign, "")
    return re.sub(r"\s+", " ", text).strip()[:100]


def wanted(title, entity, day):
    content = "|".join(([] if title is None else [normal(title)]) + [entity or "unknown", day])
    return "fallback:" + hashlib.sha256(content.encode()).hexdigest()[:16]


def test_title_queries_match_brute_force(spark, tmp_path):
    when = datetime(2025, 3, 1, 12)
    rows = [(k, t, ["velora"] if k % 2 else [], when) for k, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "row_id bigint, title string, entities array<string>, published_at timestamp").write.parquet(str(tmp_path / "stories.parquet"))
    day = spark.sql("SELECT date_format(timestamp'2025-03-01 12:00:00', 'yyyy-MM-dd')").first()[0]
    for r in QUERIES["title_keys"](spark, str(tmp_path)).collect():
        title = TITLES[r.row_id]
        assert r.normal == (None if title is None else normal(title))
        assert r.fallback_id == wanted(title, "velora" if r.row_id % 2 else None, day)
    items = [(k, t, f"https://blog.example/{k}", "{}", "s", 1, "high", when, when) for k, t in enumerate(TITLES)]
    spark.createDataFrame(items, "row_id bigint, title string, url string, raw_json string, source_id string, tier int, date_confidence string, published_at timestamp, first_seen_at timestamp").write.parquet(str(tmp_path / "items.parquet"))
    expected = {}
    for t in TITLES:
        expected[wanted(t, None, day)] = expected.get(wanted(t, None, day), 0) + 1
    assert {r.story_id: r.item_count for r in QUERIES["story_groups"](spark, str(tmp_path)).collect()} == expected
    counts = QUERIES["merge_counts"](spark, str(tmp_path)).first()
    assert (counts.stories, counts.fallback_merges) == (len(expected), sum(n > 1 for n in expected.values())) and counts.fallback_merges == 2


def test_normal_title_decomposes(spark):
    assert spark.range(1).select(ids.normal_title(F.lit("Ｃａｆé"))).first()[0] == "café"
