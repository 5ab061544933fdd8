"""Judgements, drops, labels and stored payloads on written rows with literal results."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidewright.functions import cleanup, display, ids, url
from tidewright.operators import answers, quota, ranking
from tidewright.sources import feeds


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_answers(spark):
    known = spark.createDataFrame([("arxiv:1",), ("hf:a/b",), ("x:same",), ("y:same",), (None,)], "story_id string")
    text = 'Sure:\n```json\n[{"id": "[arxiv:1]", "components": {"novelty": "2", "rigor": "n/a", "preference_relevance": 1}}, {"id": "a/b", "score": 7}, {"id": "same", "score": 0.5}, {"id": "hf:a/b", "components": {}}]\n```'
    rows = spark.createDataFrame([(text,), ('{"papers": [{"id": "1", "score": "0.25"}]}',), ("no JSON at all",), ('[{"id": ',), (None,)], "answer string")
    found = answers.resolved(answers.entries(rows, "answer"), F.col("entry.id"), known, "story_id")
    got = sorted((r.story_id, round(r.w, 6)) for r in found.select("story_id", answers.weighted(F.col("entry.components"), F.col("entry.score"), F.lit(0.5)).alias("w")).collect())
    # 1 * .4 + clamp(2) * .15 + .5 * .15, halved by confidence; 7 is clamped; no score at all is neutral; "same" is not unique
    assert got == [("arxiv:1", 0.125), ("arxiv:1", 0.3125), ("hf:a/b", 0.25), ("hf:a/b", 0.5)]
    assert answers.entries(rows.limit(0), "answer").count() == 0
    assert one(spark, answers.passes(F.col("s"), 10.0, 0.9), s=9.0) and not one(spark, answers.passes(F.col("s"), 10.0, 1.0), s=10.0) and not one(spark, answers.passes(F.col("s"), 0.0, 0.1), s=10.0)


def test_drops_in_their_order(spark):
    rows = [(1, "a", "c", 9.0, "x"), (2, "a", "c", 8.0, "x"), (3, "a", "c", 7.0, "x"), (4, "b", "c", 6.0, "x"), (5, "b", None, 5.0, "medical x"), (6, "b", None, 4.0, "x"), (7, None, "c", 9.9, "x"), (8, "a", "d", 1.0, "keep")]
    df = spark.createDataFrame(rows, "id int, source string, category string, score double, text string")
    order = ranking.best_first(F.col("score"), F.lit(None).cast("timestamp"), F.col("id"))
    got = quota.drops(df, quota.excluded_by(F.col("text"), ["Medical", " "], F.lit(True)), "source", "category", order, 2, 3, F.col("text") == "keep")
    assert {r.id: r.reason for r in got.collect()} == {1: None, 2: None, 3: "per_source_max:a", 4: "arxiv_category:c", 5: "paper_exclusion_keyword:Medical", 6: None, 7: None, 8: None}


def test_labels(spark):
    assert [one(spark, display.short_number(F.col("n")), n=n) for n in (999, 1000, 12_345, 5_600_000)] == ["999", "1.0K", "12.3K", "5.6M"]
    assert one(spark, display.tag_label(F.col("t")), t="text-to-SQL") == "Text To SQL"
    assert one(spark, display.author_line(F.split("a", ",")), a="A,B,C,D,E") == "A, B, C +2 more" and one(spark, display.author_line(F.split("a", ",")), a="A,B") == "A, B"
    now = F.lit("2025-01-10 12:00:00").cast("timestamp")
    ages = {"2025-01-10 11:15:00": "45m ago", "2025-01-10 01:00:00": "11h ago", "2025-01-09 11:00:00": "Yesterday", "2025-01-06 12:00:00": "4d ago", "2024-12-25 12:00:00": "2w ago", "2024-06-01 00:00:00": "2024-06-01"}
    assert {t: one(spark, display.age_label(F.col("t").cast("timestamp"), now), t=t) for t in ages} == ages
    assert one(spark, display.describes_picture(F.col("t")), t=" Screenshot of a chart") and not one(spark, display.describes_picture(F.col("t")), t="An image of it")
    assert one(spark, display.lacks_end(F.col("t")), t="No end ") and not one(spark, display.lacks_end(F.col("t")), t="End。 ") and not one(spark, display.lacks_end(F.col("t")), t="")
    assert one(spark, display.without_credentials(F.col("u")), u="https://me:pw@x.example/a") == "https://[REDACTED]:[REDACTED]@x.example/a"
    assert [one(spark, display.backoff_ms(F.col("a")), a=a) for a in (0, 3, 9)] == [1000, 8000, 30_000]
    assert one(spark, ids.document_url(F.col("p"), F.lit("f"), "https://r.example"), p="/pdf/x.pdf") == "https://r.example/pdf/x.pdf" and one(spark, ids.document_url(F.col("p"), F.lit("f"), "https://r.example"), p="x") == "https://r.example/pdf?id=f"


def test_query_strings_as_forms_read_and_write_them(spark):
    cases = {"a": "a=", "a&b": "a=&b=", "a=1&&b=2": "a=1&b=2", "b=2&a=1&b=3": "b=2&b=3&a=1", "utm_source=x&A=%7e%41": "A=~A", "UTM_Source=x": "", "q=a b*": "q=a+b%2A", "q=%E4%B8%AD": "q=%E4%B8%AD", "p=a=b": "p=a%3Db", "bad=%zz": "bad=%25zz"}
    assert {c: one(spark, url.keep_parameters(F.col("q")), q=c) for c in cases} == cases


def test_json_in_prose(spark):
    cases = {'see [}] then {"a": "]}"} end': '{"a": "]}"}', "[1, [2]] tail": "[1, [2]]", "{broken": None, "[}": None, "": None}
    assert {c: one(spark, cleanup.balanced_json(F.col("t")), t=c) for c in cases} == cases


def test_stored_payloads(spark):
    nested = {"papers": [{"paper": {"id": "2401.00001", "title": "A  b", "publishedAt": "2024-01-02T00:00:00Z"}, "upvotes": 3}, {"paper": {"id": "", "title": "none"}}, {"title": "No id"}]}
    flat = [{"paperId": "2401.00002", "title": "C"}]
    df = spark.createDataFrame([("s", json.dumps(nested)), ("s", json.dumps(flat)), ("s", "{broken"), ("s", None)], "source_id string, payload string")
    got = sorted((r.url, r.title, r.date_confidence, r.published_at) for r in feeds.daily_papers(df).collect())
    assert got == [("https://arxiv.org/abs/2401.00001", "A b", "high", datetime(2024, 1, 2)), ("https://arxiv.org/abs/2401.00002", "C", "low", None)]
    df = spark.createDataFrame([("s", json.dumps([{"id": "x", "title": "T", "proceeding": "P"}, {"title": "U"}]))], "source_id string, payload string")
    assert [(r.url, json.loads(r.raw_json)["has_code"]) for r in feeds.code_papers(df).collect()] == [("https://paperswithcode.com/paper/x", True)]


def test_page_dates(spark):
    pages = {
        '<meta content="2025-02-01" name="pubdate"><time datetime="2025-01-01">': ("2025-01-01", "time", "high"), '<META property="article:published_time" content="2025-03-01">': ("2025-03-01", "meta", "high"),
        '<meta content="2025-02-01" name="pubdate">': ("2025-02-01", "meta", "high"), '<script type="application/ld+json">{"dateModified": "2025-04-01"}</script>': ("2025-04-01", "json_ld", "medium"),
        '<script type="application/ld+json">{"dateModified": "2025-04-01", "datePublished": "2025-05-01"}</script>': ("2025-05-01", "json_ld", "high"), "<p>Posted March 3, 2025 by</p>": ("March 3, 2025", "text", "medium"), "<p data-x='2025-01-01'>none</p>": (None, "none", "low"), "": (None, "none", "low"),
    }
    assert {p: tuple(one(spark, feeds.page_date(F.col("h")), h=p)) for p in pages} == pages
