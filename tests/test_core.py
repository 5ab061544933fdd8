"""Core operators against plain Python, readers against payloads made here."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewright import sinks
from tidewright.functions import cleanup, ids, url
from tidewright.operators import linking, ranking, reports, state
from tidewright.sources import feeds, files
from tidewright.streaming import items as streams


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression).first()[0]


def test_canonical_urls(spark):
    cases = {
        "HTTP://GitHub.com/A/b/?utm_source=x&b=2&a=1&b=3#top": "https://github.com/A/b?b=2&b=3&a=1", "http://arxiv.org/pdf/2401.12345v2.pdf": "https://arxiv.org/abs/2401.12345v2",
        "https://ar5iv.labs.arxiv.org/html/2401.12345": "https://arxiv.org/abs/2401.12345", "https://x.example/": "https://x.example/", "https://x.example//a//": "https://x.example//a",
        "http://x.example/a?REF=1&q=": "http://x.example/a?q=", "": "", None: None, "mailto:a#b": "mailto:a",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", url.canonical(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_identifiers(spark):
    u = F.col("u")
    rows = [("https://arxiv.org/abs/2401.12345v3", "arxiv:2401.12345"), ("https://github.com/A/B/releases/tag/v1.0", "github:a/b:v1.0"), ("https://huggingface.co/Org/Model-7B", "hf:org/model-7b"), ("https://x.example/", None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "u string").select(ids.stable_id(u, F.lit(None).cast("string")).alias("s"))
    assert [r.s for r in df.collect()] == [b for _, b in rows]
    assert one(spark, ids.normal_title(F.col("t")), t="  A.I., \"Really\"?  New\t(Model) ") == "ai really new model"


def test_event_classes_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b"]), rng.choice("xyz"), datetime(2024, rng.randrange(1, 13), rng.randrange(1, 28), rng.randrange(24)), i) for i in range(300)]
    known, expected = {}, {}
    for k, h, _, i in sorted(rows, key=lambda r: (r[2], r[3])):
        expected[i] = "NEW" if k not in known else "UNCHANGED" if known[k] == h else "UPDATED"
        known[k] = h
    df = spark.createDataFrame(rows, "url string, content_hash string, seen timestamp, row_id long")
    got = state.classify(df, "url", "content_hash", ["seen", "row_id"], F.date_trunc("month", "seen"))
    assert {r.row_id: r.event for r in got.collect()} == expected


def test_caps_and_sections_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.choice(["s", "t", None]), rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), datetime(2024, 1, 1, rng.randrange(24)) if rng.random() < 0.8 else None, rng.random() < 0.3, rng.random() < 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, day int, source string, score double, seen timestamp, release boolean, paper boolean")
    key = lambda r: (r[3] is None or r[3] != r[3], -(r[3] if r[3] is not None and r[3] == r[3] else 0), r[4] is None, -(r[4].timestamp() if r[4] else 0), r[0])
    order = ranking.best_first(F.col("score"), F.col("seen"), F.col("id"))
    for cap in (0, 1, 5):
        used, expected = {}, {}
        for r in sorted(rows, key=key):
            used[r[2]] = used.get(r[2], 0) + 1
            expected[r[0]] = r[2] is None or used[r[2]] <= cap or r[3] == 3.0
        got = ranking.capped(df, ["source"], order, cap, F.coalesce(F.col("score") == 3.0, F.lit(False)))
        assert {r.id: r.kept for r in got.collect()} == expected
    expected = {}
    for day in range(3):
        counts = {"top5": 0, "papers": 0, "radar": 0}
        own = sorted((r for r in rows if r[1] == day), key=key)
        limits = {"top5": 2, "papers": 5, "radar": 4}
        left = []
        for k, r in enumerate(own):
            expected[r[0]] = "top5" if k < 2 else "model_releases" if r[5] else None
            if expected[r[0]] is None:
                left.append(r)
        for section, wanted in (("papers", lambda r: r[6]), ("radar", lambda r: True)):
            for r in list(left):
                if wanted(r) and counts[section] < limits[section]:
                    expected[r[0]], counts[section] = section, counts[section] + 1
                    left.remove(r)
    got = ranking.sections(df, "id", "day", order, F.col("release"), F.col("paper"), 2, 5, 4)
    assert {r.id: r.section for r in got.collect()} == expected


def test_percentiles_by_place(spark):
    values = [3.0, 1.0, 2.0, 4.0]
    got = ranking.indexed_percentiles(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double"), ["g"], "v", [50, 99]).first()
    assert (got.p50, got.p99) == (3.0, 4.0)


def test_report_keeps_the_best_of_a_key(spark):
    rows = [(1, "w", "2401.1", "s1", 1.0), (2, "w", "2401.1", "s2", 2.0), (3, "w", None, "s3", 2.0), (4, "w", "2401.1", "s2", 2.0)]
    df = spark.createDataFrame(rows, "id long, period string, arxiv_id string, story_id string, score double").withColumn("title", F.lit("t")).withColumn("when", F.lit(None).cast("timestamp"))
    df = df.withColumn("key", reports.report_key(F.col("arxiv_id"), F.col("story_id"), F.lit(None).cast("string"), F.col("title"), F.col("when")))
    unique = reports.best_of_key(df, ["period", "key"], "score", "id", ["title", "when"])
    assert [(r.id, r.report_rank) for r in reports.ranked(unique, "period", "score", "when", "title", "id", 5).orderBy("report_rank").collect()] == [(2, 1), (3, 2)]


def test_primary_link(spark):
    rows = [("a", "blog", "https://b", 1, 0), ("a", "arxiv", "https://p", 2, 1), ("b", "forum", "https://f", 0, 0), ("b", "docs", "https://d", 2, 1), ("c", "forum", "https://f", 0, 0), ("c", "forum", "https://g", 0, 1)]
    df = spark.createDataFrame(rows, "story string, link_type string, url string, tier int, seq int")
    assert {r.story: r.url for r in linking.primary(df, "story", "seq").collect()} == {"a": "https://p", "b": "https://d", "c": "https://f"}


def test_cleanup(spark):
    assert one(spark, cleanup.redacted(F.col("t")), t="Authorization: Basic x\npassword=abcdefgh1 ok") == "[REDACTED]\n[REDACTED] ok"
    assert one(spark, cleanup.balanced_json(cleanup.unfenced(F.col("t"))), t='x ```json\n{"a": ["}", 1]} tail\n```') == '{"a": ["}", 1]}'
    assert one(spark, cleanup.latex_decoded(F.col("t")), t=r"$\alpha$-\textbf{Net} \'{e}  <b>x</b>") == "α-Net e x"
    assert one(spark, cleanup.sentence_cut(F.col("t"), 20), t="One two three. Four five six seven.") == "One two three."
    assert one(spark, cleanup.compatibility_form(F.col("t")), t="ﬁé") == "fie\u0301"


RSS = "<rss><channel><title>c</title><item><title>A  B</title><link>https://x.example/a</link><pubDate>Tue, 03 Jun 2025 10:00:00 GMT</pubDate><description>d</description></item><item><title>no link</title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>i</id><title>T</title><updated>2025-06-03T10:00:00Z</updated><link href="https://x.example/pdf" rel="related"/><link href="https://x.example/abs"/><author><name>N</name></author><category term="cs"/><category term="cs"/></entry></feed>'
PAGE = '<html><nav><a href="/menu">Menu entry</a></nav><article><a href="/a?utm_source=x">First article</a><time datetime="2025-06-03">x</time></article><li><a href="/a#c">First article again</a></li><a href="/page/2">Next page</a><a href="x.html">abc</a></html>'


def test_readers(spark):
    df = spark.createDataFrame([("s", RSS), ("t", "<broken"), ("u", None)], "source_id string, payload string")
    assert [(r.url, r.title, str(r.published_at), r.date_confidence) for r in feeds.rss(df).collect()] == [("https://x.example/a", "A B", "2025-06-03 10:00:00", "high")]
    df = spark.createDataFrame([("s", ATOM)], "source_id string, payload string")
    (r,) = feeds.atom(df).collect()
    assert (r.url, r.date_confidence, json.loads(r.raw_json)["categories"]) == ("https://x.example/abs", "medium", ["cs"])
    df = spark.createDataFrame([("s", json.dumps([{"tag_name": "v1", "name": "", "html_url": "https://x.example/v1", "published_at": "2025-06-03T10:00:00Z"}, {"tag_name": "v2", "draft": True, "html_url": "https://x.example/v2"}]))], "source_id string, payload string")
    assert [(r.title, r.kind) for r in feeds.releases(df).collect()] == [("v1", "release")]
    df = spark.createDataFrame([("s", json.dumps({"notes": [{"id": "n", "cdate": 1725788116000, "content": {"title": {"value": "T"}}}]}))], "source_id string, payload string")
    assert [(r.url, r.title, str(r.published_at)) for r in feeds.notes(df).collect()] == [("https://openreview.net/forum?id=n", "T", "2024-09-08 09:35:16")]
    df = spark.createDataFrame([("s", json.dumps([{"id": "o/m", "modelId": None, "lastModified": "2025-06-03T10:00:00.000Z"}]))], "source_id string, payload string")
    assert [r.url for r in feeds.models(df).collect()] == ["https://huggingface.co/o/m"]
    df = spark.createDataFrame([("s", "https://x.example/list", PAGE)], "source_id string, url string, payload string")
    assert [(r.url, r.title, str(r.published_at)) for r in feeds.html_list(df).collect()] == [("https://x.example/a", "First article", "2025-06-03 00:00:00")]


def test_pages_without_articles(spark):
    page = """<div class="site"><div class="post-card"><h2><a href="/one">The first entry</a></h2><div><p class="meta">short</p><p>What the first entry is about, at some length.</p></div><time datetime="2025-01-02"></time></div>
    <div class="post-card"><a href="/two"><img src="x"></a><a href="/two" title="The second entry"></a><p>Too short</p></div></div>"""
    df = spark.createDataFrame([("s", "https://x.example/list", page)], "source_id string, url string, payload string")
    got = sorted((r.url, r.title, str(r.published_at), json.loads(r.raw_json).get("description")) for r in feeds.html_list(df).collect())
    assert got == [("https://x.example/one", "The first entry", "2025-01-02 00:00:00", "What the first entry is about, at some length."), ("https://x.example/two", "The second entry", "None", None)]


def test_primary_category_comes_first(spark):
    feed = ATOM.replace('<category term="cs"/>', '<category term="b"/><category term="a"/>', 1).replace("<author>", '<primary_category term="a"/><author>', 1)
    (r,) = feeds.atom(spark.createDataFrame([("s", feed)], "source_id string, payload string")).collect()
    assert json.loads(r.raw_json)["categories"] == ["a", "b", "cs"]


def test_sinks(spark, tmp_path):
    index = spark.createDataFrame([("weekly", "2025-W01", 1), ("weekly", "2025-W02", 2)], "report_type string, period string, n int")
    entry = spark.createDataFrame([("weekly", "2025-W02", 9), ("weekly", "2025-W03", 3)], index.schema)
    assert sorted((r.period, r.n) for r in sinks.index_entry(index, entry, ["report_type", "period"]).collect()) == [("2025-W01", 1), ("2025-W02", 9), ("2025-W03", 3)]
    backups = spark.createDataFrame([("a", 1, "x"), ("a", 2, "z"), ("a", 2, "y"), ("b", None, "w")], "g string, at int, name string")
    assert sorted(r.name for r in sinks.newest(backups, "g", "at", "name", 1).collect()) == ["w", "y"]
    lines = sinks.prometheus(spark.createDataFrame([('a"b', None, 2)], "source string, kind string, n int"), "items_total", ["source", "kind"], "n")
    assert [r.line for r in lines.collect()] == ['items_total{source="a\\"b",kind=""} 2']
    rows = lambda days: spark.createDataFrame([(f"u{d}", datetime(2025, m, d)) for m, d in days], "url string, first_seen timestamp")
    sinks.state(rows([(1, 1), (2, 2)]), str(tmp_path / "state"), 2)
    sinks.state(rows([(2, 3)]), str(tmp_path / "state"), 2)  # replaces its month only
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "state")).collect()) == ["u1", "u3"]


def test_archives_and_streams(spark, tmp_path):
    rows = [("a", "t", "2024-01-01"), ("b", "t", "2024-01-02")]
    df = spark.createDataFrame(rows, "story_id string, title string, d string").select("story_id", "title", F.to_date("d").alias("digest_date"))
    sinks.day_archive(df, str(tmp_path / "days"))
    sinks.day_archive(df.where("story_id = 'b'"), str(tmp_path / "days"))  # replaces its day only
    assert [r.story_id for r in files.day_archives(spark, str(tmp_path / "days"), "2024-01-01", "2024-01-01").collect()] == ["a"]
    seen = [("https://x.example/a?ref=1", "h1", "t", datetime(2024, 1, 1), "s", "blog"), ("https://x.example/a", "h1", "t", datetime(2024, 1, 1, 1), "s", "blog"), ("https://x.example/b", "h2", "t", datetime(2024, 1, 1, 2), "s", "blog")]
    schema = "url string, content_hash string, title string, seen timestamp, source_id string, kind string"
    spark.createDataFrame(seen, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = streams.sightings(stream).writeStream.format("memory").queryName("sightings").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.url for r in spark.table("sightings").collect()) == ["https://x.example/a", "https://x.example/b"]
    folder, check = str(tmp_path / "state"), str(tmp_path / "ck")
    streams.upsert(stream, folder, check).awaitTermination(60)
    assert streams.current_state(spark, folder).count() == 2
    # further batches, each after a restart, then a new checkpoint over the state that is there
    for k, (hash_, at) in enumerate((("h1", 3), ("h9", 4))):
        spark.createDataFrame([("https://x.example/a", hash_, f"t{k}", datetime(2024, 1, 1, at), "s", "blog")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        streams.upsert(stream, folder, check).awaitTermination(60)
    one = lambda: streams.current_state(spark, folder).where("url LIKE '%/a'").first()
    assert (one().content_hash, one().first_seen.hour, one().last_seen.hour, streams.Commits(spark, folder).last()["batch"]) == ("h9", 1, 4, 2)
    streams.upsert(stream, folder, str(tmp_path / "ck2")).awaitTermination(60)
    assert streams.current_state(spark, folder).count() == 2 and one().first_seen.hour == 1
    assert len([d for d in (tmp_path / "state").iterdir() if d.name.startswith("generation")]) == 1
    # a state that can't be read is an error, not an empty state
    last = streams.Commits(spark, folder).last()
    streams.Commits(spark, folder).drop(last["generation"])
    with pytest.raises(Exception, match="generation"):
        streams.current_state(spark, folder).count()


def test_entry_without_the_training_package(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    assert "p2_found" in entry.queries()
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    assert "p2_found" in entry.queries() and "p6_found" not in entry.queries()
