"""Weekly and monthly reports against hand-made archives."""

from datetime import date, datetime

from tidewright.plans.catalogue import QUERIES

SCHEMA = """row_id bigint, digest_date date, story_id string, title string, primary_link struct<url:string,link_type:string,source_id:string,tier:int,title:string>,
links array<struct<url:string,link_type:string,source_id:string,tier:int,title:string>>, entities array<string>, section string, published_at timestamp, arxiv_id string, hf_model_id string, github_release_url string, item_count int, summary string"""


def row(key, archived, published, section, kind="arxiv", source="axv-api-llm"):
    link = (f"https://x.example/{key}", kind, source, 1, None)
    return (key, archived, f"s{key}", f"Title {key}", link, [link], [], section, published, f"2501.{key:05d}" if kind == "arxiv" else None, None, None, 1, "")


def test_reports_by_local_date_with_lookahead(spark, tmp_path):
    sunday, last = datetime(2025, 3, 30, 12), datetime(2025, 3, 31, 12)
    rows = [
        row(1, date(2025, 3, 31), sunday, "papers"),  # archived the day after its week: still of it
        row(2, date(2025, 4, 1), last, "radar"),  # of March, by look-ahead; of week 14
        row(3, date(2025, 4, 2), sunday, "top5"),  # beyond the look-ahead of week 13 and of March
        row(4, date(2025, 3, 28), None, "top5"),  # no publication date: the archive's
        row(5, date(2025, 3, 28), datetime(2025, 3, 27), "model_releases"),
        row(6, date(2025, 3, 28), datetime(2025, 3, 27), None),
        row(7, date(2025, 3, 28), datetime(2025, 3, 27), "radar", "blog", "velora-blog"),
        row(8, date(2025, 3, 28), datetime(2025, 3, 27), "radar", "github", "code-feed"),
        row(9, date(2025, 3, 28), datetime(2025, 3, 20), "radar"),  # published before the week; of March
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "stories.parquet"))
    got = lambda name: {(r.period, r.list, r.row_id) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("report_weekly") == {("2025-W13", "papers", 1), ("2025-W14", "papers", 2), ("2025-W13", "papers", 4), ("2025-W13", "blogs", 7)}
    assert got("report_monthly") == {("2025-03", "papers", k) for k in (1, 2, 4, 9)} | {("2025-03", "blogs", 7)}
