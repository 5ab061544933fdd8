"""The section waterfall at its production limits, and at tight ones."""

from collections import Counter
from datetime import date, datetime

from pyspark.sql import functions as F

from tidewright.operators import ranking
from tidewright.plans.catalogue import QUERIES

LINK = "struct<url:string,link_type:string,source_id:string,tier:int,title:string>"
SCHEMA = f"row_id bigint, digest_date date, story_id string, title string, primary_link {LINK}, links array<{LINK}>, entities array<string>, section string, published_at timestamp, arxiv_id string, hf_model_id string, github_release_url string, item_count int, summary string"


def test_day_sections_use_the_production_limits(spark, tmp_path):
    day, rows = date(2025, 3, 28), []
    for k in range(110):  # 80 papers and 30 others, the best five of which are papers
        paper = k < 80
        link = (f"https://x.example/{k}", "arxiv" if paper else "blog", "s", 0 if k < 5 else 2, None)
        rows.append((k, day, f"s{k}", f"Title {k}", link, [link], [], None, datetime(2025, 3, 28), f"2501.{k:05d}" if paper else None, None, None, 1, ""))
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "stories.parquet"))
    got = Counter(r.section for r in QUERIES["day_sections"](spark, str(tmp_path)).collect())
    assert got == {"top5": 5, "papers": 70, "radar": 20, None: 15}
    audit = {r.section: r.n for r in QUERIES["drop_audit"](spark, str(tmp_path)).where("month = '2025-03'").collect()}
    assert audit == {"top5": 5, "papers": 70, "radar": 20, "dropped": 15, None: 110}


def test_tight_limits(spark):
    rows = spark.createDataFrame([(k, "d", k < 3, k in (3, 4, 5, 6)) for k in range(9)], "id int, day string, rel boolean, paper boolean")
    got = {r.id: r.section for r in ranking.sections(rows, "id", "day", F.col("id"), F.col("rel"), F.col("paper"), top=1, papers=2, radar=1).collect()}
    assert got == {0: "top5", 1: "model_releases", 2: "model_releases", 3: "papers", 4: "papers", 5: "radar", 6: None, 7: None, 8: None}
