"""Readers of stored payloads over whole tables: what the tables hold is written as interfaces and pages would send it, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.catalogue import oracle, query
from tidewright.session import table
from tidewright.sources import feeds

_TITLE = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"
_WHEN = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


@query
def daily_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Daily lists of papers, nested as the interface nests them; every third one without a date."""
    s = table(spark, folder, "stories").where(F.col("arxiv_id").isNotNull())
    paper = F.struct(F.col("arxiv_id").alias("id"), "title", F.when(F.col("row_id") % 3 > 0, _WHEN(F.col("published_at"))).alias("publishedAt"), F.col("summary"))
    payload = F.to_json(F.struct(F.array(F.struct(paper.alias("paper"), F.col("item_count").alias("upvotes"))).alias("papers")))
    found = feeds.daily_papers(s.select(F.col("row_id").cast("string").alias("source_id"), payload.alias("payload")), "https://axv.example/abs/")
    return found.select(F.col("source_id").cast("bigint").alias("row_id"), "url", "title", "published_at", "date_confidence", F.get_json_object("raw_json", "$.is_trending").alias("trending"))


oracle("daily_papers", f"""SELECT row_id, 'https://axv.example/abs/' || arxiv_id AS url, {_TITLE} AS title, CASE WHEN row_id % 3 > 0 THEN date_trunc('second', published_at) END AS published_at,
  CASE WHEN row_id % 3 > 0 AND published_at IS NOT NULL THEN 'high' ELSE 'low' END AS date_confidence, CASE WHEN coalesce(item_count, 0) > 0 THEN 'true' ELSE 'false' END AS trending
FROM stories WHERE arxiv_id IS NOT NULL AND {_TITLE} <> ''""")


@query
def code_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with code: whole addresses or bare identifiers, with a repository or not."""
    s = table(spark, folder, "stories")
    paper = F.struct(F.concat(F.lit("p-"), F.col("row_id").cast("string")).alias("id"), "title", F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("https://papers.example/p/"), F.col("row_id").cast("string"))).alias("url_abs"),
                     F.to_date("published_at").cast("string").alias("published"), F.col("github_release_url").alias("repository_url"))
    payload = F.to_json(F.struct(F.array(paper).alias("results")))
    found = feeds.code_papers(s.select(F.col("row_id").cast("string").alias("source_id"), payload.alias("payload")), "https://code-papers.example/paper/")
    return found.select(F.col("source_id").cast("bigint").alias("row_id"), "url", "title", F.to_date("published_at").alias("day"), F.get_json_object("raw_json", "$.has_code").alias("has_code"))


oracle("code_papers", f"""SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'https://papers.example/p/' || row_id ELSE 'https://code-papers.example/paper/p-' || row_id END AS url, {_TITLE} AS title,
  (published_at AT TIME ZONE 'UTC')::DATE AS day, CASE WHEN github_release_url IS NOT NULL THEN 'true' ELSE 'false' END AS has_code FROM stories WHERE {_TITLE} <> ''""")


@query
def page_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The date of a page for each record: in a time element, a meta tag, structured data or the text, with others of lower rank beside it."""
    k, day = F.col("row_id") % 5, F.to_date("published_at").cast("string")
    page = F.concat(
        F.lit("<html><head>"), F.when(k.isin(1, 0), F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T00:00:00Z"/>'))).otherwise(""),
        F.when(k.isin(2, 1), F.concat(F.lit('<script type="application/ld+json">{"@type":"Article","datePublished":"'), F.when(k == 2, day).otherwise("1999-01-01"), F.lit('"}</script>'))).otherwise(""),
        F.lit("</head><body>"), F.when(k == 0, F.concat(F.lit("<time class='x' datetime='"), day, F.lit("'>then</time>"))).otherwise(""), F.lit("<p>Posted "),
        F.when(k == 3, day).when(k < 3, F.lit("1998-02-03")).otherwise("long ago"), F.lit("</p></body></html>"),
    )
    rows = table(spark, folder, "stories").where(F.col("published_at").isNotNull()).select("row_id", feeds.page_date(page).alias("d"))
    return rows.select("row_id", "d.method", "d.confidence", F.to_date(feeds.read_time(F.col("d.raw"))).alias("day"))


oracle("page_dates", """SELECT row_id, ['time', 'meta', 'json_ld', 'text', 'none'][row_id % 5 + 1] AS method, CASE WHEN row_id % 5 < 3 THEN 'high' WHEN row_id % 5 = 3 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN row_id % 5 < 4 THEN (published_at AT TIME ZONE 'UTC')::DATE END AS day FROM stories WHERE published_at IS NOT NULL""")
