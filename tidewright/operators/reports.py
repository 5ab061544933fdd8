"""Weekly and monthly reports over the days' sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import periods


def report_key(arxiv_id: Column, story_id: Column, url: Column, title: Column, when: Column) -> Column:
    """What makes two candidates the same: paper, else story, else address, else title and time; without case."""
    some = lambda c: F.when(c.isNotNull() & (c != ""), F.lower(c))
    named = lambda name, c: F.concat(F.lit(name), some(c))
    return F.coalesce(named("arxiv_id:", arxiv_id), named("story_id:", story_id), named("url:", url), F.concat(F.lit("title:"), F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lit(":"), F.coalesce(when.cast("string"), F.lit(""))))


# Sections whose records compete for a report, in scan order, and the link types of its two lists.
SECTIONS = ("papers", "top5", "radar")
PAPER_LINKS = ("arxiv", "paper", "openreview")
BLOG_LINKS = ("article", "blog", "html", "official")
BLOG_LIMIT = 30


def local_date(published: Column, archived: Column, zone: str) -> Column:
    """The publication date in ``zone``; the archive's date where there is none."""
    return F.coalesce(periods.local_day(published, zone), archived)


def in_scan(local: Column, archived: Column, kind: str, lookahead: int = 1) -> Column:
    """Whether the archive of the day is read for the period (``week`` or ``month``) of the local date: its own days and
    ``lookahead`` days after its end."""
    first = F.trunc(local, kind)
    last = F.date_sub(F.add_months(first, 1), 1) if kind == "month" else F.date_add(first, 6)
    return (archived >= first) & (archived <= F.date_add(last, lookahead))


def report_list(arxiv_id: Column, link_type: Column, source_id: Column, paper_sources: str, blog_sources: list[str]) -> Column:
    """``papers`` or ``blogs``, or null for a record that neither list takes. ``paper_sources`` is a pattern of identifiers."""
    link, source = F.lower(F.coalesce(link_type, F.lit(""))), F.lower(F.coalesce(source_id, F.lit("")))
    paper = (F.coalesce(arxiv_id, F.lit("")) != "") | link.isin(*PAPER_LINKS) | source.rlike(paper_sources)
    blog = link.isin(*BLOG_LINKS) | source.isin(*blog_sources) | source.contains("blog")
    return F.when(paper, "papers").when(blog, "blogs")


def best_of_key(candidates: DataFrame, key: list[str], score: str, order: str, fields: list[str]) -> DataFrame:
    """One candidate per key: the highest score, the first of equals. One aggregation, no window over the key."""
    best = F.min(F.struct((-F.coalesce(F.col(score), F.lit(0.0))).alias("s"), F.col(order).alias("o"), *fields))
    return candidates.groupBy(*key).agg(best.alias("_b")).select(*key, (-F.col("_b.s")).alias(score), F.col("_b.o").alias(order), *[F.col(f"_b.{f}").alias(f) for f in fields])


def ranked(unique: DataFrame, period: str | list[str], score: str, when: str, title: str, last: str, limit: int) -> DataFrame:
    """Adds report_rank within the period, best first, and keeps the first ``limit``."""
    order = [F.col(score).desc(), F.coalesce(F.unix_micros(when), F.lit(0)).desc(), F.lower(F.coalesce(title, F.lit(""))).asc(), F.col(last).asc()]
    place = F.row_number().over(Window.partitionBy(period).orderBy(*order))
    return unique.withColumn("report_rank", place).where(F.col("report_rank") <= limit)


# Words of a report's title and summary.
TITLES = {"week": " AI 研究週報", "month": " AI 研究月報"}


def title_of(period: Column, kind: str) -> Column:
    return F.concat(period, F.lit(TITLES[kind]))


def summary_of(period: Column, kind: str, papers: Column, blogs: Column, covered: Column, missing: Column, candidates: Column, topics: Column | None = None) -> Column:
    """What a report says of itself."""
    label = F.lit("本週") if kind == "week" else F.concat(period, F.lit(" 月"))
    days = F.concat(F.lit("涵蓋 "), covered.cast("string"), F.lit(" 天資料"), F.when(missing > 0, F.concat(F.lit("，另有 "), missing.cast("string"), F.lit(" 天缺資料"))).otherwise("，資料完整"))
    parts = F.concat_ws("與", F.when(papers > 0, F.concat(papers.cast("string"), F.lit(" 篇 AI 論文"))), F.when(blogs > 0, F.concat(blogs.cast("string"), F.lit(" 篇值得看的技術文章"))))
    topic = F.lit("") if topics is None else F.coalesce(F.concat(F.lit("，重點集中在 "), F.nullif(topics, F.lit(""))), F.lit(""))
    some = F.concat(label, F.lit("整理 "), parts, topic, F.lit("。"), days, F.lit("，共從 "), candidates.cast("string"), F.lit(" 篇候選中篩選。"))
    return F.when(papers + blogs > 0, some).otherwise(F.concat(label, F.lit("尚未找到符合條件的論文或文章推薦。"), days, F.lit("。")))


def indexed(reports: DataFrame) -> DataFrame:
    """Adds place (1: the latest of its kind), path and of_kind (recommendations of all reports of the kind) to one row per report."""
    kind = Window.partitionBy("report_type")
    path = F.concat(F.lit("api/reports/"), "report_type", F.lit("/"), "period", F.lit(".json"))
    return reports.withColumn("place", F.row_number().over(kind.orderBy(F.desc("period")))).withColumn("path", path).withColumn("of_kind", F.sum("recommendations").over(kind))


def overridden(value: Column, generated: Column) -> Column:
    """A generated text in place of the report's own, blanks squeezed, where there is any."""
    clean = F.trim(F.regexp_replace(generated, r"\s+", " "))
    return F.when(clean != "", clean).otherwise(value)


def coverage(days: DataFrame, first: str, last: str) -> DataFrame:
    """(day, covered): every day from ``first`` to ``last`` and whether ``days`` (column day) has it."""
    wanted = days.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")
    return wanted.join(days.select("day").distinct().withColumn("covered", F.lit(True)), "day", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
