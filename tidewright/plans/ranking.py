"""Queries of scores, quotas, sections and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import periods
from tidewright.functions.text import canonical_name, strict_json
from tidewright.operators import ranking, reports
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.scalars import STRICT, q
from tidewright.plans.stories import TOPICS
from tidewright.session import table

CONFIGURED = ["velora", "kestrelab", "mirandel", "osprion"]
QUALITY = ["axv-api-llm", "axv-api-agents", "hub-daily-papers"]
_SOURCE = r"nullif(regexp_replace(lower(trim({0})), '[_\s]+', '-', 'g'), '')"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Stories' records with the components of their score at the end of their digest day."""
    s = table(spark, folder, "stories")
    link, now = F.col("primary_link"), F.date_add("digest_date", 1).cast("timestamp")
    kind = F.when(F.col("hf_model_id").isNotNull(), "model").when(F.col("github_release_url").isNotNull(), "release").when(F.col("arxiv_id").isNotNull(), "paper").otherwise(link["link_type"])
    sources = F.transform("links", lambda l: l["source_id"])
    parts = {
        "tier_score": ranking.tier_score(link["tier"]), "kind_score": ranking.kind_score(kind), "topic_score": ranking.topic_score(F.lower(F.concat_ws(" ", "title", "summary")), TOPICS),
        "recency_score": F.round(ranking.recency_score(F.when(F.col("published_at").isNotNull(), F.least("published_at", now)), now), 9), "entity_score": ranking.entity_score(F.col("entities"), CONFIGURED), "cross_score": ranking.cross_source_score(sources, QUALITY),
    }
    rows = s.select("row_id", "story_id", "digest_date", "title", "published_at", "arxiv_id", "entities", "hf_model_id", "github_release_url", link["url"].alias("url"), canonical_name(link["source_id"]).alias("source"), *[v.alias(k) for k, v in parts.items()])
    total = sum((F.col(k) for k in parts), F.lit(0.0))
    return rows.withColumn("score", F.round(total, 6))


_TOPIC = " + ".join(f"CASE WHEN regexp_matches(txt, {q(ranking.keyword_pattern(ws))}) THEN {b} * 1.5 ELSE 0 END" for ws, b in TOPICS.values())
_KIND = "CASE k " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in ranking.KIND_WEIGHTS.items()) + " ELSE 1.0 END"
SCORED = f"""b AS (SELECT *, lower(concat_ws(' ', title, summary)) AS txt, ((digest_date + 1)::TIMESTAMP AT TIME ZONE 'UTC') AS now,
  lower(trim(CASE WHEN hf_model_id IS NOT NULL THEN 'model' WHEN github_release_url IS NOT NULL THEN 'release' WHEN arxiv_id IS NOT NULL THEN 'paper' ELSE primary_link.link_type END)) AS k FROM stories),
p AS (SELECT *, CASE primary_link.tier WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS tier_score, ({_KIND})::DOUBLE AS kind_score, least(6.0, {_TOPIC})::DOUBLE AS topic_score,
  round(coalesce(CASE WHEN published_at IS NOT NULL THEN exp(-0.1 * least((epoch_us(now) - epoch_us(least(published_at, now))) / 86400000000.0, 30.0)) END, 0.1), 9)::DOUBLE AS recency_score,
  (2.0 * coalesce(len(list_filter(entities, lambda e: e IN ({', '.join(q(c) for c in CONFIGURED)}))), 0))::DOUBLE AS entity_score,
  least(3.0, len(list_distinct(list_filter(list_transform(links, lambda l: l.source_id), lambda s: s IN ({', '.join(q(c) for c in QUALITY)})))))::DOUBLE AS cross_score FROM b),
scored AS (SELECT row_id, story_id, digest_date, title, published_at, arxiv_id, entities, hf_model_id, github_release_url, primary_link.url AS url, {_SOURCE.format('primary_link.source_id')} AS source,
  tier_score, kind_score, topic_score, recency_score, entity_score, cross_score, round(tier_score + kind_score + topic_score + recency_score + entity_score + cross_score, 6) AS score FROM p)"""
_BEST = "score DESC NULLS LAST, published_at DESC NULLS LAST, url NULLS LAST, row_id"


def _order() -> F.Column:
    return ranking.best_first(F.col("score"), F.col("published_at"), ranking.by_address(F.col("url"), F.col("row_id")))


@query
def score_components(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("row_id", "tier_score", "kind_score", "topic_score", "recency_score", "entity_score", "cross_score", "score")


oracle("score_components", f"WITH {SCORED} SELECT row_id, tier_score, kind_score, topic_score, recency_score, entity_score, cross_score, score FROM scored")


@query
def top_stories(spark: SparkSession, folder: str) -> DataFrame:
    """The five best records of each day."""
    return ranking.first_rows(scored(spark, folder), ["digest_date"], _order(), 5).select("digest_date", "place", "row_id", "story_id", "score")


oracle("top_stories", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY {_BEST}) AS place FROM scored) SELECT digest_date, place::INT AS place, row_id, story_id, score FROM r WHERE place <= 5")


@query
def source_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each item stays within twenty a source, best score first; very good ones (9.5 or more) always stay."""
    rows = table(spark, folder, "items").select("row_id", canonical_name(F.col("source_id")).alias("source"), "score", F.col("first_seen_at").alias("seen"), "url")
    order = ranking.best_first(F.col("score"), F.col("seen"), ranking.by_address(F.col("url"), F.col("row_id")))
    passes = F.coalesce(~F.isnan("score") & (F.col("score") >= 9.5), F.lit(False))
    return ranking.capped(rows, ["source"], order, 20, passes).select("row_id", "kept")


oracle("source_quota", f"""WITH r AS (SELECT row_id, {_SOURCE.format('source_id')} AS source, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, first_seen_at, url FROM items)
SELECT row_id, source IS NULL OR row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, first_seen_at DESC NULLS LAST, url NULLS LAST, row_id) <= 20 OR coalesce(score >= 9.5, false) AS kept FROM r""")


@query
def category_quota(spark: SparkSession, folder: str) -> DataFrame:
    """Papers within thirty an archive category, by the category in their record; rows without one are exempt."""
    category = F.get(F.from_json(F.get_json_object(strict_json(F.col("raw_json")), "$.categories"), "array<string>"), F.lit(0))
    rows = table(spark, folder, "items").select("row_id", category.alias("category"), "score", F.col("first_seen_at").alias("seen"), "url")
    rows = ranking.capped(rows, ["category"], ranking.best_first(F.col("score"), F.col("seen"), ranking.by_address(F.col("url"), F.col("row_id"))), 30)
    return rows.where(F.col("category").isNotNull()).groupBy("category").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.min(F.when(F.col("kept"), F.when(F.isnan("score"), None).otherwise(F.col("score")))).alias("lowest"))


oracle("category_quota", f"""WITH r AS (SELECT row_id, json_extract_string({STRICT}, '$.categories[0]') AS category, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, first_seen_at, url FROM items),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST, first_seen_at DESC NULLS LAST, url NULLS LAST, row_id) <= 30 AS kept FROM r WHERE category IS NOT NULL)
SELECT category, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped, min(score) FILTER (kept) AS lowest FROM k GROUP BY 1""")


def _sectioned(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored(spark, folder)
    release = F.col("hf_model_id").isNotNull() | F.col("github_release_url").isNotNull()
    return ranking.sections(rows, "row_id", "digest_date", _order(), release, F.col("arxiv_id").isNotNull())


@query
def day_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _sectioned(spark, folder)


_SECTIONS = f"""{SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY digest_date ORDER BY {_BEST}) AS rn, hf_model_id IS NOT NULL OR github_release_url IS NOT NULL AS rel FROM scored),
t AS (SELECT *, CASE WHEN rn <= 5 THEN 'top5' WHEN rel THEN 'model_releases' WHEN arxiv_id IS NOT NULL THEN 'papers' ELSE 'radar' END AS k FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY digest_date, k ORDER BY {_BEST}) AS kn FROM t), v AS (SELECT *, CASE WHEN k = 'papers' AND kn > 70 THEN 'radar' ELSE k END AS k2 FROM u),
w AS (SELECT *, row_number() OVER (PARTITION BY digest_date, k2 ORDER BY {_BEST}) AS kn2 FROM v),
sec AS (SELECT row_id, digest_date, CASE WHEN k2 = 'radar' AND kn2 > 20 THEN NULL ELSE k2 END AS section FROM w)"""
oracle("day_sections", f"WITH {_SECTIONS} SELECT row_id, digest_date, section FROM sec")


@query
def drop_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Dropped and shown records by month, section and in all, in one pass."""
    rows = _sectioned(spark, folder).select(periods.month_id(F.col("digest_date")).alias("month"), F.coalesce("section", F.lit("dropped")).alias("section"))
    return rows.cube("month", "section").agg(F.count("*").alias("n"))


oracle("drop_audit", f"WITH {_SECTIONS} SELECT strftime(digest_date, '%Y-%m') AS month, coalesce(section, 'dropped') AS section, count(*) AS n FROM sec GROUP BY CUBE (1, 2)")


@query
def releases_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stories").where(F.col("hf_model_id").isNotNull() | F.col("github_release_url").isNotNull())
    return rows.groupBy(F.coalesce(F.get("entities", F.lit(0)), F.lit("other")).alias("entity")).agg(F.count("*").alias("records"), F.count_distinct("story_id").alias("stories"))


oracle("releases_by_entity", "SELECT coalesce(entities[1], 'other') AS entity, count(*) AS records, count(DISTINCT story_id) AS stories FROM stories WHERE hf_model_id IS NOT NULL OR github_release_url IS NOT NULL GROUP BY 1")


@query
def score_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "items").select(canonical_name(F.col("source_id")).alias("source"), F.when(~F.isnan("score"), F.col("score")).alias("score"))
    return ranking.indexed_percentiles(rows, ["source"], "score", [50, 90, 99])


oracle("score_percentiles", "SELECT source, " + ", ".join(f"list_sort(list(score))[least(({p} * count(*)) // 100, count(*) - 1)::INT + 1] AS p{p}" for p in (50, 90, 99)) + f" FROM (SELECT {_SOURCE.format('source_id')} AS source, score FROM items WHERE score IS NOT NULL AND NOT isnan(score)) GROUP BY 1")


# The invented sources of the test tables, in the places of the public ones.
PAPER_SOURCES, BLOG_SOURCES = r"^(?:arxiv-|axv-)|^(?:hf|hub)-daily-papers$", ["plume-notes"]


def _candidates(spark: SparkSession, folder: str, kind: str, zone: str = "UTC", lookahead: int = 1) -> DataFrame:
    """The papers and blogs that compete in each period by local publication date, from the report sections of its days' archives
    and of ``lookahead`` days after."""
    link = F.col("primary_link")
    taken = reports.report_list(F.col("arxiv_id"), link["link_type"], link["source_id"], PAPER_SOURCES, BLOG_SOURCES)
    extra = table(spark, folder, "stories").select("row_id", taken.alias("list"), F.array_position(F.array(*[F.lit(n) for n in reports.SECTIONS]), F.col("section")).alias("section"), link["link_type"].alias("link_type"))
    local = reports.local_date(F.col("published_at"), F.col("digest_date"), zone)
    rows = scored(spark, folder).join(extra.where("section > 0 AND list IS NOT NULL"), "row_id")
    rows = rows.withColumn("local", local).where(reports.in_scan(F.col("local"), F.col("digest_date"), kind, lookahead))
    rows = rows.withColumn("period", periods.week_id(F.col("local")) if kind == "week" else periods.month_id(F.col("local")))
    key = reports.report_key(F.col("arxiv_id"), F.col("story_id"), F.col("url"), F.col("title"), F.col("published_at"))
    return rows.withColumn("key", key).withColumn("seen", F.struct("digest_date", "section", "row_id"))


def _report(spark: SparkSession, folder: str, kind: str, limit: int, zone: str = "UTC", lookahead: int = 1) -> DataFrame:
    rows = _candidates(spark, folder, kind, zone, lookahead)
    unique = reports.best_of_key(rows, ["period", "list", "key"], "score", "seen", ["row_id", "story_id", "title", "published_at"])
    best = reports.ranked(unique, ["period", "list"], "score", "published_at", "title", "seen", limit)
    best = best.where((F.col("list") == "papers") | (F.col("report_rank") <= reports.BLOG_LIMIT))
    return best.select("period", "list", "report_rank", "row_id", "story_id", "score")


_KEY = "coalesce('arxiv_id:' || lower(nullif(arxiv_id, '')), 'story_id:' || lower(nullif(story_id, '')), 'url:' || lower(nullif(url, '')), 'title:' || lower(trim(coalesce(title, ''))) || ':' || coalesce(published_at::VARCHAR, ''))"
_LINK, _LINK_SOURCE = "lower(coalesce(primary_link.link_type, ''))", "lower(coalesce(primary_link.source_id, ''))"
_LIST = f"""CASE WHEN coalesce(stories.arxiv_id, '') <> '' OR {_LINK} IN ('arxiv', 'paper', 'openreview') OR regexp_matches({_LINK_SOURCE}, '^arxiv-|^axv-|^hf-daily-papers$|^hub-daily-papers$') THEN 'papers'
  WHEN {_LINK} IN ('article', 'blog', 'html', 'official') OR {_LINK_SOURCE} = 'plume-notes' OR contains({_LINK_SOURCE}, 'blog') THEN 'blogs' END"""


def _candidates_sql(kind: str) -> str:
    """The records of the sections papers, top5 and radar (in this order) that a list takes, by the period of their publication (else of
    their archive), from the archives of that period's days and of the day after."""
    name = "strftime(local, '%G-W%V')" if kind == "week" else "strftime(local, '%Y-%m')"
    last = "(date_trunc('week', local)::DATE + 6)" if kind == "week" else "(date_trunc('month', local) + INTERVAL 1 MONTH)::DATE - 1"
    return f"""{SCORED}, x AS (SELECT row_id, list_position(['papers', 'top5', 'radar'], section) AS sec, {_LIST} AS list FROM stories WHERE section IN ('papers', 'top5', 'radar')),
m AS (SELECT scored.*, x.sec, x.list, coalesce((published_at AT TIME ZONE 'UTC')::DATE, digest_date) AS local, {_KEY} AS key FROM scored JOIN x USING (row_id) WHERE x.list IS NOT NULL),
c AS (SELECT *, {name} AS period FROM m WHERE digest_date >= date_trunc('{kind}', local)::DATE AND digest_date <= {last} + 1)"""


def _report_sql(kind: str, limit: int) -> str:
    return f"""WITH {_candidates_sql(kind)}, u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY period, list, key ORDER BY coalesce(score, 0) DESC, digest_date, sec, row_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY period, list ORDER BY score DESC, coalesce(epoch_us(published_at), 0) DESC, lower(coalesce(title, '')), digest_date, sec, row_id) AS report_rank FROM u)
SELECT period, list, report_rank::INT AS report_rank, row_id, story_id, score FROM r WHERE report_rank <= {limit} AND (list = 'papers' OR report_rank <= 30)"""


@query
def report_weekly(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "week", 30)


oracle("report_weekly", _report_sql("week", 30))


@query
def report_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return _report(spark, folder, "month", 100)


oracle("report_monthly", _report_sql("month", 100))


@query
def report_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Of each week's lists the records considered and the stories left once doubles are gone."""
    rows = _candidates(spark, folder, "week").groupBy("period", "list", "key").agg(F.count("*").alias("n"))
    return rows.groupBy("period", "list").agg(F.sum("n").alias("items_considered"), F.count("*").alias("stories_considered"))


oracle("report_counters", f"WITH {_candidates_sql('week')} SELECT period, list, count(*) AS items_considered, count(DISTINCT key) AS stories_considered FROM c GROUP BY 1, 2")


@query
def report_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Title and summary of each month's report: how many papers and blogs it recommends, of how many candidates, and how many days it covers."""
    picked = _report(spark, folder, "month", 100).groupBy("period").agg(F.count_if(F.col("list") == "papers").alias("papers"), F.count_if(F.col("list") == "blogs").alias("blogs"))
    considered = _candidates(spark, folder, "month").groupBy("period").agg(F.count_distinct("list", "key").alias("candidates"))
    days = table(spark, folder, "stories").select("digest_date").distinct().groupBy(periods.month_id(F.col("digest_date")).alias("period")).agg(F.count("*").alias("covered"))
    rows = picked.join(considered, "period").join(days, "period", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.select("period", reports.title_of(F.col("period"), "month").alias("title"), reports.summary_of(F.col("period"), "month", F.col("papers"), F.col("blogs"), F.col("covered"), periods.days_of_month(F.col("period")) - F.col("covered"), F.col("candidates")).alias("summary"))


oracle("report_texts", f"""WITH {_candidates_sql('month')}, pk AS (SELECT period, list, count(DISTINCT key) AS k FROM c GROUP BY 1, 2),
n AS (SELECT period, sum(CASE WHEN list = 'papers' THEN least(k, 100) ELSE 0 END)::BIGINT AS papers, sum(CASE WHEN list = 'blogs' THEN least(k, 30) ELSE 0 END)::BIGINT AS blogs, sum(k)::BIGINT AS candidates FROM pk GROUP BY 1),
d AS (SELECT strftime(digest_date, '%Y-%m') AS period, count(DISTINCT digest_date) AS covered FROM stories GROUP BY 1),
rb AS (SELECT n.*, coalesce(covered, 0) AS covered, day(last_day((period || '-01')::DATE)) - coalesce(covered, 0) AS missing FROM n LEFT JOIN d USING (period))
SELECT period, period || ' AI 研究月報' AS title, period || ' 月整理 ' || array_to_string(list_filter([CASE WHEN papers > 0 THEN papers || ' 篇 AI 論文' END, CASE WHEN blogs > 0 THEN blogs || ' 篇值得看的技術文章' END], lambda s: s IS NOT NULL), '與')
  || '。涵蓋 ' || covered || ' 天資料' || CASE WHEN missing > 0 THEN '，另有 ' || missing || ' 天缺資料' ELSE '，資料完整' END || '，共從 ' || candidates || ' 篇候選中篩選。' AS summary FROM rb""")


@query
def report_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all reports, latest first within their kind, and which is the latest; doubles of a period can't occur."""
    both = [_report(spark, folder, kind, limit).select(F.lit(name).alias("report_type"), "period") for kind, name, limit in (("week", "weekly", 30), ("month", "monthly", 100))]
    rows = both[0].unionByName(both[1]).groupBy("report_type", "period").agg(F.count("*").alias("recommendations"))
    return reports.indexed(rows)


oracle("report_index", f"""WITH a AS (SELECT 'weekly' AS report_type, period FROM ({_report_sql('week', 30)}) UNION ALL SELECT 'monthly', period FROM ({_report_sql('month', 100)})),
n AS (SELECT report_type, period, count(*) AS recommendations FROM a GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY report_type ORDER BY period DESC)::INT AS place, 'api/reports/' || report_type || '/' || period || '.json' AS path, sum(recommendations) OVER (PARTITION BY report_type)::BIGINT AS of_kind FROM n""")


@query
def report_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of the week and the month of every archived day, and the month before."""
    d = table(spark, folder, "stories").select(F.col("digest_date").alias("day")).distinct()
    return d.select("day", periods.week_id(F.col("day")).alias("week"), periods.week_start(F.col("day")).alias("week_start"), F.date_add(periods.week_start(F.col("day")), 6).alias("week_end"),
                    F.trunc("day", "month").alias("month_start"), F.last_day("day").alias("month_end"), periods.month_id(F.add_months(F.trunc("day", "month"), -1)).alias("month_before"))


oracle("report_periods", """SELECT DISTINCT digest_date AS day, strftime(digest_date, '%G-W%V') AS week, date_trunc('week', digest_date)::DATE AS week_start, date_trunc('week', digest_date)::DATE + 6 AS week_end,
  date_trunc('month', digest_date)::DATE AS month_start, last_day(digest_date) AS month_end, strftime(date_trunc('month', digest_date) - INTERVAL 1 MONTH, '%Y-%m') AS month_before FROM stories""")


@query
def report_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return reports.coverage(table(spark, folder, "stories").select(F.col("digest_date").alias("day")), "2025-01-01", "2025-12-31")


oracle("report_coverage", "SELECT day::DATE AS day, day::DATE IN (SELECT digest_date FROM stories) AS covered FROM range(DATE '2025-01-01', DATE '2026-01-01', INTERVAL 1 DAY) t(day)")


@query
def report_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The three most frequent link types of each month's links."""
    rows = table(spark, folder, "stories").select(periods.month_id(F.col("digest_date")).alias("month"), F.explode("links").alias("l"))
    counts = rows.groupBy("month", F.col("l.link_type").alias("link_type")).agg(F.count("*").alias("n"))
    return ranking.first_rows(counts, ["month"], F.struct(-F.col("n"), "link_type"), 3).select("month", "link_type", "n", "place")


oracle("report_categories", """WITH c AS (SELECT strftime(digest_date, '%Y-%m') AS month, l.link_type AS link_type, count(*) AS n FROM (SELECT digest_date, unnest(links) AS l FROM stories) GROUP BY 1, 2)
SELECT month, link_type, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY n DESC, link_type) AS place FROM c) WHERE place <= 3""")
