"""Queries of what readers see: recent records, groups, filters and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import display
from tidewright.functions.text import canonical_name, strict_json
from tidewright.operators import ranking
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.scalars import STRICT, q
from tidewright.session import table

_SOURCE = r"nullif(regexp_replace(lower(trim({0})), '[_\s]+', '-', 'g'), '')"
# The invented sources of the test tables, in the places of the public ones.
JAPANESE = ("hoshizora-tech", "kawabe-tech", "minato-tech", "sorairo-tech")
KINDS = ((r"^axv-|^review-", "arxiv"), (r"^hub-", "huggingface"), (r"-(blog|notes|tech)$", "blog"))


@query
def recent_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each day, all of them and those published within the day before its end, by section and in all."""
    end = F.date_add("digest_date", 1).cast("timestamp")
    rows = table(spark, folder, "stories").select("digest_date", F.coalesce("section", F.lit("none")).alias("section"), F.coalesce(F.col("published_at") >= end - F.expr("INTERVAL 24 HOURS"), F.lit(False)).alias("recent"))
    return rows.rollup("digest_date", "section").agg(F.count("*").alias("n"), F.count_if("recent").alias("recent")).where(F.col("digest_date").isNotNull())


oracle("recent_totals", """SELECT digest_date, section, count(*) AS n, count(*) FILTER (recent) AS recent FROM (SELECT digest_date, coalesce(section, 'none') AS section,
  coalesce(published_at >= ((digest_date + 1)::TIMESTAMP AT TIME ZONE 'UTC') - INTERVAL 24 HOURS, false) AS recent FROM stories) GROUP BY ROLLUP (digest_date, section) HAVING digest_date IS NOT NULL""")


@query
def papers_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by their first category, the largest first."""
    category = F.get(F.from_json(F.get_json_object(strict_json(F.col("raw_json")), "$.categories"), "array<string>"), F.lit(0))
    rows = table(spark, folder, "items").where(canonical_name(F.col("kind")) == "paper").groupBy(F.coalesce(category, F.lit("Uncategorized")).alias("category")).agg(F.count("*").alias("n"), F.max("first_seen_at").alias("newest"))
    return rows.withColumn("place", F.row_number().over(ranking.Window.orderBy(F.desc("n"), "category")))  # a row per category


oracle("papers_by_category", f"""SELECT category, n, newest, row_number() OVER (ORDER BY n DESC, category)::INT AS place FROM (SELECT coalesce(json_extract_string({STRICT}, '$.categories[0]'), 'Uncategorized') AS category, count(*) AS n, max(first_seen_at) AS newest
  FROM items WHERE {_SOURCE.format('kind')} = 'paper' GROUP BY 1)""")


def _kind(source: F.Column) -> F.Column:
    out = F.lit("other")
    for pattern, name in reversed(KINDS):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(source, {q(p)}) THEN {q(n)}" for p, n in KINDS) + " ELSE 'other' END"


@query
def source_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Stories' sources by kind of source, in each the largest first, with the newest record and the best title as top pick."""
    rows = table(spark, folder, "stories").select(canonical_name(F.col("primary_link.source_id")).alias("source"), "published_at", "row_id").where(F.col("source").isNotNull())
    groups = rows.groupBy("source").agg(F.count("*").alias("n"), F.max("published_at").alias("newest"), F.max(F.struct(F.coalesce(F.unix_micros("published_at"), F.lit(0)).alias("t"), (-F.col("row_id")).alias("r")))["r"].alias("pick"))
    groups = groups.withColumn("kind", _kind(F.col("source"))).withColumn("top_pick", -F.col("pick")).drop("pick")
    return groups.withColumn("place", F.row_number().over(ranking.Window.partitionBy("kind").orderBy(F.desc("n"), "source")))  # a row per source


oracle("source_groups", f"""WITH g AS (SELECT {_SOURCE.format('primary_link.source_id')} AS source, count(*) AS n, max(published_at) AS newest, arg_max(row_id, (coalesce(epoch_us(published_at), 0), -row_id)) AS top_pick FROM stories GROUP BY 1)
SELECT source, n, newest, top_pick, {_KIND} AS kind, row_number() OVER (PARTITION BY {_KIND} ORDER BY n DESC, source)::INT AS place FROM g WHERE source IS NOT NULL""")


@query
def status_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Which filters of the status page show each source, and whether it is a Japanese one."""
    s = table(spark, folder, "source_status")
    source, status = canonical_name(F.col("source_id")), F.col("status")
    return s.select(source.alias("source"), F.coalesce(status == "HAS_UPDATE", F.lit(False)).alias("has_update"), F.coalesce(status == "NO_UPDATE", F.lit(False)).alias("no_change"),
                    F.coalesce(status.isin("FETCH_FAILED", "PARSE_FAILED"), F.lit(False)).alias("failed"), F.coalesce(source.isin(*JAPANESE), F.lit(False)).alias("japanese"))


oracle("status_filters", f"""SELECT {_SOURCE.format('source_id')} AS source, coalesce(status = 'HAS_UPDATE', false) AS has_update, coalesce(status = 'NO_UPDATE', false) AS no_change, coalesce(status IN ('FETCH_FAILED', 'PARSE_FAILED'), false) AS failed,
  coalesce({_SOURCE.format('source_id')} IN ({', '.join(q(s) for s in JAPANESE)}), false) AS japanese FROM source_status""")


@query
def summary_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries without an end or that describe a picture, and which records can be judged or read in full."""
    s = F.col("summary")
    paper = F.col("arxiv_id").isNotNull() | F.coalesce(F.exists("links", lambda l: F.coalesce(l["link_type"] == "arxiv", F.lit(False))), F.lit(False))
    return table(spark, folder, "stories").select("row_id", display.lacks_end(s).alias("lacks_end"), display.describes_picture(s).alias("picture"), (F.col("arxiv_id").isNotNull() | F.coalesce(F.trim(s) != "", F.lit(False))).alias("evaluatable"), paper.alias("full_text"))


oracle("summary_flags", """SELECT row_id, coalesce(summary <> '' AND right(rtrim(summary), 1) NOT IN ('。', '！', '？', '.', '!', '?', '」'), false) AS lacks_end,
  coalesce(regexp_matches(trim(summary), '(?i)^illustration\\s+of\\s+|^image\\s+of\\s+|^photo\\s+of\\s+|^screenshot\\s+of\\s+|^diagram\\s+(of|showing)\\s+|^figure\\s+\\d+|^a\\s+(photo|image|illustration)\\s+'), false) AS picture,
  arxiv_id IS NOT NULL OR coalesce(trim(summary) <> '', false) AS evaluatable, arxiv_id IS NOT NULL OR coalesce(len(list_filter(links, lambda l: l.link_type = 'arxiv')) > 0, false) AS full_text FROM stories""")


@query
def model_labels(spark: SparkSession, folder: str) -> DataFrame:
    """What a card shows of each model: downloads, task and owner."""
    m = table(spark, folder, "models")
    return m.select("row_id", display.short_number(F.col("downloads")).alias("downloads"), display.tag_label(F.col("pipeline_tag")).alias("task"), F.when(F.col("downloads") >= 1000, "many").otherwise("few").alias("reach"))


oracle("model_labels", """SELECT row_id, CASE WHEN downloads >= 1000000 THEN printf('%.1f', round(downloads / 1000000.0, 1)) || 'M' WHEN downloads >= 1000 THEN printf('%.1f', round(downloads / 1000.0, 1)) || 'K' ELSE downloads::VARCHAR END AS downloads,
  array_to_string(list_transform(string_split(pipeline_tag, '-'), lambda w: upper(w[1:1]) || w[2:]), ' ') AS task, CASE WHEN downloads >= 1000 THEN 'many' ELSE 'few' END AS reach FROM models""")


@query
def author_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The authors of each item as one line, and its age at the end of 2026 in words."""
    authors = F.from_json(F.get_json_object(strict_json(F.col("raw_json")), "$.authors"), "array<string>")
    return table(spark, folder, "items").select("row_id", display.author_line(authors).alias("authors"), display.age_label(F.col("first_seen_at"), F.lit("2026-12-31").cast("timestamp")).alias("age"))


_AUTHORS = f"json_extract({STRICT}, '$.authors')::VARCHAR[]"
_MINUTES = "floor((epoch_us(TIMESTAMPTZ '2026-12-31 00:00:00+00') - epoch_us(first_seen_at)) / 60000000.0)::BIGINT"
oracle("author_lines", f"""WITH a AS (SELECT row_id, first_seen_at, {_AUTHORS} AS au, {_MINUTES} AS m FROM items)
SELECT row_id, CASE WHEN len(au) > 3 THEN array_to_string(au[1:3], ', ') || ' +' || (len(au) - 3) || ' more' WHEN len(au) > 0 THEN array_to_string(au, ', ') END AS authors,
  CASE WHEN first_seen_at IS NULL THEN '' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m // 1440 = 1 THEN 'Yesterday' WHEN m // 1440 < 7 THEN (m // 1440) || 'd ago' WHEN m // 1440 < 30 THEN (m // 10080) || 'w ago'
  ELSE strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d') END AS age FROM a""")


@query
def retry_delays(spark: SparkSession, folder: str) -> DataFrame:
    """The waits before the first six attempts at every source."""
    s = table(spark, folder, "source_status").select(canonical_name(F.col("source_id")).alias("source"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("attempt"))
    return s.select("source", "attempt", display.backoff_ms(F.col("attempt")).alias("delay_ms"))


oracle("retry_delays", f"SELECT {_SOURCE.format('source_id')} AS source, a::INT AS attempt, least(1000 * pow(2, a), 30000)::BIGINT AS delay_ms FROM source_status, range(6) t(a)")
