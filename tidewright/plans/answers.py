"""Queries on judgements of language models and on what a run drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_name, strict_json
from tidewright.operators import answers, quota, ranking
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.ranking import _SOURCE, SCORED, scored
from tidewright.plans.scalars import STRICT, q
from tidewright.session import table

WEIGHT, THRESHOLD = 10.0, 0.6
KEYWORDS = ["robot instruction", "music tagging"]


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """story_id, relevance: every story's judgement, read back from an answer as a model would write it: fenced, identifiers whole, in
    brackets or without their kind, components missing, beyond their range or no numbers."""
    n = F.col("n")
    stories = table(spark, folder, "stories").where(F.col("story_id").isNotNull()).groupBy("story_id").agg(F.min("row_id").alias("n"), F.max(F.col("arxiv_id").isNotNull()).alias("paper"))
    named = F.when(n % 3 == 0, F.col("story_id")).when(n % 3 == 1, F.element_at(F.split("story_id", ":"), -1)).otherwise(F.concat(F.lit("["), "story_id", F.lit("]")))
    part = lambda k, m: F.struct(F.lit(k).alias("key"), ((n % m) / F.lit(float(m - 1))).cast("string").alias("value"))
    parts = F.filter(F.array(
        part("preference_relevance", 13), part("novelty", 7), F.struct(F.lit("rigor").alias("key"), F.when(n % 5 == 0, "n/a").otherwise(((n % 5) / 2.0).cast("string")).alias("value")),
        part("evidence_strength", 3), F.struct(F.when(n % 4 > 0, "generalizability").alias("key"), F.lit("0.25").alias("value")),
    ), lambda s: s["key"].isNotNull())
    components = F.when(n % 11 > 0, F.map_from_entries(parts)).otherwise(F.create_map().cast("map<string,string>"))
    entry = F.struct(named.alias("id"), components.alias("components"), ((n % 17) / 10.0).cast("string").alias("score"))
    text = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.array(entry)), F.lit("\n```\nDone."))
    found = answers.entries(stories.select("paper", text.alias("answer")), "answer").select("entry", "paper")
    whole = answers.resolved(found, F.col("entry.id"), table(spark, folder, "stories"), "story_id")
    return whole.select("story_id", F.round(answers.weighted(F.col("entry.components"), F.col("entry.score"), F.when(F.col("paper"), 1.0).otherwise(0.8)), 9).alias("relevance"))


@query
def llm_relevance(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder)


_JUDGED = """jn AS (SELECT story_id, min(row_id) AS n, bool_or(arxiv_id IS NOT NULL) AS paper, string_split(story_id, ':')[-1] AS suffix FROM stories WHERE story_id IS NOT NULL GROUP BY story_id),
jc AS (SELECT *, count(*) OVER (PARTITION BY suffix) AS same FROM jn),
judged AS (SELECT story_id, round(greatest(0, least(1, (CASE WHEN n % 11 > 0 THEN 0.40::DOUBLE * (n % 13) / 12.0 + 0.15::DOUBLE * (n % 7) / 6.0 + 0.15::DOUBLE * CASE WHEN n % 5 = 0 THEN 0.5 ELSE least(1.0, (n % 5) / 2.0) END
    + 0.15::DOUBLE * (n % 3) / 2.0 + CASE WHEN n % 4 > 0 THEN 0.025::DOUBLE ELSE 0 END ELSE least(1.0, (n % 17) / 10.0::DOUBLE) END) * CASE WHEN paper THEN 1.0 ELSE 0.8 END)), 9)::DOUBLE AS relevance FROM jc WHERE n % 3 <> 1 OR same = 1)"""
oracle("llm_relevance", f"WITH {_JUDGED} SELECT story_id, relevance FROM judged")


@query
def score_with_llm(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's score with the judgement of its story (none: 0), and whether that lets it pass quotas."""
    rows = scored(spark, folder).join(_judged(spark, folder), "story_id", "left")
    llm = F.coalesce("relevance", F.lit(0.0)) * WEIGHT
    return rows.select("row_id", F.round(llm, 6).alias("llm_score"), F.round(F.col("score") + llm, 6).alias("total"), answers.passes(llm, WEIGHT, THRESHOLD).alias("passes"))


oracle("score_with_llm", f"""WITH {SCORED}, {_JUDGED} SELECT row_id, round(coalesce(relevance, 0) * {WEIGHT}::DOUBLE, 6) AS llm_score, round(score + coalesce(relevance, 0) * {WEIGHT}::DOUBLE, 6) AS total,
  coalesce(relevance, 0) >= {THRESHOLD} AS passes FROM scored LEFT JOIN judged USING (story_id)""")


@query
def score_range(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest and highest score of each day."""
    return scored(spark, folder).groupBy("digest_date").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count("*").alias("n"))


oracle("score_range", f"WITH {SCORED} SELECT digest_date, min(score) AS lowest, max(score) AS highest, count(*) AS n FROM scored GROUP BY 1")


def _dropped(spark: SparkSession, folder: str) -> DataFrame:
    raw = strict_json(F.col("raw_json"))
    field = lambda k: F.get_json_object(raw, f"$.{k}")
    rows = table(spark, folder, "items").select(
        "row_id", canonical_name(F.col("source_id")).alias("source"), F.get(F.from_json(field("categories"), "array<string>"), F.lit(0)).alias("category"), "score", F.col("first_seen_at").alias("seen"), "url",
        (canonical_name(F.col("kind")) == "paper").alias("paper"), F.concat_ws(" ", "title", field("abstract_snippet"), field("summary")).alias("text"),
    )
    order = ranking.best_first(F.col("score"), F.col("seen"), ranking.by_address(F.col("url"), F.col("row_id")))
    good = answers.passes(F.when(~F.isnan("score"), F.col("score")), 10.0, 0.95)
    return quota.drops(rows, quota.excluded_by(F.col("text"), KEYWORDS, F.col("paper")), "source", "category", order, 20, 30, good)


@query
def quota_drops(spark: SparkSession, folder: str) -> DataFrame:
    """Every item that exclusion, the cap of its source or then that of its category drops, with the reason."""
    return _dropped(spark, folder).where(F.col("reason").isNotNull()).select("row_id", "source", "reason")


_HIT = "CASE WHEN paper AND contains(txt, {0}) THEN {1} END"
_DROPS = f"""r AS (SELECT row_id, {_SOURCE.format('source_id')} AS source, json_extract_string({STRICT}, '$.categories[0]') AS category, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, first_seen_at, url,
    {_SOURCE.format('kind')} = 'paper' AS paper, lower(concat_ws(' ', title, json_extract_string({STRICT}, '$.abstract_snippet'), json_extract_string({STRICT}, '$.summary'))) AS txt FROM items),
e AS (SELECT *, coalesce({', '.join(_HIT.format(q(k), q(k)) for k in KEYWORDS)}) AS kw, coalesce(score >= 9.5, false) AS good FROM r),
s AS (SELECT *, source IS NULL OR good OR row_number() OVER (PARTITION BY source ORDER BY score DESC NULLS LAST, first_seen_at DESC NULLS LAST, url NULLS LAST, row_id) <= 20 AS ok FROM e WHERE kw IS NULL),
c AS (SELECT *, category IS NULL OR good OR row_number() OVER (PARTITION BY category ORDER BY score DESC NULLS LAST, first_seen_at DESC NULLS LAST, url NULLS LAST, row_id) <= 30 AS ok2 FROM s WHERE ok),
drops AS (SELECT row_id, source, 'paper_exclusion_keyword:' || kw AS reason FROM e WHERE kw IS NOT NULL UNION ALL SELECT row_id, source, 'per_source_max:' || source FROM s WHERE NOT ok
  UNION ALL SELECT row_id, source, 'arxiv_category:' || category FROM c WHERE NOT ok2)"""
oracle("quota_drops", f"WITH {_DROPS} SELECT row_id, source, reason FROM drops")


@query
def drops_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Dropped items by kind of reason and by source."""
    rows = _dropped(spark, folder).where(F.col("reason").isNotNull()).select(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason"), "source")
    return rows.groupingSets([["reason"], ["source"], ["reason", "source"]], "reason", "source").agg(F.count("*").alias("n"))


oracle("drops_by_reason", f"WITH {_DROPS} SELECT split_part(reason, ':', 1) AS reason, source, count(*) AS n FROM (SELECT split_part(reason, ':', 1) AS reason, source FROM drops) GROUP BY GROUPING SETS ((reason), (source), (reason, source))")
