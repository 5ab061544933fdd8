"""Queries over the test tables, by problem, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_name
from tidewright.llm import bpe, contributor_caps, entity_matching, packing, pair_defects, splitting, survivorship, titles, truncation
from tidewright.session import cut_lineage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return entity_matching.found(table(spark, folder, "items"), table(spark, folder, "stories"))


@query
def p1_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """The best story of each item that has a candidate at all, with its confidence."""
    return entity_matching.matched(table(spark, folder, "items"), table(spark, folder, "stories"))


@query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defects(table(spark, folder, "translations_zh"), table(spark, folder, "stories"))


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivorship.surviving_fields(table(spark, folder, "stories"))


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FLAW = "(?i)" + "|".join((titles.MARKUP, titles.ENTITY, titles.MISDECODED, titles.CUT_MARK, titles.PREFIX.replace("(?i)", ""), titles.SUFFIX, r"^\s|\s$"))
_CORE = f"regexp_replace(regexp_replace(title, {_re(titles.MARKUP)}, '', 'g'), {_re(titles.ENTITY)}, ' ', 'g')"
_CORE = f"regexp_replace(regexp_replace({_CORE}, {_re(titles.PREFIX)}, ''), {_re(titles.SUFFIX)}, '')"
_CORE = rf"trim(regexp_replace(regexp_replace({_CORE}, {_re(titles.CUT_MARK)}, ''), '\s+', ' ', 'g'))"
ORACLE["p4_found"] = f"""
WITH marked AS (
  SELECT *, coalesce(title IS NOT NULL AND NOT regexp_matches(title, {_re(titles.PLACEHOLDERS)}), false) AS usable,
    coalesce(regexp_matches(trim(primary_link.url), {_re(survivorship.WEB_ADDRESS)}), false) AS web,
    coalesce(published_at < (digest_date + 1)::TIMESTAMP AT TIME ZONE 'UTC', false) AS in_time,
    count(*) OVER (PARTITION BY story_id) AS n
  FROM stories WHERE story_id IS NOT NULL),
titled AS (
  SELECT *, usable AND NOT regexp_matches(title, {_re(_FLAW)}) AS whole, CASE WHEN usable THEN {_CORE} ELSE '' END AS core FROM marked WHERE n >= 2),
voted AS (
  SELECT *, CASE WHEN max(whole) OVER (PARTITION BY story_id, core) THEN count(*) OVER (PARTITION BY story_id, core) ELSE 0 END AS support FROM titled),
ranked AS (
  SELECT story_id, row_id,
    row_number() OVER (PARTITION BY story_id ORDER BY whole DESC, length(CASE WHEN whole THEN trim(title) END) DESC NULLS LAST, support DESC, row_id) AS rt,
    row_number() OVER (PARTITION BY story_id ORDER BY web DESC, CASE WHEN web THEN primary_link.tier END NULLS LAST, row_id) AS rl,
    row_number() OVER (PARTITION BY story_id ORDER BY in_time DESC, CASE WHEN in_time THEN published_at END DESC NULLS LAST, row_id) AS rp
  FROM voted)
SELECT story_id, 'title' AS field_name, row_id FROM ranked WHERE rt = 1
UNION ALL SELECT story_id, 'primary_link', row_id FROM ranked WHERE rl = 1
UNION ALL SELECT story_id, 'published_at', row_id FROM ranked WHERE rp = 1
"""


@query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.cut_records(*(table(spark, folder, t) for t in ("translations_zh", "releases", "items")))


@query
def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source (of translations: each model) cuts its texts."""
    texts = truncation.texts_of(*(table(spark, folder, t) for t in ("translations_zh", "releases", "items")))
    return truncation.rates(truncation.judged(truncation.scored_values(texts)))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items")
    n = items.count()
    category = (
        table(spark, folder, "source_status")
        .select(canonical_name(F.col("source_id")).alias("k"), canonical_name(F.col("category")).alias("g"))
        .groupBy("k")
        .agg(F.min("g").alias("g"))
    )
    return contributor_caps.over_two_caps(items, canonical_name(F.col("source_id")), category, F.col("score"), F.col("row_id"), n // 20, n // 4)


_NAME = r"nullif(regexp_replace(lower(trim({0})), '[_\s]+', '-', 'g'), '')"
ORACLE["p6_found"] = f"""
WITH c AS (SELECT {_NAME.format('source_id')} AS k, min({_NAME.format('category')}) AS g FROM source_status GROUP BY 1),
r AS (SELECT row_id, {_NAME.format('source_id')} AS k, CASE WHEN isnan(score) THEN NULL ELSE score END AS v, count(*) OVER () AS n FROM items),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC NULLS LAST, row_id) AS rk FROM r),
l AS (SELECT s.*, c.g FROM s LEFT JOIN c USING (k) WHERE k IS NULL OR rk <= n // 20),
t AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC NULLS LAST, row_id) AS rg FROM l WHERE g IS NOT NULL)
SELECT row_id, 'source' AS cap FROM s WHERE k IS NOT NULL AND rk > n // 20
UNION ALL SELECT row_id, 'category' FROM t WHERE rg > n // 4
"""


@query
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"))


@query
def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"))


@query
def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full each container is."""
    return packing.containers(packing.packed(table(spark, folder, "documents")))


@query
def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "documents"))


@query
def p8_whole(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of any packing: every text once, its pieces without gaps, no container above the capacity."""
    assigned = cut_lineage(packing.packed(table(spark, folder, "documents")))
    texts = assigned.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_distinct("piece").alias("pieces"), F.sum("size").alias("sizes"), F.max(F.col("start") + F.col("size")).alias("end"))
    held = texts.agg(F.count("*").alias("documents"), F.count_if(F.col("rows") != F.col("pieces")).alias("twice"), F.count_if(F.col("sizes") != F.col("end")).alias("gaps"))
    full = packing.containers(assigned).agg(F.count_if(F.col("unused") < 0).alias("over"))
    return held.join(full, F.lit(True))  # one row each


ORACLE["p8_whole"] = "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS twice, 0::BIGINT AS gaps, 0::BIGINT AS over FROM documents"


@query
def p9_whole(spark: SparkSession, folder: str) -> DataFrame:
    """The texts put together again from their pieces without what these repeat, and whether every piece keeps to the size."""
    cut = splitting.pieces(table(spark, folder, "documents"))
    own = F.struct("piece", F.substring("text", F.col("overlap") + 1, F.length("text")).alias("own"))
    texts = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(own)).alias("p"), F.max("tokens").alias("most"))  # a group is one text
    whole = F.when(F.get("p", F.lit(0))["own"].isNotNull(), F.array_join(F.transform("p", lambda x: x["own"]), ""))
    return texts.select("doc_id", F.md5(whole).alias("digest"), F.length(whole).cast("bigint").alias("n"), (F.col("most") <= splitting.LIMIT).alias("within"))


ORACLE["p9_whole"] = "SELECT doc_id, md5(text) AS digest, length(text) AS n, true AS within FROM documents"
