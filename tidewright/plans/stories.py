"""Queries of linking: groups, links, primary link, duplicates across sources, entities and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import ids
from tidewright.functions.text import canonical_name, strict_json
from tidewright.operators import linking, ranking
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.scalars import _NORMAL, _STABLE, ARXIV, MODEL, NFKD, RELEASE, q
from tidewright.session import table

ENTITIES = {"velora": ["velora"], "kestrelab": ["kestrelab"], "mirandel": ["mirandel"], "osprion": ["osprion"], "retrieval": ["retrieval gating", "retrieval indexes"]}
TOPICS = {"routing": (["sparse routing", "mixture routing"], 1.2), "planning": (["latent planning"], 1.0), "speech": (["speech", "asr"], 0.8), "tables": (["table understanding", "spreadsheet"], 0.6)}
_SOURCE = r"nullif(regexp_replace(lower(trim(source_id)), '[_\s]+', '-', 'g'), '')"


def _grouped(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items")
    stable = ids.stable_id(F.col("url"), F.get_json_object(strict_json(F.col("raw_json")), "$.arxiv_id"), ARXIV, MODEL, RELEASE)
    fallback = ids.fallback_id(F.col("title"), F.lit(None).cast("string"), F.col("first_seen_at"))
    confidence = F.lower(F.trim("date_confidence"))
    return items.select(F.coalesce(stable, fallback).alias("story_id"), stable.isNotNull().alias("stable"), "row_id", "url", "title", "tier", canonical_name(F.col("source_id")).alias("source"), confidence.alias("confidence"), "published_at", "first_seen_at")


@query
def story_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Items grouped by stable identifier, else by hashed title and day; the date by the surest confidence, first of equals."""
    rows = _grouped(spark, folder)
    dated = F.when(F.col("published_at").isNotNull(), F.struct(F.coalesce("confidence", F.lit("~")).alias("c"), F.col("row_id").alias("r"), F.col("published_at").alias("p")))
    return rows.groupBy("story_id").agg(
        F.count("*").alias("item_count"), F.count_distinct("source").alias("sources"), F.min("first_seen_at").alias("first_seen"),
        F.min(dated)["p"].alias("published_at"), F.min(F.struct("row_id", "title"))["title"].alias("title"),
    )


_GROUPED = f"""g AS (SELECT coalesce({_STABLE}, 'fallback:' || substr(sha256(concat_ws('|', {_NORMAL}, 'unknown', coalesce(strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d'), 'unknown'))), 1, 16)) AS story_id,
  {_STABLE} IS NOT NULL AS stable, row_id, url, title, tier, {_SOURCE} AS source, lower(trim(date_confidence)) AS confidence, published_at, first_seen_at FROM items, {NFKD})"""
oracle("story_groups", f"""WITH {_GROUPED} SELECT story_id, count(*) AS item_count, count(DISTINCT source) AS sources, min(first_seen_at) AS first_seen,
  arg_min(published_at, (coalesce(confidence, '~'), row_id)) FILTER (published_at IS NOT NULL) AS published_at, arg_min(title, row_id) FILTER (title IS NOT NULL) AS title FROM g GROUP BY 1""")


@query
def merge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups have one or more items, and how many were merged without a stable identifier."""
    groups = _grouped(spark, folder).groupBy("story_id", "stable").agg(F.count("*").alias("n"))
    merged = F.col("n") > 1
    return groups.agg(
        F.count("*").alias("stories"), F.count_if(merged).alias("merges"), F.count_if(merged & ~F.col("stable")).alias("fallback_merges"),
        F.round(F.coalesce(F.count_if(merged & ~F.col("stable")) / F.nullif(F.count_if(merged), F.lit(0)), F.lit(0.0)), 6).alias("fallback_ratio"),
    )


oracle("merge_counts", f"""WITH {_GROUPED}, n AS (SELECT story_id, stable, count(*) AS n FROM g GROUP BY 1, 2)
SELECT count(*) AS stories, count(*) FILTER (n > 1) AS merges, count(*) FILTER (n > 1 AND NOT stable) AS fallback_merges,
  round(coalesce(count(*) FILTER (n > 1 AND NOT stable) / nullif(count(*) FILTER (n > 1), 0)::DOUBLE, 0), 6) AS fallback_ratio FROM n""")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "stories").where(F.col("story_id").isNotNull()).select("story_id", "row_id", F.posexplode("links").alias("p", "l"))
    rows = rows.select("story_id", (F.col("row_id") * 1000 + F.col("p")).alias("seq"), "l.url", "l.link_type", "l.tier", "l.source_id")
    return linking.distinct_links(rows, "story_id", ["tier", "source_id"], "seq")


_LINKS = """x AS (SELECT story_id, row_id, unnest(links) AS l, unnest(range(len(links))) AS p FROM stories WHERE story_id IS NOT NULL),
d AS (SELECT story_id, l.link_type AS link_type, l.url AS url, row_id * 1000 + p AS seq, l.tier AS tier, l.source_id AS source_id FROM x),
links AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY story_id, link_type, url ORDER BY seq) = 1)"""


@query
def story_links(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder)


oracle("story_links", f"WITH {_LINKS} SELECT story_id, link_type, url, seq, tier, source_id FROM links")


@query
def primary_link(spark: SparkSession, folder: str) -> DataFrame:
    return linking.primary(_links(spark, folder), "story_id", "seq")


_PREF = "CASE link_type " + " ".join(f"WHEN {q(v)} THEN {k}" for k, v in enumerate(linking.PREFERRED)) + f" ELSE {len(linking.PREFERRED)} END"
_OUT = f"coalesce(link_type NOT IN ({', '.join(q(v) for v in linking.ALLOWED)}), false)"
oracle("primary_link", f"""WITH {_LINKS}, r AS (SELECT *, count(*) OVER (PARTITION BY story_id) AS n_links, row_number() OVER (PARTITION BY story_id ORDER BY {_OUT}, CASE WHEN {_OUT} THEN 0 ELSE {_PREF} END,
  CASE WHEN {_OUT} THEN 0 ELSE coalesce(tier, 9) END, seq) AS rn FROM links) SELECT story_id, n_links, url, link_type, tier FROM r WHERE rn = 1""")


@query
def cross_source_papers(spark: SparkSession, folder: str) -> DataFrame:
    """One record per paper over all sources, by preference; certainty falls where the sightings lie over a day apart."""
    rows = table(spark, folder, "items").select("row_id", ids.arxiv_id(F.col("url"), ARXIV).alias("paper"), canonical_name(F.col("source_id")).alias("source"), "published_at", F.lower(F.trim("date_confidence")).alias("confidence"), F.col("first_seen_at").alias("when"))
    return linking.distinct_papers(rows, "paper", F.coalesce(F.col("source").startswith("axv-api"), F.lit(False)), F.col("published_at").isNotNull(), F.col("confidence"), "row_id")


oracle("cross_source_papers", f"""WITH r AS (SELECT row_id, regexp_replace(nullif(regexp_extract(url, {q(ARXIV)}, 1), ''), '(?i)v\\d+$', '') AS paper, {_SOURCE} AS source, published_at, lower(trim(date_confidence)) AS confidence, first_seen_at AS w FROM items),
k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY NOT coalesce(starts_with(source, 'axv-api'), false), published_at IS NULL, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, row_id) AS rn FROM r WHERE paper IS NOT NULL),
a AS (SELECT paper, count(DISTINCT source) AS sources, count(*) AS records, epoch_us(max(w)) - epoch_us(min(w)) > 86400000000 AS apart FROM k GROUP BY 1)
SELECT paper, row_id AS kept, sources, records, CASE WHEN apart THEN 'medium' ELSE confidence END AS confidence FROM k JOIN a USING (paper) WHERE rn = 1""")


@query
def entity_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "items").select("row_id", F.concat_ws(" ", "title", "raw_json").alias("text"), F.coalesce("title", F.lit("")).alias("title"))
    return linking.entity_hits(rows, "row_id", F.col("text"), F.col("title"), ENTITIES)


def _entity_sql(e: str, ws: list[str]) -> str:
    hits = " + ".join(rf"regexp_matches(t, '(?i)\b{w}\b')::INT + contains(lower(ti), '{w}')::INT" for w in ws)
    return f"SELECT row_id, '{e}' AS entity, {hits} AS hits FROM x"


oracle("entity_match", "WITH x AS (SELECT row_id, concat_ws(' ', title, raw_json) AS t, coalesce(title, '') AS ti FROM items) SELECT * FROM (" + " UNION ALL ".join(_entity_sql(e, ws) for e, ws in ENTITIES.items()) + ") WHERE hits > 0")


@query
def topic_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Stories per topic, by title."""
    found = F.array_compact(F.array(*[F.when(F.col("title").rlike(ranking.keyword_pattern(ws)), F.lit(t)) for t, (ws, _) in TOPICS.items()]))
    return table(spark, folder, "stories").select(F.explode(found).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


oracle("topic_hits", " UNION ALL ".join(f"SELECT '{t}' AS topic, count(*) AS n FROM stories WHERE regexp_matches(title, {q(ranking.keyword_pattern(ws))})" for t, (ws, _) in TOPICS.items()))


@query
def story_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of a story over its records, each once, in order of first appearance."""
    rows = table(spark, folder, "stories").where(F.col("story_id").isNotNull()).select("story_id", "row_id", F.posexplode("entities").alias("p", "entity"))
    first = rows.groupBy("story_id", "entity").agg(F.min(F.struct("row_id", "p")).alias("o"))
    return first.groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "entity"))), lambda s: s["entity"]).alias("e")).select("story_id", F.array_join("e", ",").alias("entities"))


oracle("story_entities", """WITH x AS (SELECT story_id, row_id, unnest(entities) AS entity, unnest(range(len(entities))) AS p FROM stories WHERE story_id IS NOT NULL),
f AS (SELECT story_id, entity, min((row_id, p)) AS o FROM x GROUP BY 1, 2) SELECT story_id, string_agg(entity, ',' ORDER BY o) AS entities FROM f GROUP BY 1""")


@query
def semantic_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The closest topics of each vector; the first vector of each label serves as the topic."""
    rows = table(spark, folder, "embeddings")
    topics = rows.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("r")).select(F.col("label").alias("topic"), F.col("r.embedding").alias("vector"))
    return ranking.semantic_matches(rows.withColumnRenamed("embedding", "vector"), topics, "vec_id", "vector", "topic")


oracle("semantic_topk", """WITH t AS (SELECT label AS topic, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1),
s AS (SELECT vec_id, topic, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS sim FROM embeddings, t)
SELECT vec_id, topic, sim, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS place FROM s WHERE sim >= 0.5) WHERE place <= 3""")
