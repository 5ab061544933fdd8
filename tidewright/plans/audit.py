"""Queries of runs, lookups, rules of health and what is kept of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import display, ids
from tidewright.functions.text import canonical_name, strict_json
from tidewright.operators import ranking, state
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.items import _EVENTS, _events
from tidewright.plans.scalars import CANONICAL_CTE, STRICT, canonical_item_url, q
from tidewright.plans.stories import _GROUPED, _grouped
from tidewright.session import table

_SOURCE = r"nullif(regexp_replace(lower(trim({0})), '[_\s]+', '-', 'g'), '')"


@query
def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run a day of observation: when it began and ended, what it saw, and whether it brought anything new."""
    e = _events(spark, folder).withColumn("run_id", F.date_format("first_seen_at", "yyyy-MM-dd"))
    return e.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.min("first_seen_at").alias("started_at"), F.max("first_seen_at").alias("finished_at"), F.count("*").alias("items"), (F.count_if(F.col("event") != "UNCHANGED") > 0).alias("success"))


_RUNS = "runs AS (SELECT strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS run_id, min(first_seen_at) AS started_at, max(first_seen_at) AS finished_at, count(*) AS items, count(*) FILTER (event <> 'UNCHANGED') > 0 AS success FROM ev WHERE first_seen_at IS NOT NULL GROUP BY 1)"
oracle("runs", f"{_EVENTS}, {_RUNS} SELECT * FROM runs")


@query
def last_run(spark: SparkSession, folder: str) -> DataFrame:
    """The last successful run."""
    return runs(spark, folder).where("success").orderBy(F.desc("finished_at"), "run_id").limit(1)


oracle("last_run", f"{_EVENTS}, {_RUNS} SELECT * FROM runs WHERE success ORDER BY finished_at DESC, run_id LIMIT 1")


@query
def address_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of the addresses that stories lead to, by canonical form."""
    known = state.current(_events(spark, folder), "url", ["first_seen_at", "row_id"], "first_seen_at", ["content_hash"])
    asked = table(spark, folder, "stories").select(canonical_item_url("primary_link.url").alias("url")).where("url <> ''").distinct()
    return asked.join(known, "url").select("url", "content_hash", "observations")


oracle("address_lookup", CANONICAL_CTE.replace("FROM items)", "FROM (SELECT -row_id AS row_id, primary_link.url AS url FROM stories UNION ALL SELECT row_id, url FROM items))").replace("CASE WHEN regexp_matches(url", "CASE WHEN regexp_matches(url") + f""", obs AS (SELECT canonical_url AS url, content_hash, first_seen_at, items.row_id FROM items JOIN canon USING (row_id)),
ev AS (SELECT *, row_number() OVER w = 1 OR content_hash IS DISTINCT FROM lag(content_hash) OVER w AS change FROM obs WINDOW w AS (PARTITION BY url ORDER BY first_seen_at, row_id)),
known AS (SELECT url, max_by(content_hash, (first_seen_at, row_id)) FILTER (change) AS content_hash, count(*) AS observations FROM ev GROUP BY 1)
SELECT url, content_hash, observations FROM known WHERE url IN (SELECT canonical_url FROM canon WHERE row_id < 0 AND canonical_url <> '')""")


@query
def seen_since(spark: SparkSession, folder: str) -> DataFrame:
    """Items first seen after an instant (that instant excluded), newest first: their place within their day."""
    rows = table(spark, folder, "items").where(F.col("first_seen_at") > F.lit("2026-01-01").cast("timestamp")).select("row_id", "first_seen_at", F.to_date("first_seen_at").alias("day"))
    order = ranking.best_first(F.lit(0.0), F.col("first_seen_at"), F.col("row_id"))
    return ranking.first_rows(rows, ["day"], order, 1_000_000_000).select("row_id", "day", "place")


oracle("seen_since", """SELECT row_id, (first_seen_at AT TIME ZONE 'UTC')::DATE AS day, row_number() OVER (PARTITION BY (first_seen_at AT TIME ZONE 'UTC')::DATE ORDER BY first_seen_at DESC, row_id)::INT AS place
FROM items WHERE first_seen_at > TIMESTAMPTZ '2026-01-01 00:00:00+00'""")


@query
def published_since(spark: SparkSession, folder: str) -> DataFrame:
    """Releases published after an instant and made known since another; undated ones are left out."""
    r = table(spark, folder, "releases")
    return r.where((F.col("published_at") > F.lit("2024-01-01").cast("timestamp")) & (F.col("created_at") >= F.lit("2023-12-01").cast("timestamp"))).select("row_id", "published_at")


oracle("published_since", "SELECT row_id, published_at FROM releases WHERE published_at > TIMESTAMPTZ '2024-01-01 00:00:00+00' AND created_at >= TIMESTAMPTZ '2023-12-01 00:00:00+00'")


@query
def latest_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty items of each source that were seen last."""
    rows = table(spark, folder, "items").select("row_id", canonical_name(F.col("source_id")).alias("source"), "last_seen_at").where(F.col("source").isNotNull())
    return ranking.first_rows(rows, ["source"], ranking.best_first(F.lit(0.0), F.col("last_seen_at"), F.col("row_id")), 50).select("row_id", "source", "place")


oracle("latest_by_source", f"SELECT row_id, source, place FROM (SELECT row_id, {_SOURCE.format('source_id')} AS source, row_number() OVER (PARTITION BY {_SOURCE.format('source_id')} ORDER BY last_seen_at DESC NULLS LAST, row_id)::INT AS place FROM items) WHERE source IS NOT NULL AND place <= 50")


@query
def http_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of fetches after a run: sources that brought something have a new row, others keep theirs."""
    s = table(spark, folder, "source_status").select(canonical_name(F.col("source_id")).alias("source"), F.col("last_fetch_status_code").alias("code"), "items_new", "items_updated")
    old = s.select("source", "code", F.lit(0).alias("generation"))
    new = s.where(F.coalesce("items_new", F.lit(0)) + F.coalesce("items_updated", F.lit(0)) > 0).select("source", F.lit(200).alias("code"), F.lit(1).alias("generation"))
    return state.newer_wins(old, new, "source")


oracle("http_cache", f"SELECT {_SOURCE.format('source_id')} AS source, CASE WHEN coalesce(items_new, 0) + coalesce(items_updated, 0) > 0 THEN 200 ELSE last_fetch_status_code END AS code, (coalesce(items_new, 0) + coalesce(items_updated, 0) > 0)::INT AS generation FROM source_status")


CATEGORY_ORDER = ("intl-labs", "cn-ecosystem", "platforms", "paper-sources")


@query
def status_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rule that decides each source's state, written out, whether 'no update' would be illegal for it, and its place in the list: by
    category, then by name."""
    s = table(spark, folder, "source_status")
    fetched, parsed = F.coalesce(F.col("last_fetch_status_code").between(200, 399), F.lit(False)), F.coalesce(F.col("status") != "PARSE_FAILED", F.lit(True))
    new, updated = F.coalesce("items_new", F.lit(0)), F.coalesce("items_updated", F.lit(0))
    said = lambda flag: F.when(flag, "True").otherwise("False")
    head = F.concat(F.lit("fetch_ok="), said(fetched), F.lit("+parse_ok="), said(parsed))
    counts = F.concat(head, F.lit("+new="), new.cast("string"), F.lit("+updated="), updated.cast("string"))
    undated = F.col("newest_item_date").isNull()
    rule = (
        F.when(F.col("method") == "status_only", " => STATUS_ONLY").when(~fetched, F.concat(head, F.lit(" => FETCH_FAILED"))).when(~parsed, F.concat(head, F.lit(" => PARSE_FAILED")))
        .when(new + updated > 0, F.concat(counts, F.lit(" => HAS_UPDATE"))).when(undated, F.concat(counts, F.lit("+dates_missing=true => CANNOT_CONFIRM"))).otherwise(F.concat(counts, F.lit(" => NO_UPDATE")))
    )
    category = canonical_name(F.col("category"))
    order = F.lit(len(CATEGORY_ORDER))
    for k, name in enumerate(CATEGORY_ORDER):
        order = F.when(category == name, k).otherwise(order)
    return s.select(canonical_name(F.col("source_id")).alias("source"), rule.alias("rule"), (~fetched | ~parsed).alias("no_update_illegal"), order.alias("category_order"))


_FETCHED, _PARSED, _NEW, _UPD = "coalesce(last_fetch_status_code BETWEEN 200 AND 399, false)", "coalesce(status <> 'PARSE_FAILED', true)", "coalesce(items_new, 0)", "coalesce(items_updated, 0)"
_HEAD = f"'fetch_ok=' || CASE WHEN {_FETCHED} THEN 'True' ELSE 'False' END || '+parse_ok=' || CASE WHEN {_PARSED} THEN 'True' ELSE 'False' END"
_COUNTS = f"{_HEAD} || '+new=' || {_NEW} || '+updated=' || {_UPD}"
oracle("status_rules", f"""SELECT {_SOURCE.format('source_id')} AS source, CASE WHEN method = 'status_only' THEN ' => STATUS_ONLY' WHEN NOT {_FETCHED} THEN {_HEAD} || ' => FETCH_FAILED' WHEN NOT {_PARSED} THEN {_HEAD} || ' => PARSE_FAILED'
  WHEN {_NEW} + {_UPD} > 0 THEN {_COUNTS} || ' => HAS_UPDATE' WHEN newest_item_date IS NULL THEN {_COUNTS} || '+dates_missing=true => CANNOT_CONFIRM' ELSE {_COUNTS} || ' => NO_UPDATE' END AS rule,
  NOT {_FETCHED} OR NOT {_PARSED} AS no_update_illegal, coalesce(list_position(['intl-labs', 'cn-ecosystem', 'platforms', 'paper-sources'], {_SOURCE.format('category')}) - 1, 4)::INT AS category_order FROM source_status""")


@query
def merge_rationale(spark: SparkSession, folder: str) -> DataFrame:
    """Why items became one story: how many, from how many sources, by an identifier or by title and day."""
    rows = _grouped(spark, folder).groupBy("story_id", "stable").agg(F.count("*").alias("items_merged"), F.count_distinct("source").alias("sources"))
    return rows.select("story_id", "items_merged", "sources", F.when(~F.col("stable"), "title+entity+date").alias("fallback_heuristic"))


oracle("merge_rationale", f"WITH {_GROUPED} SELECT story_id, count(*) AS items_merged, count(DISTINCT source) AS sources, CASE WHEN NOT stable THEN 'title+entity+date' END AS fallback_heuristic FROM g GROUP BY story_id, stable")


@query
def story_order(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's stories in order: dated first, latest first, then the greater identifier; undated ones by identifier."""
    rows = table(spark, folder, "stories").groupBy("digest_date", "story_id").agg(F.max("published_at").alias("at"))
    place = F.rank().over(ranking.Window.partitionBy("digest_date").orderBy(F.col("at").desc_nulls_last(), F.when(F.col("at").isNotNull(), F.col("story_id")).desc_nulls_last(), F.col("story_id").asc_nulls_last()))
    return rows.select("digest_date", "story_id", place.alias("place"))


oracle("story_order", """SELECT digest_date, story_id, rank() OVER (PARTITION BY digest_date ORDER BY dated DESC NULLS LAST, CASE WHEN dated IS NOT NULL THEN story_id END DESC NULLS LAST, story_id NULLS LAST)::INT AS place
FROM (SELECT digest_date, story_id, max(published_at) AS dated FROM stories GROUP BY 1, 2)""")


@query
def archive_index(spark: SparkSession, folder: str) -> DataFrame:
    """The days of the archive, newest first, with their records."""
    days = table(spark, folder, "stories").groupBy("digest_date").agg(F.count("*").alias("records"))
    return days.withColumn("place", F.row_number().over(ranking.Window.orderBy(F.desc("digest_date"))))  # a row per calendar day


oracle("archive_index", "SELECT digest_date, count(*) AS records, row_number() OVER (ORDER BY digest_date DESC)::INT AS place FROM stories GROUP BY 1")


@query
def record_hygiene(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of each item's record once sensitive ones are gone, and whether it exceeds the size that is stored whole."""
    raw = strict_json(F.col("raw_json"))
    keys = F.size(display.clean_record(F.from_json(raw, "map<string,string>")))
    return table(spark, folder, "items").select("row_id", F.when(raw.isNotNull(), keys).alias("keys"), (F.octet_length("raw_json") > 100 * 1024).alias("oversized"))


oracle("record_hygiene", f"""SELECT row_id, CASE WHEN {STRICT} IS NOT NULL THEN len(list_filter(json_keys({STRICT}), lambda k: lower(k) NOT IN ({', '.join(q(k) for k in display.SENSITIVE_KEYS)})))::INT END AS keys,
  octet_length(encode(raw_json)) > 100 * 1024 AS oversized FROM items""")


@query
def platform_parts(spark: SparkSession, folder: str) -> DataFrame:
    """What addresses say about repository, organisation and paper; credentials in them are hidden."""
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, folder, "items").select(
        "row_id", part(r"(?i)code\.example/([^/\s]+/[^/\s?#]+)").alias("repository"), part(r"(?i)//(?:www\.)?hub\.example/([^/\s?#]+)").alias("organisation"), part(r"(?i)review\.example/forum\?id=([^&#\s]+)").alias("forum"),
        F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^https?://(?:www\.)?([^/]+)", 1)).isin("axv.example", "axv5.example"), F.lit(False)).alias("paper_host"),
        display.without_credentials(F.regexp_replace("url", r"^(https?://)", "$1user:pass@")).alias("logged"),
    )


oracle("platform_parts", r"""SELECT row_id, nullif(regexp_extract(url, '(?i)code\.example/([^/\s]+/[^/\s?#]+)', 1), '') AS repository, nullif(regexp_extract(url, '(?i)//(?:www\.)?hub\.example/([^/\s?#]+)', 1), '') AS organisation,
  nullif(regexp_extract(url, '(?i)review\.example/forum\?id=([^&#\s]+)', 1), '') AS forum, coalesce(lower(regexp_extract(url, '(?i)^https?://(?:www\.)?([^/]+)', 1)) IN ('axv.example', 'axv5.example'), false) AS paper_host,
  regexp_replace(url, '^(https?://)', '\1[REDACTED]:[REDACTED]@') AS logged FROM items""")


@query
def note_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The address of each note's document: its own field, relative ones completed, others by the forum; null without the field."""
    pdf = F.nullif(F.coalesce(F.get_json_object("content", "$.pdf.value"), F.get_json_object("content", "$.pdf")), F.lit(""))
    return table(spark, folder, "notes").select("row_id", ids.document_url(pdf, F.col("forum"), "https://review.example").alias("pdf_url"))


oracle("note_documents", """SELECT row_id, CASE WHEN starts_with(p, '/pdf') THEN 'https://review.example' || p WHEN starts_with(p, 'http') THEN p WHEN p IS NOT NULL THEN 'https://review.example/pdf?id=' || forum END AS pdf_url
FROM (SELECT row_id, forum, nullif(coalesce(json_extract_string(content, '$.pdf.value'), json_extract_string(content, '$.pdf')), '') AS p FROM notes)""")
