"""Queries of incremental state over observations of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.periods import local_day
from tidewright.functions.text import canonical_name
from tidewright.operators import ranking, state
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.scalars import CANONICAL_CTE, canonical_item_url
from tidewright.session import table

#: Items a source gives where nothing is configured.
DEFAULT_MAX = 100
_SOURCE = r"nullif(regexp_replace(lower(trim(source_id)), '[_\s]+', '-', 'g'), '')"
_OBS = f"{CANONICAL_CTE}, obs AS (SELECT canonical_url AS url, content_hash, first_seen_at, items.row_id, {_SOURCE} AS source, title, kind FROM items JOIN canon USING (row_id))"
_EVENTS = f"""{_OBS}, ev AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'NEW' WHEN content_hash IS NOT DISTINCT FROM lag(content_hash) OVER w THEN 'UNCHANGED' ELSE 'UPDATED' END AS event
  FROM obs WINDOW w AS (PARTITION BY url ORDER BY first_seen_at, row_id))"""


def _events(spark: SparkSession, folder: str) -> DataFrame:
    observed = table(spark, folder, "items").select(canonical_item_url().alias("url"), "content_hash", "first_seen_at", "row_id", canonical_name(F.col("source_id")).alias("source"), "title", "kind")
    return state.classify(observed, "url", "content_hash", ["first_seen_at", "row_id"], F.date_trunc("month", F.col("first_seen_at")))


@query
def item_events(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).select("row_id", "event")


oracle("item_events", f"{_EVENTS} SELECT row_id, event FROM ev")


@query
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = _events(spark, folder)
    return e.groupBy("source").agg(*[F.count_if(F.col("event") == k).alias(k.lower()) for k in ("NEW", "UPDATED", "UNCHANGED")], F.count("*").alias("observed"))


oracle("event_counts", f"{_EVENTS} SELECT source, count(*) FILTER (event = 'NEW') AS new, count(*) FILTER (event = 'UPDATED') AS updated, count(*) FILTER (event = 'UNCHANGED') AS unchanged, count(*) AS observed FROM ev GROUP BY 1")


@query
def item_state(spark: SparkSession, folder: str) -> DataFrame:
    return state.current(_events(spark, folder), "url", ["first_seen_at", "row_id"], "first_seen_at", ["content_hash", "title"])


oracle("item_state", f"""{_EVENTS} SELECT url, max_by(content_hash, (first_seen_at, row_id)) FILTER (event <> 'UNCHANGED') AS content_hash, max_by(title, (first_seen_at, row_id)) FILTER (event <> 'UNCHANGED') AS title,
  min(first_seen_at) AS first_seen, max(first_seen_at) AS last_seen, count(*) FILTER (event = 'UPDATED') AS updates, count(*) AS observations FROM ev GROUP BY 1""")


@query
def cache_merge(spark: SparkSession, folder: str) -> DataFrame:
    """State of the older half of the observations merged with the newest of the younger half per address."""
    rows = table(spark, folder, "items").select(canonical_item_url().alias("url"), "content_hash", "title", F.col("first_seen_at").alias("seen"), "row_id")
    last = lambda df: df.groupBy("url").agg(F.max(F.struct("seen", "row_id", "content_hash", "title")).alias("r"), F.min("seen").alias("first_seen"))
    border = F.lit("2024-06-01").cast("timestamp")
    old = last(rows.where(F.col("seen") < border)).select("url", "r.content_hash", "r.title", "first_seen", F.col("r.seen").alias("last_seen"))
    new = last(rows.where(F.col("seen") >= border)).select("url", "r.content_hash", "r.title", "r.seen")
    return state.merged(old, new, "url", "content_hash", "seen")


oracle("cache_merge", f"""{CANONICAL_CTE}, r AS (SELECT canonical_url AS url, content_hash, title, first_seen_at AS seen, items.row_id FROM items JOIN canon USING (row_id)),
o AS (SELECT url, max_by(content_hash, (seen, row_id)) AS content_hash, max_by(title, (seen, row_id)) AS title, min(seen) AS f, max(seen) AS l FROM r WHERE seen < TIMESTAMPTZ '2024-06-01 00:00:00+00' GROUP BY 1),
n AS (SELECT url, max_by(content_hash, (seen, row_id)) AS content_hash, max_by(title, (seen, row_id)) AS title, max(seen) AS s FROM r WHERE seen >= TIMESTAMPTZ '2024-06-01 00:00:00+00' GROUP BY 1)
SELECT coalesce(o.url, n.url) AS url, CASE WHEN n.url IS NULL OR (o.url IS NOT NULL AND o.content_hash IS NOT DISTINCT FROM n.content_hash) THEN o.content_hash ELSE n.content_hash END AS content_hash,
  CASE WHEN n.url IS NULL OR (o.url IS NOT NULL AND o.content_hash IS NOT DISTINCT FROM n.content_hash) THEN o.title ELSE n.title END AS title, coalesce(o.f, n.s) AS first_seen, coalesce(n.s, o.l) AS last_seen
FROM o FULL JOIN n ON o.url = n.url""")


@query
def stale_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Stories without a translation of the current prompt version by the wanted model."""
    wanted = table(spark, folder, "stories").select("story_id").distinct().withColumn("prompt_version", F.lit("sha256:7580e2382a987932")).withColumn("model", F.lit("quill-large"))
    return state.stale(wanted, table(spark, folder, "translations_zh"), ["story_id", "prompt_version", "model"]).select("story_id")


oracle("stale_translations", "SELECT DISTINCT story_id FROM stories s WHERE NOT EXISTS (SELECT 1 FROM translations_zh t WHERE t.story_id = s.story_id AND t.prompt_version = 'sha256:7580e2382a987932' AND t.model = 'quill-large')")


@query
def retention(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per source that stay and go when items are forgotten 180 days after they were first seen."""
    items = table(spark, folder, "items").select(canonical_name(F.col("source_id")).alias("source"), "first_seen_at")
    old = F.col("first_seen_at") < F.lit("2026-10-20").cast("timestamp") - F.expr("INTERVAL 180 DAYS")
    return items.groupBy("source").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("pruned"))


oracle("retention", f"SELECT {_SOURCE} AS source, count(*) FILTER (first_seen_at >= TIMESTAMPTZ '2026-10-20 00:00:00+00' - INTERVAL 180 DAYS) AS kept, count(*) FILTER (first_seen_at < TIMESTAMPTZ '2026-10-20 00:00:00+00' - INTERVAL 180 DAYS) AS pruned FROM items GROUP BY 1")


@query
def lookback_window(spark: SparkSession, folder: str) -> DataFrame:
    """Items first seen in the last 24 hours before a given instant, and those of the local day in Taipei."""
    now = F.lit("2025-03-02 06:00:00").cast("timestamp")
    seen = F.col("first_seen_at")
    rows = table(spark, folder, "items").where(seen.between(now - F.expr("INTERVAL 3 DAYS"), now + F.expr("INTERVAL 3 DAYS")))
    return rows.select("row_id", ((seen >= now - F.expr("INTERVAL 24 HOURS")) & (seen <= now)).alias("recent"), (local_day(seen, "Asia/Taipei") == F.lit("2025-03-02").cast("date")).alias("local_day"))


oracle("lookback_window", """SELECT row_id, (first_seen_at >= TIMESTAMPTZ '2025-03-01 06:00:00+00' AND first_seen_at <= TIMESTAMPTZ '2025-03-02 06:00:00+00') AS recent,
  (first_seen_at AT TIME ZONE 'Asia/Taipei')::DATE = DATE '2025-03-02' AS local_day FROM items WHERE first_seen_at BETWEEN TIMESTAMPTZ '2025-02-27 06:00:00+00' AND TIMESTAMPTZ '2025-03-05 06:00:00+00'""")


@query
def state_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of the tables and their latest times."""
    one = lambda name, column: table(spark, folder, name).agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), F.max(column).alias("latest"))
    return one("items", "last_seen_at").unionByName(one("stories", "published_at")).unionByName(one("releases", "published_at")).unionByName(one("source_status", "newest_item_date"))


oracle("state_stats", """SELECT 'items' AS tbl, count(*) AS n, max(last_seen_at) AS latest FROM items UNION ALL SELECT 'stories', count(*), max(published_at) FROM stories
UNION ALL SELECT 'releases', count(*), max(published_at) FROM releases UNION ALL SELECT 'source_status', count(*), max(newest_item_date) FROM source_status""")


@query
def collector_order(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's newest items up to its configured maximum, newest first, then by address; a maximum of 0 or less
    keeps all, without places."""
    rows = table(spark, folder, "items").select("row_id", canonical_name(F.col("source_id")).alias("source"), F.col("first_seen_at").alias("seen"), "url").where(F.col("source").isNotNull())
    limits = table(spark, folder, "source_config").groupBy(canonical_name(F.col("source_id")).alias("source")).agg(F.max(F.coalesce("max_items", F.lit(DEFAULT_MAX))).alias("most"))
    order = ranking.best_first(F.lit(0.0), F.col("seen"), ranking.by_address(F.col("url"), F.col("row_id")))
    return ranking.limited(rows, limits, "source", "most", order).select("row_id", "source", "place")


oracle("collector_order", f"""WITH r AS (SELECT row_id, {_SOURCE} AS source, row_number() OVER (PARTITION BY {_SOURCE} ORDER BY first_seen_at DESC NULLS LAST, url NULLS LAST, row_id) AS place FROM items)
SELECT row_id, r.source, CASE WHEN most > 0 THEN place::INT END AS place FROM r JOIN (SELECT {_SOURCE} AS source, max(coalesce(max_items, {DEFAULT_MAX})) AS most FROM source_config GROUP BY 1) c ON r.source = c.source WHERE most <= 0 OR place <= most""")
