"""Queries of source health, metrics and the reader's views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import cleanup
from tidewright.functions.text import canonical_name
from tidewright.operators import ranking, status
from tidewright.plans.catalogue import oracle, query
from tidewright.session import table

_SOURCE = r"nullif(regexp_replace(lower(trim({0})), '[_\s]+', '-', 'g'), '')"


@query
def source_health(spark: SparkSession, folder: str) -> DataFrame:
    """Every configured source's class from its counters and its items' dates."""
    s = table(spark, folder, "source_status").select(canonical_name(F.col("source_id")).alias("source"), "last_fetch_status_code", "items_new", "items_updated", "status")
    undated = table(spark, folder, "items").groupBy(canonical_name(F.col("source_id")).alias("source")).agg(F.count("*").alias("emitted"), (F.count("published_at") == 0).alias("undated"), F.max("first_seen_at").alias("newest"))
    c = table(spark, folder, "source_config").select(canonical_name(F.col("source_id")).alias("source"), "method")
    rows = c.join(s, "source", "left").join(undated, "source", "left")
    code = status.status_code(
        F.col("method") == "status_only", F.coalesce(F.col("last_fetch_status_code").between(200, 399), F.lit(False)), F.coalesce(F.col("status") != "PARSE_FAILED", F.lit(True)),
        F.coalesce("items_new", F.lit(0)), F.coalesce("items_updated", F.lit(0)), F.coalesce("emitted", F.lit(0)), F.coalesce("undated", F.lit(True)), F.col("method").isin(*status.STABLE_METHODS),
    )
    return rows.select("source", "method", code.alias("code"), F.coalesce("emitted", F.lit(0)).alias("emitted"), "newest")


oracle("source_health", f"""WITH s AS (SELECT {_SOURCE.format('source_id')} AS source, last_fetch_status_code AS c, items_new AS n, items_updated AS u, status FROM source_status),
i AS (SELECT {_SOURCE.format('source_id')} AS source, count(*) AS emitted, count(published_at) = 0 AS undated, max(first_seen_at) AS newest FROM items GROUP BY 1),
c AS (SELECT {_SOURCE.format('source_id')} AS source, method FROM source_config)
SELECT c.source, method, CASE WHEN method = 'status_only' THEN 'STATUS_ONLY' WHEN NOT coalesce(s.c BETWEEN 200 AND 399, false) THEN 'FETCH_FAILED' WHEN NOT coalesce(status <> 'PARSE_FAILED', true) THEN 'PARSE_FAILED'
  WHEN coalesce(n, 0) > 0 OR coalesce(u, 0) > 0 THEN 'HAS_UPDATE' WHEN coalesce(emitted, 0) > 0 AND coalesce(undated, true) AND method NOT IN ('rss_atom','arxiv_api','github_releases','hf_org','openreview_venue') THEN 'CANNOT_CONFIRM'
  ELSE 'NO_UPDATE' END AS code, coalesce(emitted, 0) AS emitted, newest FROM c LEFT JOIN s USING (source) LEFT JOIN i USING (source)""")


@query
def status_summary(spark: SparkSession, folder: str) -> DataFrame:
    code = F.col("status")
    failed = F.count_if(code.isin("FETCH_FAILED", "PARSE_FAILED"))
    return table(spark, folder, "source_status").groupBy(canonical_name(F.col("category")).alias("category")).agg(
        F.count("*").alias("total"), F.count_if(code == "HAS_UPDATE").alias("has_update"), F.count_if(code == "NO_UPDATE").alias("no_update"), failed.alias("failed"),
        F.sum("items_new").alias("items_new"), F.round(1 - failed / F.count("*"), 6).alias("success_rate"),
    )


oracle("status_summary", f"""SELECT {_SOURCE.format('category')} AS category, count(*) AS total, count(*) FILTER (status = 'HAS_UPDATE') AS has_update, count(*) FILTER (status = 'NO_UPDATE') AS no_update,
  count(*) FILTER (status IN ('FETCH_FAILED', 'PARSE_FAILED')) AS failed, sum(items_new)::BIGINT AS items_new, round(1 - count(*) FILTER (status IN ('FETCH_FAILED', 'PARSE_FAILED')) / count(*)::DOUBLE, 6) AS success_rate FROM source_status GROUP BY 1""")


@query
def coverage_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Paper interfaces that are configured but have no successful run."""
    good = table(spark, folder, "source_status").where(~F.col("status").isin("FETCH_FAILED", "PARSE_FAILED")).select(canonical_name(F.col("source_id")).alias("source"))
    wanted = table(spark, folder, "source_config").where("method = 'arxiv_api'").select(canonical_name(F.col("source_id")).alias("source"))
    return wanted.join(good, "source", "left_anti")


oracle("coverage_gate", f"SELECT {_SOURCE.format('source_id')} AS source FROM source_config WHERE method = 'arxiv_api' EXCEPT SELECT {_SOURCE.format('source_id')} FROM source_status WHERE status NOT IN ('FETCH_FAILED', 'PARSE_FAILED')")


@query
def view_search(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold a text in any of their fields, without case."""
    sought = "speech"
    hit = lambda c: F.contains(F.lower(c), F.lit(sought))
    fields = [hit(F.coalesce(c, F.lit(""))) for c in (F.col("title"), F.col("summary"), F.col("arxiv_id"), F.col("hf_model_id"), F.col("primary_link")["url"], F.col("section"))]
    found = fields[0]
    for f in fields[1:]:
        found = found | f
    found = found | F.coalesce(F.exists("entities", lambda e: hit(e)), F.lit(False)) | F.coalesce(F.exists("links", lambda l: hit(F.coalesce(l["title"], F.lit("")))), F.lit(False))
    return table(spark, folder, "stories").where(found).select("row_id", "section")


oracle("view_search", """SELECT row_id, section FROM stories WHERE contains(lower(coalesce(title, '')), 'speech') OR contains(lower(coalesce(summary, '')), 'speech') OR contains(lower(coalesce(arxiv_id, '')), 'speech')
  OR contains(lower(coalesce(hf_model_id, '')), 'speech') OR contains(lower(coalesce(primary_link.url, '')), 'speech') OR contains(lower(coalesce(section, '')), 'speech')
  OR len(list_filter(entities, lambda e: contains(lower(e), 'speech'))) > 0 OR len(list_filter(links, lambda l: contains(lower(coalesce(l.title, '')), 'speech'))) > 0""")


@query
def view_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: records, newest time and the pick of the newest."""
    s = table(spark, folder, "stories").select(canonical_name(F.col("primary_link")["source_id"]).alias("source"), "row_id", "story_id", "published_at")
    newest = F.max(F.struct(F.coalesce("published_at", F.lit(0).cast("timestamp")).alias("w"), (-F.col("row_id")).alias("r"), F.col("story_id").alias("s")))
    return s.groupBy("source").agg(F.count("*").alias("n"), F.max("published_at").alias("newest"), newest["s"].alias("pick"))


oracle("view_by_source", f"""SELECT {_SOURCE.format('primary_link.source_id')} AS source, count(*) AS n, max(published_at) AS newest, arg_max(story_id, (coalesce(published_at, TIMESTAMPTZ '1970-01-01 00:00:00+00'), -row_id)) AS pick FROM stories GROUP BY 1""")


@query
def view_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """Items by category of their source, then by source."""
    c = table(spark, folder, "source_status").groupBy(canonical_name(F.col("source_id")).alias("source")).agg(F.min(canonical_name(F.col("category"))).alias("category"))
    i = table(spark, folder, "items").groupBy(canonical_name(F.col("source_id")).alias("source")).agg(F.count("*").alias("n"))
    return i.join(c, "source", "left").rollup("category", "source").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))


oracle("view_by_category", f"""WITH c AS (SELECT {_SOURCE.format('source_id')} AS source, min({_SOURCE.format('category')}) AS category FROM source_status GROUP BY 1), i AS (SELECT {_SOURCE.format('source_id')} AS source, count(*) AS n FROM items GROUP BY 1)
SELECT category, source, sum(n)::BIGINT AS n, grouping_id(category, source) AS level FROM i LEFT JOIN c USING (source) GROUP BY ROLLUP (category, source)""")


@query
def visible_first(spark: SparkSession, folder: str) -> DataFrame:
    """One record per story and day, the first in the order of sections."""
    order = F.struct(F.array_position(F.array(*[F.lit(s) for s in ("top5", "papers", "radar", "model_releases")]), F.coalesce("section", F.lit(""))).alias("s"), "row_id")
    return table(spark, folder, "stories").where(F.col("section").isNotNull()).groupBy("digest_date", "story_id").agg(F.min(order)["row_id"].alias("row_id"))


oracle("visible_first", "SELECT digest_date, story_id, arg_min(row_id, (list_position(['top5','papers','radar','model_releases'], section), row_id)) AS row_id FROM stories WHERE section IS NOT NULL GROUP BY 1, 2")


@query
def visible_last(spark: SparkSession, folder: str) -> DataFrame:
    """One record per story, the last one, at the place of the first."""
    return table(spark, folder, "stories").groupBy("story_id").agg(F.max("row_id").alias("row_id"), F.min("row_id").alias("place"), F.max_by("title", "row_id").alias("title"))


oracle("visible_last", "SELECT story_id, max(row_id) AS row_id, min(row_id) AS place, arg_max_null(title, row_id) AS title FROM stories GROUP BY 1")


@query
def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Stories with their newest translation and their source's configuration; missing sides stay null."""
    t = table(spark, folder, "translations_zh").groupBy("story_id").agg(F.max(F.struct("row_id", "title_zh", "model")).alias("t"))
    c = table(spark, folder, "source_config").select(canonical_name(F.col("source_id")).alias("source"), "source_name", "kind")
    s = table(spark, folder, "stories").select("row_id", "story_id", canonical_name(F.col("primary_link")["source_id"]).alias("source"))
    return s.join(t, "story_id", "left").join(c, "source", "left").select("row_id", F.col("t.title_zh").alias("title_zh"), F.col("t.model").alias("model"), "source_name", "kind")


oracle("enriched", f"""WITH t AS (SELECT * FROM translations_zh QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY row_id DESC) = 1)
SELECT s.row_id, title_zh, t.model, source_name, c.kind FROM stories s LEFT JOIN t USING (story_id) LEFT JOIN (SELECT {_SOURCE.format('source_id')} AS source, source_name, kind FROM source_config) c ON c.source = {_SOURCE.format('s.primary_link.source_id')}""")


@query
def metrics_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and hour with totals at every level."""
    e = table(spark, folder, "events").select("event_type", F.hour("ts").alias("hour"), "value")
    return e.cube("event_type", "hour").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"))


oracle("metrics_rollup", "SELECT event_type, hour(ts)::INT AS hour, count(*) AS n, round(sum(value), 4) AS total, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY CUBE (1, 2)")


@query
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.indexed_percentiles(table(spark, folder, "events").select("event_type", "value"), ["event_type"], "value", [50, 90, 99])


oracle("latency_percentiles", "SELECT event_type, " + ", ".join(f"list_sort(list(value))[least(({p} * count(value)) // 100, count(value) - 1)::INT + 1] AS p{p}" for p in (50, 90, 99)) + " FROM events WHERE value IS NOT NULL GROUP BY 1")


@query
def state_transitions(spark: SparkSession, folder: str) -> DataFrame:
    """How often one type of event follows another of the same user."""
    from tidewright.operators.state import with_previous

    e = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    rows = with_previous(e, "user_id", "event_type", ["ts", "event_id"], F.to_date("ts"), "before", "first")
    return rows.where(F.col("before").isNotNull()).groupBy("before", "event_type").agg(F.count("*").alias("n"))


oracle("state_transitions", "SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2")


@query
def answer_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in model answers with fences and prose around the JSON, clamped to [0, 1], 0.5 where none can be read."""
    score = F.col("score")
    body = F.concat(F.lit("Here it is:\n```json\n{\"papers\": [{\"id\": \""), F.col("row_id").cast("string"), F.lit("\", \"score\": "), F.when(score.isNull() | F.isnan(score), "\"n/a\"").otherwise((score / 8).cast("string")), F.lit("}]}\n```\nDone."))
    parsed = cleanup.balanced_json(cleanup.unfenced(body))
    value = F.get_json_object(parsed, "$.papers[0].score").try_cast("double")
    return table(spark, folder, "items").select("row_id", F.round(F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.5), 6).alias("value"))


oracle("answer_parse", "SELECT row_id, round(CASE WHEN score IS NULL OR isnan(score) THEN 0.5 ELSE greatest(0, least(1, score / 8)) END, 6) AS value FROM items")


@query
def regional_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """A star join with a pruned scan of each side: revenue by region and market segment."""
    t = lambda n: table(spark, folder, n)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "c_mktsegment").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


oracle("regional_revenue", "SELECT r_name, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")


@query
def output_checksum(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of a whole table that doesn't depend on the order of its rows: digests of rows are summed in 16 parts."""
    row = F.sha2(F.concat_ws("|", "row_id", "story_id", "section"), 256)
    parts = [F.sum(F.conv(F.substring(row, 4 * k + 1, 4), 16, 10).cast("bigint")).alias(f"part{k}") for k in range(4)]
    return table(spark, folder, "stories").agg(F.count("*").alias("n"), *parts)


oracle("output_checksum", "SELECT count(*) AS n, " + ", ".join(f"sum(('0x' || substr(sha256(concat_ws('|', row_id, story_id, section)), {4 * k + 1}, 4))::INT)::BIGINT AS part{k}" for k in range(4)) + " FROM stories")
