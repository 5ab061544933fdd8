"""Queries of what a run asks its sources for, and of small choices over what it brought."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_name
from tidewright.operators import collecting, ranking
from tidewright.plans.catalogue import oracle, query
from tidewright.plans.ranking import _report_sql, report_index
from tidewright.session import table

_SOURCE = r"nullif(regexp_replace(lower(trim({0})), '[_\s]+', '-', 'g'), '')"
# A made-up catalogue of entities for the test tables.
CATALOGUE = {"lumenry": "organization", "osprion": "organization", "velora": "institution", "kestrelab": "organization", "auric": "researcher"}


@query
def source_readers(spark: SparkSession, folder: str) -> DataFrame:
    """Which reader takes each configured source, and what it is asked for."""
    c = table(spark, folder, "source_config")
    asked = collecting.windowed_query(F.when(F.col("kind") == "paper", F.col("source_name")), F.lit("2026-03-02 06:07:08").cast("timestamp"), F.lit(24))
    reader = collecting.reader_of(F.col("method"), F.col("tier") < 3)
    return c.select(canonical_name(F.col("source_id")).alias("source"), reader.alias("reader"), F.when(reader == "atom", asked).alias("asked"))


_READER = "CASE method " + " ".join(f"WHEN '{m}' THEN '{r}'" for m, r in collecting.READERS.items()) + " END"
oracle("source_readers", f"""SELECT {_SOURCE.format('source_id')} AS source, CASE WHEN coalesce(tier < 3, true) THEN {_READER} END AS reader,
  CASE WHEN coalesce(tier < 3, true) AND method = 'arxiv_api' THEN CASE WHEN kind = 'paper' AND trim(source_name) <> '' THEN '(' || trim(source_name) || ') AND ' ELSE '' END || 'submittedDate:[202603010607 TO 202603020607]' END AS asked FROM source_config""")


@query
def second_looks(spark: SparkSession, folder: str) -> DataFrame:
    """The first three items of each source whose date is uncertain: those whose pages are read as well."""
    rows = table(spark, folder, "items").select("row_id", canonical_name(F.col("source_id")).alias("source"), canonical_name(F.col("date_confidence")).alias("confidence"), "first_seen_at", "url").where(F.col("source").isNotNull())
    order = ranking.best_first(F.lit(0.0), F.col("first_seen_at"), ranking.by_address(F.col("url"), F.col("row_id")))
    return collecting.second_look(rows, "source", F.coalesce(F.col("confidence") == "low", F.lit(True)), order, 3).select("row_id", "source", "place")


oracle("second_looks", f"""SELECT row_id, source, place FROM (SELECT row_id, {_SOURCE.format('source_id')} AS source, row_number() OVER (PARTITION BY {_SOURCE.format('source_id')} ORDER BY first_seen_at DESC NULLS LAST, url NULLS LAST, row_id)::INT AS place
  FROM items WHERE coalesce({_SOURCE.format('date_confidence')} = 'low', true)) WHERE source IS NOT NULL AND place <= 3""")


@query
def card_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The first two entities of each record that the catalogue knows and that aren't people."""
    kinds = F.create_map(*[F.lit(x) for pair in CATALOGUE.items() for x in pair])
    shown = F.filter("entities", lambda e: F.coalesce(F.try_element_at(kinds, e) != "researcher", F.lit(False)))
    return table(spark, folder, "stories").select("row_id", F.array_join(F.slice(shown, 1, 2), ",").alias("shown"))


oracle("card_entities", "SELECT row_id, array_to_string(list_filter(entities, lambda e: e IN (" + ", ".join(f"'{e}'" for e, k in CATALOGUE.items() if k != "researcher") + "))[1:2], ',') AS shown FROM stories")


@query
def first_translations(spark: SparkSession, folder: str) -> DataFrame:
    """Of each story the translation that was written first; its prompt's version with that of the model beside it."""
    t = table(spark, folder, "translations_zh").where(F.col("story_id").isNotNull()).groupBy("story_id").agg(F.min(F.struct("row_id", "prompt_version", "model")).alias("t"))
    return t.select("story_id", F.col("t.row_id").alias("row_id"), collecting.version_of(F.coalesce("t.prompt_version", F.lit("")), F.coalesce("t.model", F.lit(""))).alias("version"))


oracle("first_translations", """SELECT story_id, row_id, 'sha256:' || substr(sha256(coalesce(prompt_version, '') || chr(10) || coalesce(model, '')), 1, 16) AS version FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY row_id) AS k
  FROM translations_zh WHERE story_id IS NOT NULL) WHERE k = 1""")


@query
def older_reports(spark: SparkSession, folder: str) -> DataFrame:
    """The index without the latest report of each kind."""
    return report_index(spark, folder).where("place > 1").select("report_type", "period")


oracle("older_reports", f"""WITH a AS (SELECT 'weekly' AS report_type, period FROM ({_report_sql('week', 30)}) UNION SELECT 'monthly', period FROM ({_report_sql('month', 100)}))
SELECT report_type, period FROM a QUALIFY row_number() OVER (PARTITION BY report_type ORDER BY period DESC) > 1""")
