"""Queries on mixed timestamp forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import timestamps
from tidewright.plans.catalogue import query
from tidewright.session import cut_lineage, table


@query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.normalised(*(table(spark, folder, t) for t in ("items", "notes", "models", "source_config")))


@query
def p2_zones(spark: SparkSession, folder: str) -> DataFrame:
    """What the estimation makes of every source, beside the configured zone."""
    parsed = cut_lineage(timestamps.parse(table(spark, folder, "items"), "published_at", "source_id", "first_seen_at", ["row_id"]))
    local = timestamps.zoneless(parsed, timestamps.slash_order(parsed))
    lacking = local.where(~F.col("zoned") & F.col("region").isNull() & (F.col("form") != "number"))
    zones = timestamps.known_zones(table(spark, folder, "source_config"), "source_id", "timezone")
    profile = timestamps.lag_profile(timestamps.instants_named(local))
    return timestamps.estimate_zones(lacking, timestamps.histories(), profile).join(zones.withColumnRenamed("tz", "configured"), "source", "left")
