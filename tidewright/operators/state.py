"""Incremental state of items: what is new, updated or unchanged, and what may be forgotten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, key: str, value: str, order: list[str], bucket: Column, name: str, first: str) -> DataFrame:
    """Adds ``name``: the value of the row before, per key in ``order``, and ``first``: whether there is none.

    A key that holds much of the data is split by ``bucket`` (which must not decrease along the order): windows run
    inside a bucket, and the first row of a bucket gets the last value of the key's bucket before, found on one
    aggregated row per key and bucket.
    """
    rows = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    rows = rows.withColumn("_before", F.lag(F.struct(value)).over(inner))
    last = rows.groupBy(key, "_bucket").agg(F.max(F.struct(*order, value)).alias("_last"))
    carried = F.lag(F.struct(F.col(f"_last.{value}").alias(value))).over(Window.partitionBy(key).orderBy("_bucket"))
    joined = rows.join(last.select(key, "_bucket", carried.alias("_carried")), [key, "_bucket"])
    before = F.coalesce("_before", "_carried")
    return joined.withColumn(name, before[value]).withColumn(first, before.isNull()).drop("_bucket", "_before", "_carried")


def classify(observations: DataFrame, key: str, content: str, order: list[str], bucket: Column) -> DataFrame:
    """Adds event: NEW for a key's first observation, UNCHANGED where the content is as before, else UPDATED."""
    rows = with_previous(observations, key, content, order, bucket, "_previous", "_first")
    event = F.when(F.col("_first"), "NEW").when(F.col(content).eqNullSafe(F.col("_previous")), "UNCHANGED").otherwise("UPDATED")
    return rows.withColumn("event", event).drop("_previous", "_first")


def current(events: DataFrame, key: str, order: list[str], seen: str, kept: list[str]) -> DataFrame:
    """One row per key: the ``kept`` fields of its last change, when it was first and last seen, how often it changed."""
    change = F.col("event") != "UNCHANGED"
    return events.groupBy(key).agg(
        F.max(F.when(change, F.struct(*order, *kept))).alias("_row"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
        F.count_if(F.col("event") == "UPDATED").alias("updates"), F.count("*").alias("observations"),
    ).select(key, *[F.col(f"_row.{c}").alias(c) for c in kept], "first_seen", "last_seen", "updates", "observations")


def merged(state: DataFrame, batch: DataFrame, key: str, content: str, seen: str) -> DataFrame:
    """State after a batch of at most one row per key: old rows keep their first sighting, unchanged ones their fields."""
    s, b = state.alias("s"), batch.alias("b")
    same = F.col(f"s.{content}").eqNullSafe(F.col(f"b.{content}"))
    fields = [c for c in state.columns if c not in (key, "first_seen", "last_seen")]
    pick = [F.when(F.col(f"b.{key}").isNull() | (F.col(f"s.{key}").isNotNull() & same), F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in fields]
    return s.join(b, F.col(f"s.{key}") == F.col(f"b.{key}"), "full_outer").select(
        F.coalesce(f"s.{key}", f"b.{key}").alias(key), *pick, F.coalesce("s.first_seen", f"b.{seen}").alias("first_seen"), F.coalesce(f"b.{seen}", "s.last_seen").alias("last_seen")
    )


def stale(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose key (identifier and versions) the cache doesn't hold."""
    return wanted.join(cache.select(*key).distinct(), key, "left_anti")


def newer_wins(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The union of two tables by key; where both have a row, the new one."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
