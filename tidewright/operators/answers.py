"""Answers of language models about stories: their JSON, their identifiers and their weighted scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import cleanup

# Weights of the components of a judgement, and what stands for one that is no number.
COMPONENT_WEIGHTS = {"preference_relevance": 0.40, "novelty": 0.15, "rigor": 0.15, "evidence_strength": 0.15, "generalizability": 0.10, "reproducibility": 0.05}
NEUTRAL = 0.5
ENTRY = "array<struct<id string, components map<string,string>, score string, rationale string>>"


def clamped(value: Column) -> Column:
    """A number between 0 and 1; ``NEUTRAL`` for what is no number."""
    number = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), NEUTRAL).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def weighted(components: Column, score: Column, confidence: Column) -> Column:
    """The weighted sum of the components (a missing one counts 0), or the plain score where there are none; times the confidence."""
    part = lambda k, w: F.when(F.map_contains_key(components, k), clamped(F.element_at(components, k))).otherwise(0.0) * w
    total = reduce(lambda a, b: a + b, [part(k, w) for k, w in COMPONENT_WEIGHTS.items()])
    some = F.coalesce(F.size(components) > 0, F.lit(False))
    return clamped(F.when(some, total).otherwise(clamped(score)) * confidence)


def entries(answers: DataFrame, text: str) -> DataFrame:
    """Adds entry (id, components, score, rationale): one row per entry of an answer's JSON array, or of its ``papers``."""
    bare = cleanup.balanced_json(cleanup.unfenced(F.col(text)))
    found = F.from_json(F.when(bare.startswith("["), bare).otherwise(F.get_json_object(bare, "$.papers")), ENTRY)
    return answers.select("*", F.explode(found).alias("entry"))


def resolved(given: DataFrame, identifier: str, known: DataFrame, story: str) -> DataFrame:
    """Adds ``story``: the known identifier that is meant; exactly, or the only one with the same last part after a colon.
    Rows that mean none are left out. Two equi-joins; the suffixes are counted before they are joined."""
    asked = given.withColumn("_id", F.regexp_replace(F.trim(identifier), r"^[\[\]]+|[\[\]]+$", ""))
    ids = known.select(F.col(story).alias("_known")).where(F.col("_known").isNotNull()).distinct()
    suffixes = ids.groupBy(F.element_at(F.split("_known", ":"), -1).alias("_suffix")).agg(F.count("*").alias("_n"), F.min("_known").alias("_only")).where("_n = 1").select("_suffix", "_only")
    both = asked.join(ids, asked["_id"] == ids["_known"], "left").join(suffixes, asked["_id"] == suffixes["_suffix"], "left")
    return both.withColumn(story, F.coalesce("_known", "_only")).where(F.col(story).isNotNull()).drop("_id", "_known", "_suffix", "_only")


def passes(weighted_score: Column, weight: float, threshold: float) -> Column:
    """Whether a story's raw score lets it pass quotas; nothing passes at a threshold of 1 or without weight."""
    if threshold >= 1.0 or weight <= 0.0:
        return F.lit(False)
    return F.coalesce(weighted_score / F.lit(weight) >= threshold, F.lit(False))
