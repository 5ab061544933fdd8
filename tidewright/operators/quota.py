"""Which rows a run drops and why: excluded papers, then the cap per source, then the cap per category."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import ranking


def excluded_by(text: Column, keywords: list[str], paper: Column) -> Column:
    """The first keyword that a paper's text holds, without case; null for others."""
    words = [k for k in keywords if k.strip()]
    hit = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(k.strip().lower())), k) for k in words]) if words else F.lit(None).cast("string")
    return F.when(F.coalesce(paper, F.lit(False)), hit)


def drops(rows: DataFrame, keyword: Column, source: str, category: str, order: Column, source_cap: int, category_cap: int, bypass: Column) -> DataFrame:
    """``rows`` with reason: null for those that stay. Rows that pass by right use up places as well; categories count
    what the caps of sources leave; rows without a category have no cap there."""
    marked = rows.withColumn("_kw", keyword).withColumn("_pass", bypass).withColumn("_order", order)
    fair = marked.where(F.col("_kw").isNull())
    by_source = ranking.capped(fair, [source], F.col("_order"), source_cap, F.col("_pass")).withColumnRenamed("kept", "_in_source")
    survivors = ranking.capped(by_source.where("_in_source"), [category], F.col("_order"), category_cap, F.col("_pass"))
    named = lambda name, value: F.concat(F.lit(name + ":"), value)
    out = [
        marked.where(F.col("_kw").isNotNull()).withColumn("reason", named("paper_exclusion_keyword", F.col("_kw"))),
        by_source.where(~F.col("_in_source")).withColumn("reason", named("per_source_max", F.col(source))).drop("_in_source"),
        survivors.withColumn("reason", F.when(~F.col("kept"), named("arxiv_category", F.col(category)))).drop("_in_source", "kept"),
    ]
    return reduce(DataFrame.unionByName, out).drop("_kw", "_pass", "_order")
