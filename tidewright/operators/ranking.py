"""Scores, orders, quotas and sections. Every order is total: the address or identifier comes last."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weight of a kind; others weigh 1.
KIND_WEIGHTS = {"blog": 1.5, "paper": 1.2, "model": 1.8, "release": 1.6, "news": 0.8, "docs": 1.0, "forum": 0.6, "social": 0.5}
TIER_WEIGHTS = (3.0, 2.0, 1.0)
TOPIC_WEIGHT, TOPIC_CAP, ENTITY_WEIGHT, DECAY, OLDEST = 1.5, 6.0, 2.0, 0.1, 30
CITATION_WEIGHT, CITATION_CAP, CROSS_WEIGHT, CROSS_CAP = 0.5, 1000, 1.0, 3.0
SEMANTIC_FLOOR, SEMANTIC_TOP, LLM_WEIGHT = 0.5, 3, 10.0


def keyword_pattern(keywords: list[str]) -> str:
    """One pattern for a topic: short words of letters only as whole words, others anywhere, without case."""
    parts = [rf"\b{k}\b" if len(k) <= 4 and k.isalnum() else "".join("\\" + c if c in r".\+*?()[]{}|^$" else c for c in k) for k in keywords]
    return "(?i)" + "|".join(parts)


def tier_score(tier: Column) -> Column:
    return F.when(tier == 0, TIER_WEIGHTS[0]).when(tier == 1, TIER_WEIGHTS[1]).otherwise(TIER_WEIGHTS[2])


def kind_score(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, weight in KIND_WEIGHTS.items():
        out = F.when(F.lower(F.trim(kind)) == name, weight).otherwise(out)
    return out


def topic_score(text: Column, topics: dict[str, tuple[list[str], float]]) -> Column:
    """Boosts of the topics with any keyword in the text, weighted and capped; each topic counts once."""
    found = [F.when(text.rlike(keyword_pattern(words)), boost * TOPIC_WEIGHT).otherwise(0.0) for words, boost in topics.values()]
    return F.least(F.lit(TOPIC_CAP), reduce(lambda a, b: a + b, found, F.lit(0.0)))


def recency_score(when: Column, now: Column) -> Column:
    """exp(-decay * age in days), at most OLDEST days; 0.1 without a date."""
    days = (F.unix_micros(now) - F.unix_micros(when)) / F.lit(86_400_000_000.0)
    return F.when(when.isNotNull(), F.exp(-DECAY * F.least(days, F.lit(float(OLDEST))))).otherwise(0.1)


def citation_score(count: Column) -> Column:
    c = F.coalesce(count.cast("double"), F.lit(0.0))
    return F.when(c <= 0, 0.0).otherwise(F.least(F.log1p(c) / F.log1p(F.lit(float(CITATION_CAP))), F.lit(1.0)) * CITATION_WEIGHT)


def entity_score(entities: Column, configured: list[str]) -> Column:
    return F.coalesce(F.size(F.filter(entities, lambda e: e.isin(configured))), F.lit(0)) * ENTITY_WEIGHT


def cross_source_score(sources: Column, quality: list[str]) -> Column:
    return F.least(F.size(F.array_distinct(F.filter(sources, lambda s: s.isin(quality)))) * CROSS_WEIGHT, F.lit(CROSS_CAP))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_matches(vectors: DataFrame, topics: DataFrame, identifier: str, vector: str, topic: str) -> DataFrame:
    """(identifier, topic, sim, place): of each vector the SEMANTIC_TOP closest topics above the floor.

    ``topics`` (columns ``topic``, ``vector``) is a configured list; it is sent to every task, so that a vector is
    compared with each of them in a projection, without a join of the data."""
    rows = topics.select(F.col(topic).alias("t"), F.col(vector).alias("v")).orderBy("t").collect()  # as long as the configuration
    known = F.array(*[F.struct(F.lit(r.t).alias("topic"), F.array(*[F.lit(float(x)) for x in r.v]).alias("v")) for r in rows])
    scored = F.transform(known, lambda k: F.struct((-F.round(cosine(F.col(vector), k["v"]), 6)).alias("minus"), k["topic"].alias("topic")))
    best = F.slice(F.array_sort(F.filter(scored, lambda s: s["minus"] <= -SEMANTIC_FLOOR)), 1, SEMANTIC_TOP)
    return vectors.select(identifier, F.posexplode(best).alias("p", "s")).select(identifier, F.col("s.topic").alias("topic"), (-F.col("s.minus")).alias("sim"), (F.col("p") + 1).alias("place"))


def best_first(score: Column, when: Column, last: Column) -> Column:
    """A struct whose ascending order is best first: higher score, later time, then ``last``; missing ones after all others."""
    lacking = score.isNull() | F.isnan(score.cast("double"))
    return F.struct(
        lacking.alias("u"), F.when(~lacking, -score.cast("double")).alias("s"), when.isNull().alias("d"), (-F.unix_micros(when)).alias("w"), last.alias("l")
    )


def by_address(url: Column, last: Column) -> Column:
    """The end of an order: by address, missing ones last, then by ``last``."""
    return F.struct(url.isNull().alias("n"), url.alias("u"), last.alias("l"))


def first_rows(rows: DataFrame, group: list[str], order: Column, n: int) -> DataFrame:
    """Adds place, keeps the first ``n`` rows per group. The bare filter on the place lets every task drop what can't
    be among the first before the shuffle, so a large group never meets in one task."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("place") <= n)


def limited(rows: DataFrame, limits: DataFrame, group: str, most: str, order: Column) -> DataFrame:
    """The first rows of each group up to the group's own limit (``limits``: one row per group), with their place; a limit of 0 or
    less keeps all rows of its group, whose places are null. The greatest limit, one number, lets every task drop what can't be
    among the first before the shuffle."""
    greatest = limits.agg(F.max(most)).first()[0] or 0
    known = rows.join(limits, group)
    some = first_rows(known.where(F.col(most) > 0), [group], order, greatest).where(F.col("place") <= F.col(most))
    return some.unionByName(known.where(F.col(most) <= 0).withColumn("place", F.lit(None).cast("int"))).drop(most)


def capped(rows: DataFrame, group: list[str], order: Column, cap: int, bypass: Column | None = None) -> DataFrame:
    """Adds kept: whether a row is among the first ``cap`` of its group, or passes by right (such rows use up places as
    well). Rows without a group are kept. Only the cutoff of each group is found by ranking; all rows are then compared
    with it."""
    known = ~reduce(lambda a, b: a | b, [F.col(g).isNull() for g in group])
    keyed = rows.withColumn("_o", order)
    if cap > 0:
        last = first_rows(keyed.where(known).select(*group, "_o"), group, F.col("_o"), cap).groupBy(*group).agg(F.max("_o").alias("_last"))
        joined = keyed.join(last, group, "left")
        kept = ~known | F.coalesce(F.col("_o") <= F.col("_last"), F.lit(False))
    else:
        joined, kept = keyed.withColumn("_last", F.lit(None)), ~known
    return joined.withColumn("kept", kept | bypass if bypass is not None else kept).drop("_o", "_last")


def sections(rows: DataFrame, identifier: str, day: str, order: Column, release: Column, paper: Column, top: int = 5, papers: int = 70, radar: int = 20) -> DataFrame:
    """(identifier, day, section): the day's first rows are top5, of the rest all releases, then papers up to their limit,
    then the radar up to its limit, papers beyond theirs included; null for a row that is dropped. Needs one row per
    identifier and day."""
    base = rows.select(identifier, day, order.alias("_o"), release.alias("_r"), paper.alias("_p"))
    named = lambda df, name: df.select(identifier, day, F.lit(name).alias("section"))
    key = [identifier, day]
    first = named(first_rows(base, [day], F.col("_o"), top), "top5")
    rest = base.join(first, key, "left_anti")
    shown = named(first_rows(rest.where(~F.col("_r") & F.col("_p")), [day], F.col("_o"), papers), "papers")
    left = rest.where(~F.col("_r")).join(shown, key, "left_anti")
    seen = named(first_rows(left, [day], F.col("_o"), radar), "radar")
    assigned = first.unionByName(named(rest.where("_r"), "model_releases")).unionByName(shown).unionByName(seen)
    return base.select(*key).join(assigned, key, "left")


def indexed_percentiles(rows: DataFrame, group: list[str], value: str, percents: list[int]) -> DataFrame:
    """group + p<percent>: the value at place floor(percent * n / 100) of the sorted values, at most the last.

    The place is found in a histogram of distinct values, so equal values cost one row and no group is held in a list."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n"))
    through = F.sum("_n").over(Window.partitionBy(*group).orderBy(value))
    total = F.sum("_n").over(Window.partitionBy(*group))
    placed = counted.withColumn("_to", through).withColumn("_all", total)
    wanted = lambda p: F.least(F.floor(F.lit(p) * F.col("_all") / 100), F.col("_all") - 1)
    return placed.groupBy(*group).agg(*[F.min(F.when(F.col("_to") > wanted(p), F.col(value))).alias(f"p{p}") for p in percents])
