"""Items of one thing become a story: grouping by identifier, links, primary link, fields taken from the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link types that may lead a story, and their precedence.
ALLOWED = ("official", "arxiv", "github", "huggingface", "modelscope", "openreview", "paper", "blog", "docs")
PREFERRED = ("official", "arxiv", "github", "huggingface", "paper", "blog")


def distinct_links(rows: DataFrame, story: str, fields: list[str], order: str) -> DataFrame:
    """One row per story and address: the first by ``order``. An aggregation, so a story of any size is combined map-side."""
    first = rows.groupBy(story, "link_type", "url").agg(F.min(F.struct(order, *fields)).alias("_f"))
    return first.select(story, "link_type", "url", F.col(f"_f.{order}").alias(order), *[F.col(f"_f.{c}").alias(c) for c in fields])


def preference(link_type: Column) -> Column:
    out = F.lit(len(PREFERRED))
    for place, name in reversed(list(enumerate(PREFERRED))):
        out = F.when(link_type == name, place).otherwise(out)
    return out


def primary(links: DataFrame, story: str, order: str) -> DataFrame:
    """The leading link of each story: a single one as it is, else the allowed one with the best type, then tier, then order;
    the first where none is allowed."""
    allowed = F.col("link_type").isin(*ALLOWED)
    rank = F.struct((~allowed).alias("out"), F.when(allowed, preference(F.col("link_type"))).otherwise(0).alias("type"), F.when(allowed, F.coalesce("tier", F.lit(9))).otherwise(0).alias("t"), F.col(order).alias("o"), F.col("url").alias("url"), F.col("link_type").alias("link_type"), F.col("tier").alias("tier"))
    best = links.groupBy(story).agg(F.min(rank).alias("_b"), F.count("*").alias("n_links"))
    return best.select(story, "n_links", F.col("_b.url").alias("url"), F.col("_b.link_type").alias("link_type"), F.col("_b.tier").alias("tier"))


def first_known(value: str, order: str) -> Column:
    """The first non-null value by ``order``, as an aggregate."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value]


def distinct_papers(rows: DataFrame, identifier: str, api: Column, dated: Column, confidence: Column, order: str, spread_seconds: int = 86_400) -> DataFrame:
    """One row per paper: the record to keep (from the interface, dated, more certain, earlier), how many sources had it,
    and whether their times lie more than ``spread_seconds`` apart, which lowers the certainty to medium."""
    rank = F.struct(
        (~api).alias("a"), (~dated).alias("b"), F.when(confidence == "high", 0).when(confidence == "medium", 1).otherwise(2).alias("c"), F.col(order).alias("o"), confidence.alias("confidence")
    )
    found = rows.where(F.col(identifier).isNotNull()).groupBy(identifier).agg(
        F.min(rank).alias("_k"), F.count_distinct("source").alias("sources"), F.count("*").alias("records"),
        ((F.max(F.unix_micros("when")) - F.min(F.unix_micros("when"))) > spread_seconds * 1_000_000).alias("apart"),
    )
    certain = F.when(F.coalesce("apart", F.lit(False)), F.lit("medium")).otherwise(F.col("_k.confidence"))
    return found.select(identifier, F.col("_k.o").alias("kept"), "sources", "records", certain.alias("confidence"))


def entity_hits(rows: DataFrame, identifier: str, text: Column, title: Column, entities: dict[str, list[str]]) -> DataFrame:
    """(identifier, entity, hits): keywords found as whole words in the text, plus those that occur in the title. The
    entities are configuration: each becomes a literal expression, nothing is joined."""
    quote = lambda w: "".join("\\" + c if c in r".\+*?()[]{}|^$" else c for c in w)
    one = lambda w: text.rlike(rf"(?i)\b{quote(w)}\b").cast("int") + F.lower(title).contains(w.lower()).cast("int")
    found = F.array(*[F.struct(F.lit(e).alias("entity"), sum((one(w) for w in ws), F.lit(0)).alias("hits")) for e, ws in entities.items()])
    exploded = rows.select(identifier, F.inline(F.filter(found, lambda s: s["hits"] > 0)))
    return exploded.select(identifier, "entity", "hits")
