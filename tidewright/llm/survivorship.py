"""One surviving record per duplicate group, chosen field by field.

Each field is the maximum of a composite struct (usable, priority, value, -identifier) over the group, so the
whole choice is one aggregation: partial maxima are combined map-side, a group of any size never meets in one
task, and no sort or window is needed. Titles also need to know how many records agree; the rows are combined
by (group, cleaned title) first, which doubles as the split of hot groups, and then by group.

Rules: a null group key belongs to no group; groups of one record are left out; of equally good values the
smallest identifier wins; a field none of whose values is usable still names a record, the smallest identifier.
Among titles with nothing wrong the longest wins, since an unmarked cut is shorter, then the one that more
records agree on after cleaning. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import titles

#: A web address with a host that has a dot.
WEB_ADDRESS = r"(?i)^https?://[^\s/?#@]+\.[^\s/?#@.]{2,}([/?#:]\S*)?$"


def survivors(stories: DataFrame) -> DataFrame:
    """(story_id, n, title, primary_link, published_at): per field the row_id of the record with the best value."""
    link, when = F.col("primary_link"), F.col("published_at")
    title = F.when(titles.whole(F.col("title")), F.trim("title"))
    web = F.trim(link["url"]).rlike(WEB_ADDRESS)
    in_time = when < (F.date_add(F.col("digest_date"), 1)).cast("timestamp")
    first = F.col("row_id")
    rows = stories.where(F.col("story_id").isNotNull()).select(
        "story_id",
        F.coalesce(F.when(titles.usable(F.col("title")), titles.core(F.col("title"))), F.lit("")).alias("core"),
        F.struct(title.isNotNull().alias("whole"), F.length(title).alias("size"), (-first).alias("first")).alias("t"),
        F.struct(F.coalesce(web, F.lit(False)).alias("web"), F.when(web, -F.coalesce(link["tier"].cast("long"), F.lit(1 << 40))).alias("tier"), (-first).alias("first")).alias("l"),
        F.struct(F.coalesce(in_time, F.lit(False)).alias("in_time"), F.when(in_time, when).alias("when"), (-first).alias("first")).alias("p"),
    )
    by_core = rows.groupBy("story_id", "core").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.max("l").alias("l"), F.max("p").alias("p"))
    support = F.when(F.col("t.whole"), F.col("n")).otherwise(0)
    best = F.struct(F.col("t.whole").alias("whole"), F.col("t.size").alias("size"), support.alias("support"), F.col("t.first").alias("first"))
    return (
        by_core.groupBy("story_id")
        .agg(F.sum("n").alias("n"), F.max(best).alias("t"), F.max("l").alias("l"), F.max("p").alias("p"))
        .where(F.col("n") >= 2)
        .select("story_id", "n", (-F.col("t.first")).alias("title"), (-F.col("l.first")).alias("primary_link"), (-F.col("p.first")).alias("published_at"))
    )


def surviving_fields(stories: DataFrame) -> DataFrame:
    """(story_id, field_name, row_id): :func:`survivors` with a row per field."""
    return survivors(stories).unpivot(["story_id"], ["title", "primary_link", "published_at"], "field_name", "row_id")
