"""What a run asks its sources for: which reader takes a source, which window it asks for, and which rows deserve a second look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import ranking

# The reader of each method that can be collected.
READERS = {"rss_atom": "rss", "arxiv_api": "atom", "github_releases": "releases", "hf_org": "models", "openreview_venue": "notes", "hf_daily_papers": "daily_papers", "papers_with_code": "code_papers", "html_list": "html_list"}


def reader_of(method: Column, enabled: Column) -> Column:
    """The reader that takes an enabled source; null where it is disabled or its method unknown."""
    out = F.lit(None).cast("string")
    for name, reader in READERS.items():
        out = F.when(method == name, reader).otherwise(out)
    return F.when(F.coalesce(enabled, F.lit(True)), out)


def windowed_query(query: Column, now: Column, lookback_hours: Column) -> Column:
    """A paper interface's query for what was submitted in the hours before ``now``, to the minute; a blank query asks for the window alone."""
    minute = lambda c: F.date_format(F.date_trunc("minute", c), "yyyyMMddHHmm")
    begin = F.timestamp_micros(F.unix_micros(now) - lookback_hours.cast("bigint") * F.lit(3_600_000_000))
    window = F.concat(F.lit("submittedDate:["), minute(begin), F.lit(" TO "), minute(now), F.lit("]"))
    bare = F.trim(F.coalesce(query, F.lit("")))
    return F.when(bare == "", window).otherwise(F.concat(F.lit("("), bare, F.lit(") AND "), window))


def second_look(rows: DataFrame, source: str, needs: Column, order: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each source that need their own page to be read, with their place."""
    return ranking.first_rows(rows.where(needs), [source], order, most)


def version_of(*parts: Column) -> Column:
    """The version of a prompt or configuration: a hash of its parts, a line each."""
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16))
