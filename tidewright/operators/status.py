"""Health of sources: one class and reason per source from its run's counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STABLE_METHODS = ("rss_atom", "arxiv_api", "github_releases", "hf_org", "openreview_venue")


def status_code(status_only: Column, fetched: Column, parsed: Column, new: Column, updated: Column, emitted: Column, undated: Column, ordered: Column) -> Column:
    """The first rule that applies."""
    return (
        F.when(status_only, "STATUS_ONLY").when(~fetched, "FETCH_FAILED").when(~parsed, "PARSE_FAILED").when(new > 0, "HAS_UPDATE").when(updated > 0, "HAS_UPDATE")
        .when((emitted > 0) & undated & ~ordered, "CANNOT_CONFIRM").otherwise("NO_UPDATE")
    )


def http_class(code: Column) -> Column:
    return F.when(code.isNull(), "network").when(code.between(200, 299), "ok").when(code == 304, "not_modified").when(code == 429, "rate_limited").when(code.between(400, 499), "client_error").when(code.between(500, 599), "server_error").otherwise("other")


def retryable(code: Column) -> Column:
    return code.isNull() | (code == 429) | code.between(500, 599)


def reason_of(message: Column, code: Column) -> Column:
    """Reason of a failed fetch by words of its message, then by its HTTP status."""
    said = lambda *words: F.coalesce(F.lower(message).rlike("|".join(words)), F.lit(False))
    return (
        F.when(said("timeout"), "FETCH_TIMEOUT").when(said("ssl", "certificate"), "FETCH_SSL_ERROR").when(said("too large", "size limit"), "FETCH_TOO_LARGE")
        .when(said("rate limit", "429") | code.between(400, 499), "FETCH_HTTP_4XX").when(code.between(500, 599), "FETCH_HTTP_5XX").otherwise("FETCH_NETWORK_ERROR")
    )
