"""Addresses: one canonical form, identifiers in them, and what kind of page they lead to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track readers.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "twclid", "igshid",
    "_ga", "_gl", "mc_cid", "mc_eid", "ref", "source", "via", "share", "mkt_tok", "trk",
)
# Hosts whose http addresses become https.
SECURE_HOSTS = ("arxiv.org", "github.com", "huggingface.co", "openreview.net", "paperswithcode.com", "aclanthology.org")
# Link targets that lead around a site instead of to an article.
NAVIGATION = r"(?i)^#|^javascript:|^mailto:|/page/\d+|\?page=|/category/|/tag/|/author/|/login|/signup|/contact|/about|/privacy|/terms"
# Where the abstract page, PDF and HTML copies of a paper lie.
PAPER_FORMS = (
    r"^https?://arxiv\.org/pdf/(\d+\.\d+(?:v\d+)?)(?:\.pdf)?$",
    r"^https?://ar5iv\.labs\.arxiv\.org/html/(\d+\.\d+(?:v\d+)?)$",
    r"^https?://arxiv\.org/abs/(\d+\.\d+(?:v\d+)?)$",
    r"^https?://arxiv\.org/abs/([a-z-]+/\d+(?:v\d+)?)$",
)
PAPER_PAGE = "https://arxiv.org/abs/"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def paper_page(url: Column, forms: Sequence[str] = PAPER_FORMS, page: str = PAPER_PAGE) -> Column:
    """The address of a paper's abstract page, for any of its forms; other addresses stay."""
    out = url
    for form in reversed(forms):
        out = F.when(url.rlike(form), F.concat(F.lit(page), F.regexp_extract(url, form, 1))).otherwise(out)
    return out


def _form_encoded(text: Column) -> Column:
    """As a form writes it: blanks as ``+``, all but letters, digits and ``_.-~`` in percents."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def keep_parameters(query: Column, strip: Sequence[str] = TRACKING) -> Column:
    """A query string without tracking parameters (names compared without case), repeated names grouped in order of first
    appearance, as a form would be read and written again: a part without ``=`` has an empty value, empty parts are
    dropped, percents are decoded and written anew. Percents that decode to nothing stay as they are."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    split = lambda p: F.struct(decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decoded(F.substring(p, F.length(F.split_part(p, F.lit("="), F.lit(1))) + F.lit(2), F.length(p))).alias("v"))
    parts = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), split)
    parts = F.filter(parts, lambda p: ~F.lower(p["k"]).isin([s.lower() for s in strip]))
    names = F.array_distinct(F.transform(parts, lambda p: p["k"]))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(parts, lambda p: p["k"] == n)))
    return F.array_join(F.transform(grouped, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")


def canonical(url: Column, strip: Sequence[str] = TRACKING, secure: Sequence[str] = SECURE_HOSTS, forms: Sequence[str] = PAPER_FORMS, page: str = PAPER_PAGE) -> Column:
    """Paper forms rewritten, scheme and host in lower case, http raised to https on ``secure`` hosts, trailing
    slashes, tracking parameters and fragment dropped. Null and empty stay; text that is no address loses its fragment only."""
    at = paper_page(url, forms, page)
    part = lambda k: F.regexp_extract(at, _PARTS, k)
    scheme, host, path = F.lower(part(1)), F.lower(part(2)), part(3)
    safe = F.when((scheme == "http") & host.isin(list(secure)), F.lit("https")).otherwise(scheme)
    bare = F.when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/+$", "")).otherwise(path)
    kept = keep_parameters(part(4), strip)
    joined = F.concat(safe, F.lit("://"), host, bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.isNull() | (url == ""), url).when(at.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), joined).otherwise(F.regexp_replace(at, "#.*$", ""))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?i)https?://([^/?#:@]+)", 1), F.lit("")))


def is_web(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://"), F.lit(False))


def is_navigation(href: Column) -> Column:
    return href.rlike(NAVIGATION)


def parent_domains(name: Column) -> Column:
    """The host itself and its parent domains of two or more labels, the longest first."""
    labels = F.split(name, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1))
    return F.transform(starts, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
