"""Stable identifiers of papers, models and releases, and hashed ones where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.cleanup import compatibility_form

# How identifiers appear in addresses.
ARXIV = r"(?i)(?:arxiv(?:\.org)?[:/])?(?:abs/|pdf/)?((?:\d{4}\.\d{4,5}(?:v\d+)?)|(?:[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?))"
MODEL = r"(?i)huggingface\.co/([a-zA-Z0-9_-]+/[a-zA-Z0-9._-]+)"
RELEASE = r"(?i)github\.com/([a-zA-Z0-9_-]+/[a-zA-Z0-9._-]+)/releases/(?:tag/)?([^/\s?#]+)"
MODELSCOPE = r"(?i)modelscope\.cn/models/([a-zA-Z0-9_-]+/[a-zA-Z0-9._-]+)"
TITLE_SIGNS = "!@#$%^&*()[]{}|\\;:'\",.<>?/`~"
TITLE_LENGTH = 100
# Link type by part of the address, then by kind.
LINK_TYPES = (("arxiv.org", "arxiv"), ("github.com", "github"), ("huggingface.co", "huggingface"), ("modelscope.cn", "modelscope"), ("openreview.net", "openreview"))
KIND_TYPES = (("blog", "blog"), ("news", "blog"), ("paper", "paper"), ("docs", "docs"), ("release", "github"))


def _first(value: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def arxiv_id(value: Column, pattern: str = ARXIV) -> Column:
    """The paper identifier without version, or null."""
    return F.regexp_replace(_first(value, pattern), r"(?i)v\d+$", "")


def model_id(url: Column, pattern: str = MODEL) -> Column:
    return F.lower(_first(url, pattern))


def release_id(url: Column, pattern: str = RELEASE) -> Column:
    """``owner/repo:tag`` in lower case, or null."""
    repo, tag = _first(url, pattern, 1), _first(url, pattern, 2)
    return F.lower(F.concat(repo, F.lit(":"), tag))


def modelscope_id(url: Column) -> Column:
    return F.lower(_first(url, MODELSCOPE))


def stable_id(url: Column, raw_arxiv: Column, arxiv: str = ARXIV, model: str = MODEL, release: str = RELEASE) -> Column:
    """The first of: paper in the address, paper in the record's JSON, release, model; with a prefix for its kind."""
    named = lambda prefix, value: F.concat(F.lit(prefix), value)
    return F.coalesce(
        named("arxiv:", arxiv_id(url, arxiv)), named("arxiv:", arxiv_id(F.nullif(raw_arxiv, F.lit("")))),
        named("github:", release_id(url, release)), named("hf:", model_id(url, model)), named("ms:", modelscope_id(url)),
    )


def normal_title(title: Column) -> Column:
    """Compatibility form (NFKD) in lower case without punctuation, single blanks, at most ``TITLE_LENGTH`` characters."""
    plain = F.translate(F.lower(compatibility_form(title)), TITLE_SIGNS, "")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, TITLE_LENGTH)


def date_bucket(when: Column) -> Column:
    return F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("unknown"))


def fallback_id(title: Column, entity: Column, when: Column) -> Column:
    content = F.concat_ws("|", normal_title(title), F.coalesce(entity, F.lit("unknown")), date_bucket(when))
    return F.concat(F.lit("fallback:"), F.substring(F.sha2(content, 256), 1, 16))


def content_hash(title: Column, url: Column, published: Column, **extra: Column) -> Column:
    """Sixteen hex digits of a hash over title, address, time and further fields in name order; nulls are left out."""
    parts = [F.concat(F.lit("title:"), F.lower(F.trim(title))), F.concat(F.lit("url:"), url), F.concat(F.lit("published_at:"), published)]
    parts += [F.concat(F.lit(f"{name}:"), value) for name, value in sorted(extra.items())]
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def link_type(url: Column, kind: Column, tier: Column, types: tuple = LINK_TYPES) -> Column:
    """By the address, then by the kind, then official for tier 0 and blog for others."""
    out = F.when(tier == 0, "official").otherwise("blog")
    for name, value in reversed(KIND_TYPES):
        out = F.when(F.lower(kind) == name, value).otherwise(out)
    for part, value in reversed(types):
        out = F.when(F.lower(url).contains(part), value).otherwise(out)
    return out


def document_url(field: Column, forum: Column, site: str) -> Column:
    """A review platform's document: a relative path completed, a whole address as it is, any other value by the forum; null stays."""
    return F.when(field.startswith("/pdf"), F.concat(F.lit(site), field)).when(field.startswith("http"), field).when(field.isNotNull() & (field != ""), F.concat(F.lit(site + "/pdf?id="), forum))
