"""Queries of scalar functions over whole tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import cleanup, ids, url
from tidewright.functions.text import JSON_FLAW, JSON_OBJECT, strict_json
from tidewright.operators import status
from tidewright.plans.catalogue import oracle, query
from tidewright.session import table

# The invented hosts of the test tables, in the places of the public ones.
PAPER_FORMS = (
    r"^https?://(?:www\.)?axv\.example/pdf/(\d+\.\d+(?:v\d+)?)(?:\.pdf)?$",
    r"^https?://(?:www\.)?axv5\.example/html/(\d+\.\d+(?:v\d+)?)$",
    r"^https?://(?:www\.)?axv\.example/(?:abs|html)/(\d+\.\d+(?:v\d+)?)$",
)
PAPER_PAGE = "https://axv.example/abs/"
SECURE = ("axv.example", "code.example", "hub.example", "review.example", "daily.hub.example", "mirror.papers.example")
ARXIV = r"(?:abs/|pdf/|html/|papers/)(\d{4}\.\d{4,5}(?:v\d+)?)"
MODEL = r"(?i)//(?:www\.)?hub\.example/([a-z0-9_-]+/[a-z0-9._-]+)"
RELEASE = r"(?i)code\.example/([a-z0-9_-]+/[a-z0-9._-]+)/releases/tag/([^/\s?#]+)"
TYPES = (("axv.example", "arxiv"), ("code.example", "github"), ("/hub.example", "huggingface"), ("review.example", "openreview"))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_item_url(column: str = "url") -> F.Column:
    return url.canonical(F.col(column), secure=SECURE, forms=PAPER_FORMS, page=PAPER_PAGE)


def _form_sql(at: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({at}, {q(f)}) THEN {q(PAPER_PAGE)} || regexp_extract({at}, {q(f)}, 1)" for f in PAPER_FORMS)
    return f"CASE {cases} ELSE {at} END"


_STRIP = "[" + ", ".join(q(t) for t in url.TRACKING) + "]"
_URL_PARTS = url._PARTS.replace("'", "''")
CANONICAL_CTE = f"""
WITH form_of AS (SELECT row_id, url AS raw, {_form_sql('url')} AS u FROM items),
parts AS (SELECT row_id, raw, u, lower(regexp_extract(u, '{_URL_PARTS}', 1)) AS sch, lower(regexp_extract(u, '{_URL_PARTS}', 2)) AS h,
  regexp_extract(u, '{_URL_PARTS}', 3) AS p, regexp_extract(u, '{_URL_PARTS}', 4) AS qs FROM form_of),
pairs AS (SELECT *, list_transform(list_filter(string_split(qs, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(x, length(split_part(x, '=', 1)) + 2), '+', ' '))}}) AS kv FROM parts),
kept AS (SELECT *, list_transform(list_filter(kv, lambda e: NOT list_contains({_STRIP}, lower(e.k))), lambda e: replace(url_encode(e.k), '%20', '+') || '=' || replace(url_encode(e.v), '%20', '+')) AS ks FROM pairs),
canon AS (SELECT row_id, CASE WHEN raw IS NULL OR raw = '' THEN raw WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
    CASE WHEN sch = 'http' AND h IN ({', '.join(q(h) for h in SECURE)}) THEN 'https' ELSE sch END || '://' || h ||
    CASE WHEN p <> '/' AND p LIKE '%/' THEN regexp_replace(p, '/+$', '') ELSE p END ||
    CASE WHEN len(ks) > 0 THEN '?' || array_to_string(ks, '&') ELSE '' END
  ELSE regexp_replace(u, '#.*$', '') END AS canonical_url FROM kept)"""


@query
def canonical_url(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items").select("row_id", canonical_item_url().alias("canonical_url"))


oracle("canonical_url", f"{CANONICAL_CTE} SELECT row_id, canonical_url FROM canon")


@query
def url_hosts(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items").select(url.host(F.col("url")).alias("host"), url.is_web(F.col("url")).alias("web"), F.col("url").rlike(url.NAVIGATION).alias("navigation"))
    return items.groupBy("host").agg(F.count("*").alias("n"), F.count_if("web").alias("web"), F.count_if("navigation").alias("navigation"))


oracle("url_hosts", f"""SELECT lower(nullif(regexp_extract(url, '^(?i)https?://([^/?#:@]+)', 1), '')) AS host, count(*) AS n,
  count(*) FILTER (coalesce(regexp_matches(url, '(?i)^https?://'), false)) AS web, count(*) FILTER (regexp_matches(url, {q(url.NAVIGATION)})) AS navigation FROM items GROUP BY 1""")


@query
def profile_match(spark: SparkSession, folder: str) -> DataFrame:
    """Each address with the configured source whose host is the longest suffix of its own."""
    profiles = table(spark, folder, "source_config").select(url.host(F.col("url")).alias("profile")).where(F.col("profile").isNotNull()).distinct()
    hosts = table(spark, folder, "items").select(url.host(F.col("url")).alias("host")).where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"))
    parents = hosts.select("host", "n", F.explode(url.parent_domains(F.col("host"))).alias("profile"))
    return parents.join(profiles, "profile").groupBy("host", "n").agg(F.max_by("profile", F.length("profile")).alias("profile"))


oracle("profile_match", """WITH p AS (SELECT DISTINCT lower(nullif(regexp_extract(url, '^(?i)https?://([^/?#:@]+)', 1), '')) AS profile FROM source_config),
h AS (SELECT lower(nullif(regexp_extract(url, '^(?i)https?://([^/?#:@]+)', 1), '')) AS host, count(*) AS n FROM items GROUP BY 1),
m AS (SELECT host, n, profile, row_number() OVER (PARTITION BY host ORDER BY length(profile) DESC) AS r FROM h JOIN p ON host = profile OR ends_with(host, '.' || profile))
SELECT host, n, profile FROM m WHERE r = 1""")


@query
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.get_json_object(strict_json(F.col("raw_json")), "$.arxiv_id")
    return table(spark, folder, "items").select("row_id", ids.stable_id(F.col("url"), raw, ARXIV, MODEL, RELEASE).alias("stable_id"))


STRICT = f"CASE WHEN regexp_matches(raw_json, {q(JSON_OBJECT)}) AND NOT regexp_matches(raw_json, {q(JSON_FLAW)}) AND json_valid(raw_json) THEN raw_json END"
_STABLE = f"""coalesce('arxiv:' || regexp_replace(nullif(regexp_extract(url, {q(ARXIV)}, 1), ''), '(?i)v\\d+$', ''),
  'arxiv:' || regexp_replace(nullif(regexp_extract(json_extract_string({STRICT}, '$.arxiv_id'), {q(ids.ARXIV)}, 1), ''), '(?i)v\\d+$', ''),
  'github:' || lower(nullif(regexp_extract(url, {q(RELEASE)}, 1), '') || ':' || nullif(regexp_extract(url, {q(RELEASE)}, 2), '')),
  'hf:' || lower(nullif(regexp_extract(url, {q(MODEL)}, 1), '')),
  'ms:' || lower(nullif(regexp_extract(url, {q(ids.MODELSCOPE)}, 1), '')))"""
# JSON that only lenient readers accept is left out on both sides.
oracle("stable_ids", f"SELECT row_id, {_STABLE} AS stable_id FROM items")


@query
def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    title = F.col("title")
    return table(spark, folder, "stories").select("row_id", ids.normal_title(title).alias("normal"), ids.fallback_id(title, F.get("entities", F.lit(0)), F.col("published_at")).alias("fallback_id"))


# Compatibility decompositions of single signs, from Python's Unicode tables; DuckDB has no function for them. Joined as one row.
_CHANGED = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0x80, 0x2FA20) if not 0xD800 <= c < 0xE000}
NFKD = "(SELECT map {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in _CHANGED.items() if a != b) + "} AS m) AS nfkd"
_SIGNS = "[" + "".join("\\" + c for c in ids.TITLE_SIGNS) + "]"
_NORMAL = rf"substr(trim(regexp_replace(regexp_replace(lower(array_to_string(list_transform(string_split(title, ''), lambda c: coalesce(nfkd.m[c], c)), '')), {q(_SIGNS)}, '', 'g'), '\s+', ' ', 'g')), 1, 100)"
oracle("title_keys", rf"""SELECT row_id, {_NORMAL} AS normal, 'fallback:' || substr(sha256(concat_ws('|', {_NORMAL}, coalesce(entities[1], 'unknown'),
  coalesce(strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%d'), 'unknown'))), 1, 16) AS fallback_id FROM stories, {NFKD}""")


@query
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "releases").select("row_id", ids.content_hash(F.col("name"), F.col("html_url"), F.col("published_at").cast("string"), tag=F.col("tag_name"), prerelease=F.col("prerelease").cast("string")).alias("hash"))


oracle("content_hashes", """SELECT row_id, substr(sha256(concat_ws(chr(10), 'title:' || lower(trim(name)), 'url:' || html_url, 'published_at:' || strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'),
  'prerelease:' || prerelease::VARCHAR, 'tag:' || tag_name)), 1, 16) AS hash FROM releases""")


@query
def link_types(spark: SparkSession, folder: str) -> DataFrame:
    kind = ids.link_type(F.col("url"), F.col("kind"), F.col("tier"), TYPES)
    return table(spark, folder, "items").groupBy(kind.alias("link_type")).agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


_TYPE = "CASE " + " ".join(f"WHEN contains(lower(url), {q(p)}) THEN {q(v)}" for p, v in TYPES) + " " + " ".join(f"WHEN lower(kind) = {q(k)} THEN {q(v)}" for k, v in ids.KIND_TYPES) + " WHEN tier = 0 THEN 'official' ELSE 'blog' END"
oracle("link_types", f"SELECT {_TYPE} AS link_type, count(*) AS n, count(DISTINCT source_id) AS sources FROM items GROUP BY 1")


@query
def abstract_precedence(spark: SparkSession, folder: str) -> DataFrame:
    """The first abstract-like field of a note's JSON, unwrapped, with its authors counted."""
    value = lambda path: F.nullif(F.trim(F.get_json_object(F.col("content"), path)), F.lit(""))
    authors = F.size(F.from_json(F.get_json_object("content", "$.authors.value"), "array<string>"))
    return table(spark, folder, "notes").select("row_id", F.coalesce(value("$.abstract.value"), value("$.TLDR.value"), value("$.title.value")).alias("abstract"), F.greatest(authors, F.lit(0)).alias("authors"))


oracle("abstract_precedence", """SELECT row_id, coalesce(nullif(trim(json_extract_string(content, '$.abstract.value')), ''), nullif(trim(json_extract_string(content, '$.TLDR.value')), ''),
  nullif(trim(json_extract_string(content, '$.title.value')), '')) AS abstract, coalesce(json_array_length(content, '$.authors.value'), 0)::INT AS authors FROM notes""")


@query
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets planted behind every text (forms by row), found and replaced."""
    planted = F.element_at(F.array(*[F.lit(s) for s in PLANTED]), (F.col("row_id") % len(PLANTED) + 1).cast("int"))
    text = F.concat(F.coalesce("body", F.lit("")), F.lit("\n"), planted)
    found = table(spark, folder, "releases").select("row_id", F.array_join(cleanup.secrets_found(text), ",").alias("found"), F.md5(cleanup.redacted(text)).alias("digest"))
    return found


PLANTED = ("password = hunter2hunter2", "key AKIA" + "ABCDEFGHIJKLMNOP end", "nothing here", "sk-" + "a1" * 12, "Authorization: Basic abc", "hf_" + "x" * 36)
_text = "coalesce(body, '') || chr(10) || [" + ", ".join(q(s) for s in PLANTED) + f"][(row_id % {len(PLANTED)}) + 1]"
_redact = "t"
for _, _p in cleanup.SECRETS:
    _redact = f"regexp_replace({_redact}, {q(_p)}, '[REDACTED]', 'g')"
_hits = ", ".join(f"CASE WHEN regexp_matches(t, {q(p)}) THEN {q(n)} END" for n, p in cleanup.SECRETS)
oracle("secret_scan", f"WITH x AS (SELECT row_id, {_text} AS t FROM releases) SELECT row_id, coalesce(array_to_string(list_filter([{_hits}], lambda h: h IS NOT NULL), ','), '') AS found, md5({_redact}) AS digest FROM x")


@query
def readme_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "releases").select("row_id", cleanup.readme_summary(F.col("body")).alias("summary"))


oracle("readme_cleanup", r"""WITH a AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?s)^---\n.*?\n---\n', '', 'g'), '<[^>]+>', '', 'g'), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^#+\s*.*$', '', 'g') AS t FROM releases),
b AS (SELECT row_id, t, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)), lambda l: length(l) >= 10)[1:10], ' ') AS j FROM a)
SELECT row_id, CASE WHEN t IS NULL THEN NULL WHEN length(coalesce(j, '')) <= 800 THEN coalesce(j, '') ELSE regexp_replace(substr(j, 1, 800), '\s+\S*$', '') || '...' END AS summary FROM b""")


@query
def fulltext_normal(spark: SparkSession, folder: str) -> DataFrame:
    """Length and digest of every whole text after normalisation, and its sentence-aware shortening."""
    text = cleanup.normal_fulltext(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(text).alias("n"), F.md5(text).alias("digest"))


oracle("fulltext_normal", r"""SELECT doc_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS t FROM documents)""")


@query
def latex_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "items").select("row_id", cleanup.latex_decoded(F.col("title")).alias("title"))


_LATEX = "title"
for _form, _to in (
    (r"\\(?:textbf|textit|textsc|texttt|emph|mathrm|mathbf|mathcal|text)\{([^{}]*)\}", r"\1"), (r"\\['`^\"~=.]\{?([A-Za-z])\}?", r"\1"), (r"\\alpha\b", "α"), (r"\\beta\b", "β"), (r"\\gamma\b", "γ"), (r"\\lambda\b", "λ"),
    (r"\\times\b", "×"), (r"\\infty\b", "∞"), (r"\\to\b", "→"), (r"\\leq\b", "≤"), (r"\\geq\b", "≥"), (r"\$([^$]*)\$", r"\1"), (r"<[^>]+>", ""), (r"\s+", " "),
):
    _LATEX = f"regexp_replace({_LATEX}, {q(_form)}, {q(_to)}, 'g')"
oracle("latex_titles", f"SELECT row_id, trim({_LATEX}) AS title FROM items")


@query
def http_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    code = F.col("last_fetch_status_code")
    rows = table(spark, folder, "source_status").select(status.http_class(code).alias("outcome"), status.retryable(code).alias("retry"), status.reason_of(F.col("reason_text"), code).alias("reason"))
    return rows.groupBy("outcome", "retry", "reason").agg(F.count("*").alias("n"))


oracle("http_outcomes", """SELECT CASE WHEN c IS NULL THEN 'network' WHEN c BETWEEN 200 AND 299 THEN 'ok' WHEN c = 304 THEN 'not_modified' WHEN c = 429 THEN 'rate_limited' WHEN c BETWEEN 400 AND 499 THEN 'client_error'
  WHEN c BETWEEN 500 AND 599 THEN 'server_error' ELSE 'other' END AS outcome, (c IS NULL OR c = 429 OR c BETWEEN 500 AND 599) AS retry,
  CASE WHEN contains(lower(m), 'timeout') THEN 'FETCH_TIMEOUT' WHEN regexp_matches(lower(m), 'ssl|certificate') THEN 'FETCH_SSL_ERROR' WHEN regexp_matches(lower(m), 'too large|size limit') THEN 'FETCH_TOO_LARGE'
  WHEN regexp_matches(lower(m), 'rate limit|429') OR c BETWEEN 400 AND 499 THEN 'FETCH_HTTP_4XX' WHEN c BETWEEN 500 AND 599 THEN 'FETCH_HTTP_5XX' ELSE 'FETCH_NETWORK_ERROR' END AS reason, count(*) AS n
FROM (SELECT last_fetch_status_code AS c, reason_text AS m FROM source_status) GROUP BY ALL""")
