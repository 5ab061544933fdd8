"""Times in many written forms to one UTC instant, in microseconds.

A value goes through four steps, all of them JVM expressions:

1. its form is recognised and rewritten to ``year|month|day|hour|minute|second|fraction|half|zone|region``;
2. the parts become microseconds on the local clock, or null where the date or time can't exist;
3. the zone is the value's own; else the zone configured for its source; else the zone estimated for the source;
4. the local clock becomes an instant; local times that a zone has twice or never give null.

Estimation (``estimate_zones``) aligns the zoneless local times of a source with the times at which its rows
were received: under each history of offsets that any zone has, a row violates the order if it would be published after it
was received. Values that name their zone show how often that happens and how long receipt takes; the
history under which the source's values fit that best wins, then the one with fewer violations, then the name. The
configured zone of a source leaves it one history, which then needs no evidence. A like step settles, per source,
whether ``a/b/year`` is day or month first, by its values in which one reading is impossible.

Defined results: null, blank, vague and relative texts give null, as does a bare number that no unit puts
between ``FIRST`` and ``LAST``; fractions are cut to microseconds; a written weekday is not checked; a value
without zone whose source is unknown and can't be estimated gives null; every row keeps its own result, so
repeated rows repeat it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zoneinfo
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import canonical_name, squeeze
from tidewright.session import cut_lineage

DAY_US, QUARTER_US = 86_400_000_000, 900_000_000
#: Lags that are told apart, in quarters of an hour, and the first year of the histories of offsets.
EARLIEST, LATEST, SINCE = -96, 192, 2005
#: What speaks against a history that is not one of the common ones, as log-probability.
RARE = 4.0
# Zones whose names are preferred among those with the same clock.
COMMON = ("UTC", "America/Los_Angeles", "America/Denver", "America/Chicago", "America/New_York", "America/Sao_Paulo", "Europe/London", "Europe/Paris", "Europe/Athens", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney")
#: Plausible years of a bare number: 1990-01-01 to 2050-01-01 in seconds.
FIRST, LAST = 631_152_000, 2_524_608_000

# Month names in English, German, French and Spanish, by their first letters.
MONTHS = {
    "jan": 1, "janvier": 1, "januar": 1, "enero": 1,
    "feb": 2, "février": 2, "fevrier": 2, "februar": 2, "febrero": 2,
    "mar": 3, "mars": 3, "märz": 3, "maerz": 3, "marzo": 3,
    "apr": 4, "avril": 4, "abril": 4,
    "may": 5, "mai": 5, "mayo": 5,
    "jun": 6, "juin": 6, "juni": 6, "junio": 6,
    "jul": 7, "juillet": 7, "juli": 7, "julio": 7,
    "aug": 8, "août": 8, "aout": 8, "agosto": 8,
    "sep": 9, "sept": 9, "septembre": 9, "septiembre": 9,
    "oct": 10, "octobre": 10, "oktober": 10, "okt": 10, "octubre": 10,
    "nov": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "décembre": 12, "decembre": 12, "dezember": 12, "dez": 12, "diciembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
}

# Zone abbreviations with one meaning in feeds, in minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "AWST": 480, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}

_ZONE = r"\s*(Z|z|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?(?:\s*\(?[A-Z]{2,5}\)?)?(?:\[([A-Za-z_]+(?:/[A-Za-z_+-]+)*)\])?$"
_CLOCK = r"(\d{1,2})[:h時时](\d{1,2})(?:[:分](?:(\d{1,2})秒?)?)?(?:[.,](\d{1,9}))?"
_HALF = r"(?:\s*([AaPp])\.?[Mm]\.?)?"
_WEEKDAY = r"^(?:\p{L}{2,10}\.?,?\s+)?"
_ORDINAL = r"(?:st|nd|rd|th|\.|er)?"

#: (name, pattern, order of its groups): groups are numbered in the order year month day hour minute second fraction half zone region.
FORMS = (
    ("iso", rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt\s]\s*{_CLOCK}{_HALF})?{_ZONE}", (1, 2, 3)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(\d{2})(?:\.(\d{1,9}))?())?" + _ZONE, (1, 2, 3)),
    ("day_month", rf"{_WEEKDAY}(\d{{1,2}}){_ORDINAL}[\s-](\p{{L}}{{3,10}})\.?,?[\s-](\d{{4}}|\d{{2}})(?:,?\s+(?:at\s+|à\s+|um\s+)?{_CLOCK}{_HALF}(?:\s*Uhr)?)?{_ZONE}", (3, 2, 1)),
    ("month_day", rf"{_WEEKDAY}(\p{{L}}{{3,10}})\.?\s+(\d{{1,2}}){_ORDINAL},?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_HALF})?{_ZONE}", (3, 1, 2)),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_CLOCK}{_HALF})?{_ZONE}", (3, 2, 1)),
    ("dot", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_CLOCK}{_HALF})?{_ZONE}", (3, 2, 1)),
    ("cjk", rf"^(\d{{4}})[年년]\s?(\d{{1,2}})[月월]\s?(\d{{1,2}})[日일]\s*(?:{_CLOCK}{_HALF})?{_ZONE}", (1, 2, 3)),
)
NUMBER = r"^\d{9,20}(\.\d{1,9})?$"


def _pipes(text: Column) -> tuple[Column, Column]:
    """The form's name and the parts joined by ``|``; null where no form fits."""
    name, parts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for form, pattern, order in reversed(FORMS):
        fits = text.rlike(pattern)
        picked = "|".join(f"${g}" for g in (*order, 4, 5, 6, 7, 8, 9, 10))
        name = F.when(fits, form).otherwise(name)
        parts = F.when(fits, F.regexp_replace(text, pattern, picked)).otherwise(parts)
    return name, parts


def _number_us(text: Column) -> Column:
    """Microseconds of a bare number in the unit (s, ms, us, ns) that gives a plausible date."""
    number = F.when(text.rlike(NUMBER), text).cast("decimal(32,9)")
    result = F.lit(None).cast("bigint")
    for per_second in (1_000_000_000, 1_000_000, 1_000, 1):
        plausible = (number >= F.lit(FIRST * per_second).cast("decimal(20,0)")) & (number < F.lit(LAST * per_second).cast("decimal(20,0)"))
        scaled = number * F.lit(1_000_000 // per_second) if per_second <= 1_000_000 else number / F.lit(per_second // 1_000_000)
        result = F.when(plausible, F.floor(scaled).cast("bigint")).otherwise(result)
    return result


def _whole(part: Column) -> Column:
    return F.when(part == "", None).otherwise(part).cast("int")


def local_us(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, us: Column) -> Column:
    """Microseconds on a zoneless clock since 1970; null where the date or time doesn't exist."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    exists = year.between(1900, 2199) & month.between(1, 12) & day.between(1, last) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    days = F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date")).cast("bigint")
    return F.when(exists, days * F.lit(DAY_US) + ((hour.cast("bigint") * 60 + minute) * 60 + second) * F.lit(1_000_000) + us)


def _offset_minutes(zone: Column) -> Column:
    """Minutes east of UTC of ``+05:30``, ``-0330``, ``+09``, ``UTC+1`` or an abbreviation."""
    known = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    digits = F.regexp_replace(zone, r"^[A-Za-z]*[+-]|:", "")
    sized = F.lpad(F.when(F.length(digits) <= 2, F.concat(digits, F.lit("00"))).otherwise(digits), 4, "0")
    minutes = F.substring(sized, 1, 2).cast("int") * 60 + F.substring(sized, 3, 2).cast("int")
    signed = F.when(zone.contains("-"), -minutes).otherwise(minutes)
    numeric = zone.rlike(r"[+-]\d")
    return F.when(numeric, F.when((minutes <= 14 * 60) & (F.substring(sized, 3, 2).cast("int") < 60), signed)).otherwise(F.try_element_at(known, F.upper(zone)))


def occurs_once(local: Column, utc: Column, zone: Column) -> Column:
    """Whether ``utc`` (as to_utc_timestamp gives it) is the one instant at which the zone's clock shows ``local``."""
    once = F.from_utc_timestamp(F.timestamp_micros(utc), zone) == F.timestamp_micros(local)
    for shift in (-120, -60, -30, 30, 60, 120):
        once = once & (F.from_utc_timestamp(F.timestamp_micros(utc + shift * 60_000_000), zone) != F.timestamp_micros(local))
    return once


def parse(df: DataFrame, value: str, source: str, received: str | None, keep: list[str]) -> DataFrame:
    """Steps 1 and 2. Adds form, us (local, or UTC for numbers), us_swapped (slash dates read month first),
    offset (minutes, from the value), region (from the value), source and received."""
    text = squeeze(F.col(value).cast("string"))
    name, parts = _pipes(F.col("text"))
    rows = df.select(*keep, canonical_name(F.col(source)).alias("source"), (F.col(received) if received else F.lit(None)).cast("timestamp").alias("received"), text.alias("text"))
    rows = rows.select("*", name.alias("form"), F.split(parts, r"\|").alias("p"), _number_us(F.col("text")).alias("number"))
    month_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    p = [F.col("p")[i] for i in range(10)]
    year = F.when(F.length(p[0]) == 2, _whole(p[0]) + F.when(_whole(p[0]) < 70, 2000).otherwise(1900)).otherwise(_whole(p[0]))
    month = F.when(p[1].rlike(r"^\d+$"), _whole(p[1])).otherwise(F.try_element_at(month_of, F.lower(p[1])))
    day, clock = _whole(p[2]), F.coalesce(_whole(p[3]), F.lit(0))
    half = F.lower(p[7])
    hour = F.when(half == "", clock).when(~clock.between(1, 12), None).when(half == "p", clock % 12 + 12).otherwise(clock % 12)
    minute, second = F.coalesce(_whole(p[4]), F.lit(0)), F.coalesce(_whole(p[5]), F.lit(0))
    fraction = F.rpad(F.substring(p[6], 1, 6), 6, "0").cast("bigint")
    rows = rows.select(
        *keep, "source", "received", "form", "number",
        year.alias("y"), month.alias("mo"), day.alias("d"), hour.alias("h"), minute.alias("mi"), second.alias("s"), fraction.alias("f"),
        F.nullif(p[8], F.lit("")).alias("zone"), F.nullif(p[9], F.lit("")).alias("region"),
    )
    c = F.col
    swapped = F.when(c("form") == "slash", local_us(c("y"), c("d"), c("mo"), c("h"), c("mi"), c("s"), c("f")))
    return rows.select(
        *keep, "source", "received", F.when(c("number").isNotNull() & c("form").isNull(), "number").otherwise(c("form")).alias("form"),
        F.when(c("form").isNotNull(), local_us(c("y"), c("mo"), c("d"), c("h"), c("mi"), c("s"), c("f"))).otherwise(c("number")).alias("us"),
        swapped.alias("us_swapped"), (c("zone").isNotNull()).alias("zoned"), _offset_minutes(c("zone")).alias("offset"), "region",
    )


def slash_order(parsed: DataFrame) -> DataFrame:
    """(source, month_first): how a source writes a/b/year, by the values in which one reading is impossible."""
    only_day, only_month = F.col("us_swapped").isNull() & F.col("us").isNotNull(), F.col("us").isNull() & F.col("us_swapped").isNotNull()
    seen = parsed.where((F.col("form") == "slash") & (only_day | only_month)).groupBy("source")
    return seen.agg((F.count_if(only_month) > F.count_if(only_day)).alias("month_first"))


def known_zones(config: DataFrame, source: str, zone: str) -> DataFrame:
    """(source, tz): the configured zone of each source, where it is one that exists."""
    names = zoneinfo.available_timezones() | {"UTC"}
    existing = config.sparkSession.createDataFrame([(n,) for n in sorted(names)], "tz string")
    zones = config.select(canonical_name(F.col(source)).alias("source"), F.trim(zone).alias("tz")).where(F.col("source").isNotNull())
    return zones.join(F.broadcast(existing), "tz", "left_semi").groupBy("source").agg(F.min("tz").alias("tz"))


@lru_cache(maxsize=1)
def histories() -> tuple[str, ...]:
    """One zone for each history of offsets since ``SINCE`` (as clocks stand twice a month), the best known name of each."""
    days = [datetime(year, month, day, 12) for year in range(SINCE, 2041) for month in range(1, 13) for day in (1, 15)]
    found: dict[tuple, str] = {}
    for name in sorted(zoneinfo.available_timezones() | {"UTC"}, key=lambda n: (n not in COMMON, n.startswith("Etc/"), n)):
        zone = zoneinfo.ZoneInfo(name)
        found.setdefault(tuple(zone.utcoffset(d) for d in days), name)
    return tuple(sorted(found.values()))


def _quarters(us: Column) -> Column:
    return F.floor(us / F.lit(QUARTER_US)).cast("int")


def lag_profile(known: DataFrame) -> list[float]:
    """Log-probability of each quarter of an hour between a value's instant and its receipt, from a day before (a violation
    of the order) to two days after, by the values that name their zone (``known``: us, received). Without such values
    violations are improbable and longer lags a little less probable than shorter ones."""
    lag = _quarters(F.unix_micros("received") - F.col("us"))
    seen = {r.q: r.n for r in known.select(lag.alias("q")).where(F.col("q").between(EARLIEST, LATEST - 1)).groupBy("q").agg(F.count("*").alias("n")).collect()}  # as many rows as quarters
    if sum(seen.values()) < 100:
        return [-8.0 if q < 0 else -q / 400 for q in range(EARLIEST, LATEST)]
    counts = [_smoothed(seen, q) + 0.05 for q in range(EARLIEST, LATEST)]
    return [math.log(c / sum(counts)) for c in counts]


def _smoothed(seen: dict[int, int], at: int, reach: int = 8) -> float:
    """The count around a lag, near ones weighing more, on its own side of zero only: the border between order and violation stays sharp."""
    near = [q for q in range(at - reach, at + reach + 1) if (q < 0) == (at < 0)]
    weight = {q: 1 - abs(q - at) / (reach + 1) for q in near}
    return sum(seen.get(q, 0) * w for q, w in weight.items()) / sum(weight.values())


def estimate_zones(resolved: DataFrame, candidates: tuple[str, ...] | list[str], profile: list[float]) -> DataFrame:
    """(source, tz, violations, seen): per source the history of offsets under which its zoneless local times fit the
    times of receipt best, a violation of the order (published after receipt) and every lag counting by how often they
    occur (:func:`lag_profile`). ``resolved`` needs source, local (us) and received. Rows are first counted by source,
    local day and quarter of an hour, so what is compared with each candidate grows with days, not with rows; the offset of a
    day is that at its noon. Rows received more than a day before or two after their local time say nothing and are left out."""
    tried = resolved.where(F.col("local").isNotNull() & F.col("received").isNotNull() & F.col("source").isNotNull()).select("source", "local", F.unix_micros("received").alias("received"))
    tried = tried.where((F.col("received") - F.col("local")).between(-DAY_US, 2 * DAY_US))
    counted = tried.groupBy("source", F.floor(F.col("local") / F.lit(DAY_US)).alias("day"), _quarters(F.col("received") - F.col("local")).alias("q")).agg(F.count("*").alias("n"))
    noon = F.col("day") * F.lit(DAY_US) + F.lit(DAY_US // 2)
    offset = lambda z: _quarters(noon - F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(noon), z)))
    days = counted.select("day").distinct().select("day", F.explode(F.array(*[F.lit(z) for z in candidates])).alias("tz"))
    days = days.select("day", "tz", offset(F.col("tz")).alias("o")).groupBy("day", "o").agg(F.collect_list("tz").alias("zones"))  # at most the candidates
    known = F.array(*[F.lit(p) for p in profile])
    lag = F.col("q") + F.col("o")
    chance = F.when(lag.between(EARLIEST, LATEST - 1), F.get(known, lag - EARLIEST)).otherwise(min(profile))
    by_offset = counted.join(days, "day").groupBy("source", "day", "o").agg(F.sum(chance * F.col("n")).alias("fit"), F.sum(F.when(lag < 0, F.col("n")).otherwise(0)).alias("violations"), F.sum("n").alias("seen"), F.first("zones").alias("zones"))
    per_zone = by_offset.select("source", F.explode("zones").alias("tz"), "fit", "violations", "seen").groupBy("source", "tz").agg(F.round(F.sum("fit"), 6).alias("fit"), F.sum("violations").alias("violations"), F.sum("seen").alias("seen"))
    # few sources keep a clock of their own: without evidence a common one is meant
    per_zone = per_zone.withColumn("fit", F.when(F.col("tz").isin(*COMMON), F.col("fit")).otherwise(F.col("fit") - RARE))
    order = F.struct((-F.col("fit")).alias("f"), "violations", (~F.col("tz").isin(*COMMON)).alias("rare"), "tz", "seen")
    return per_zone.groupBy("source").agg(F.min(order).alias("best")).select("source", "best.tz", "best.violations", "best.seen")


def zoneless(parsed: DataFrame, order: DataFrame) -> DataFrame:
    """Adds local: the local clock of each value, slash dates read in their source's order."""
    day_first, month_first = F.col("us"), F.col("us_swapped")
    local = (
        F.when(F.col("form") != "slash", F.col("us"))
        .when(day_first.isNull() | (day_first == month_first), month_first)
        .when(month_first.isNull(), day_first)
        .when(F.col("month_first"), month_first)
        .when(~F.col("month_first"), day_first)
    )
    return parsed.join(order, "source", "left").withColumn("local", local)


def instants_named(local: DataFrame) -> DataFrame:
    """(us, received) of the values that name their offset or count from 1970 themselves."""
    us = F.when(F.col("form") == "number", F.col("us")).when(F.col("offset").isNotNull(), F.col("local") - F.col("offset").cast("bigint") * 60_000_000)
    return local.select(us.alias("us"), "received").where(F.col("us").isNotNull() & F.col("received").isNotNull())


def to_instants(parsed: DataFrame, zones: DataFrame, keep: list[str], candidates: tuple[str, ...] | None = None) -> DataFrame:
    """Steps 3 and 4: keep + utc_us, one row for each value that denotes exactly one instant."""
    local = zoneless(parsed, slash_order(parsed))
    lacking = local.where(~F.col("zoned") & F.col("region").isNull() & (F.col("form") != "number"))
    lacking = lacking.join(zones, "source", "left_anti")
    # most tables are configured whole: then there is nothing to learn from
    profile = lag_profile(instants_named(local)) if lacking.where(F.col("received").isNotNull()).limit(1).count() else lag_profile(local.where("false").select("us", "received"))
    estimated = estimate_zones(lacking, candidates or histories(), profile).select("source", F.col("tz").alias("guess"))
    existing = parsed.sparkSession.createDataFrame([(n,) for n in sorted(zoneinfo.available_timezones() | {"UTC"})], "region string")
    valued = local.join(F.broadcast(existing.withColumn("exists", F.lit(True))), "region", "left").join(zones, "source", "left").join(estimated, "source", "left")
    own = F.col("zoned") & F.col("region").isNull()
    named = F.when(own | (F.col("form") == "number"), None).when(F.col("region").isNotNull(), F.when(F.col("exists"), F.col("region"))).otherwise(F.coalesce("tz", "guess"))
    exact = F.when(F.col("form") == "number", F.col("us")).when(own, F.col("local") - F.col("offset").cast("bigint") * 60_000_000)
    # an offset beside a region in brackets decides
    exact = F.when(F.col("offset").isNotNull(), F.col("local") - F.col("offset").cast("bigint") * 60_000_000).otherwise(exact)
    placed = valued.select(*keep, exact.alias("exact"), "local", named.alias("named"))
    placed = placed.withColumn("shown", F.when(F.col("exact").isNull() & F.col("named").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("local"), F.col("named")))))
    utc = F.coalesce("exact", F.when(F.col("shown").isNotNull() & occurs_once(F.col("local"), F.col("shown"), F.col("named")), F.col("shown")))
    return placed.select(*keep, utc.alias("utc_us")).where(F.col("utc_us").isNotNull())


def normalised(items: DataFrame, notes: DataFrame, models: DataFrame, config: DataFrame) -> DataFrame:
    """(tbl, row_id, utc_us) over items.published_at, notes.cdate and models.lastModified."""
    value = lambda df, name, column, received: df.select(F.lit(name).alias("tbl"), "row_id", "source_id", F.col(column).cast("string").alias("value"), received.alias("received"))
    never = F.lit(None).cast("timestamp")
    values = (
        value(items, "items", "published_at", F.col("first_seen_at"))
        .unionByName(value(notes, "notes", "cdate", never))
        .unionByName(value(models, "models", "lastModified", never))
    )
    parsed = cut_lineage(parse(values, "value", "source_id", "received", ["tbl", "row_id"]))  # read three times below
    zones = known_zones(config, "source_id", "timezone")
    return to_instants(parsed, zones, ["tbl", "row_id"])
