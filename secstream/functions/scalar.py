"""Scalar expressions shared by the operators; all of them stay inside generated JVM code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities in rising order with the risk each one adds.
SEVERITY_WEIGHTS = {"info": 1.0, "low": 5.0, "medium": 15.0, "high": 40.0, "critical": 100.0}
SEVERITIES = list(SEVERITY_WEIGHTS)

_ISO_DURATION = re.compile(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")
_WORDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def seconds(duration: str | int) -> int:
    """Seconds of 'PT5M', 'P7D', '30 minutes' or a plain number."""
    if isinstance(duration, int):
        return duration
    iso = _ISO_DURATION.fullmatch(duration)
    if iso and any(iso.groups()):
        days, hours, minutes, secs = (int(part or 0) for part in iso.groups())
        return ((days * 24 + hours) * 60 + minutes) * 60 + secs
    words = re.fullmatch(r"(\d+)\s+(second|minute|hour|day)s?", duration.strip())
    if words:
        return int(words[1]) * _WORDS[words[2]]
    raise ValueError(f"not a duration: {duration!r}")


def micros(duration: str | int) -> int:
    return seconds(duration) * 1_000_000


def at_most(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an ordered table, or all of them for None."""
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError(f"limit must be positive or None, not {limit}")
    return rows.limit(limit)


def as_time(as_of) -> Column:
    """A literal or Column given as 'now' to an operator."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def after(ts: str, as_of, lookback: str | int) -> Column:
    """``as_of - lookback < ts <= as_of``: a job for a past moment must not see what came later."""
    back = F.expr(f"INTERVAL {seconds(lookback)} SECONDS")
    now = as_time(as_of)
    return (F.col(ts) > now - back) & (F.col(ts) <= now)


def recent(ev: DataFrame, as_of, lookback: str | int) -> DataFrame:
    """Events of the look-back. On a day-partitioned table older days are not even listed: a
    filter on ``ts`` alone would still open every partition."""
    rows = ev.filter(after("ts", as_of, lookback))
    if {"year", "month", "day"} <= set(ev.columns):
        back = F.expr(f"INTERVAL {seconds(lookback)} SECONDS")
        day, now = F.make_date("year", "month", "day"), as_time(as_of)
        rows = rows.filter((day >= F.to_date(now - back)) & (day <= F.to_date(now)))
    return rows


def gap_micros(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def lag_seconds(later: str = "ingested_at", earlier: str = "ts") -> Column:
    return gap_micros(F.col(later), F.col(earlier)) / F.lit(1e6)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def floor_time(ts: Column, width: str | int) -> Column:
    """Start of the epoch-aligned tumbling window that holds ``ts``."""
    at = F.unix_micros(ts)
    return F.timestamp_micros(at - F.pmod(at, F.lit(micros(width))))


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for position, name in enumerate(SEVERITIES):
        rank = F.when(F.lower(severity) == name, F.lit(position)).otherwise(rank)
    return rank


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank.cast("int") + 1)


def severity_weight(severity: Column) -> Column:
    weights = F.array(*[F.lit(w) for w in SEVERITY_WEIGHTS.values()])
    return F.element_at(weights, severity_rank(severity).cast("int") + 1)


def at_least(severity: Column, floor: str) -> Column:
    return severity_rank(severity) >= SEVERITIES.index(floor)


def shorten(text: Column, limit: int) -> Column:
    """First ``limit`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("…"))
    )


def network_of(ip: Column) -> Column:
    """Everything before the last dot; an address without dots stands for itself."""
    return F.regexp_replace(ip, r"\.[^.]*$", "")


def network_changed(before: Column, now: Column) -> Column:
    return F.coalesce(network_of(before) != network_of(now), F.lit(False))


def is_private(ip: Column) -> Column:
    return F.coalesce(ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.)"), F.lit(False))


def is_address(ip: Column) -> Column:
    """IPv4 in dotted quads, or IPv6: eight groups, fewer with one ``::``, the last two possibly dotted."""
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    quad = rf"{octet}(\.{octet}){{3}}"
    v4 = ip.rlike(rf"^{quad}$")
    group = "[0-9a-fA-F]{1,4}"
    tail = rf"({group}|{quad})"
    shaped = ip.rlike(rf"^(({group}:)*({tail})?|({group}(:{group})*)?::(({group}:)*{tail})?)$")
    # a dotted tail stands for two groups; a gap for one at least
    groups = F.size(F.filter(F.split(ip, ":"), lambda g: g != "")) + F.contains(ip, F.lit(".")).cast("int")
    whole = F.when(F.contains(ip, F.lit("::")), groups <= 7).otherwise((groups == 8) & ~ip.endswith(":"))
    return v4 | (F.contains(ip, F.lit(":")) & shaped & whole)


def ipv4_number(ip: Column) -> Column:
    """IPv4 address as a number; null for anything else."""
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("long")
    for index in range(4):
        number = number * 256 + F.get(octets, F.lit(index)).try_cast("long")
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), number)


def in_cidr(ip: Column, cidr: str) -> Column:
    """Is an IPv4 address inside ``a.b.c.d/bits``?"""
    base, _, bits = cidr.partition("/")
    shift = 32 - int(bits or 32)
    wanted = 0
    for part in base.split("."):
        wanted = wanted * 256 + int(part)
    return F.shiftright(ipv4_number(ip), shift) == F.lit(wanted >> shift)


def decayed(score: Column, elapsed_us: Column, half_life_s: int) -> Column:
    """Risk left after ``elapsed_us``: whole seconds count, and a residue under 0.5 is zero."""
    whole = F.floor(elapsed_us / F.lit(1_000_000))
    left = score * F.pow(F.lit(0.5), whole / F.lit(float(half_life_s)))
    return F.when(
        (elapsed_us <= 0) | (score <= 0), F.greatest(score, F.lit(0.0))
    ).otherwise(F.when(left < 0.5, F.lit(0.0)).otherwise(left))


def ratio(part: Column, whole: Column) -> Column:
    """Null, not zero, when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(
        (precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)
    )


def volume_ratio(events_today: Column, per_day: Column) -> Column:
    """How many usual days a count stands for; a thin baseline counts as usual."""
    return F.when(F.coalesce(per_day, F.lit(0.0)) <= 0.5, F.lit(1.0)).otherwise(
        F.try_divide(events_today.cast("double"), per_day)
    )


def listed(values: Column, value: Column) -> Column:
    """Is a value known to a baseline list? An empty or missing list knows everything."""
    empty = values.isNull() | (F.size(values) == 0)
    return empty | value.isNull() | F.coalesce(F.array_contains(values, value), F.lit(False))


def overlaps(a_start, a_end, b_start, b_end, tolerance: str | int) -> Column:
    slack = micros(tolerance)
    return (gap_micros(a_start, b_end) <= slack) & (gap_micros(b_start, a_end) <= slack)


def dedupe_key() -> Column:
    return F.concat_ws("|", "rule_id", "entity_type", "entity_id")


def text_map(entries: dict[str, Column]) -> Column:
    """Map of the entries whose value is present. No lambda: around one Spark evaluates every entry outside generated code."""
    absent = F.create_map().cast("map<string,string>")
    return F.map_concat(
        *[
            F.when(value.isNotNull(), F.create_map(F.lit(name), value.cast("string"))).otherwise(absent)
            for name, value in entries.items()
        ]
    )
