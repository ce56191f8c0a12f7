"""Scalar functions that the reports share, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Counters that make up a total.
TOTAL_PARTS = ("input", "output", "cache_read", "cache_write")


def half_up(x: Column) -> Column:
    """Rounds halves towards positive infinity, so -0.5 gives 0."""
    return F.floor(x + 0.5).cast("long")


def week_of(day: Column) -> Column:
    """The Monday of a day's week, as a date."""
    return F.date_trunc("week", day).cast("date")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def duration_ms(first: Column, last: Column) -> Column:
    """Never negative."""
    return F.greatest(F.lit(0), F.unix_millis(last) - F.unix_millis(first))


def total_tokens(prefix: str = "") -> Column:
    total = F.lit(0)
    for name in TOTAL_PARTS:
        total = total + F.col(prefix + name)
    return total


def tool_kind(tool: Column) -> Column:
    """mcp for served tools (mcp__server__tool), agent for delegation, skill, else builtin."""
    return F.when(tool.startswith("mcp__"), "mcp").when(tool.isin("Task", "Agent"), "agent").when(tool == "Skill", "skill").otherwise("builtin")


def tool_server(tool: Column) -> Column:
    """What stands between mcp__ and the next __; all that follows mcp__ if nothing stands between."""
    rest = F.substring(tool, F.lit(6), F.length(tool))
    end = F.instr(rest, "__")
    return F.when(tool.startswith("mcp__"), F.when(end > 1, F.substring(rest, F.lit(1), end - 1)).otherwise(rest))


def token_estimate(size: Column) -> Column:
    """Tokens of so many bytes, at four a token."""
    return F.ceil(size / 4).cast("long")


def normal_text(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def is_external(target: Column) -> Column:
    """A scheme or //, but not a drive letter."""
    return target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]+:|//)")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def host_matches(host: Column, domains: list[str]) -> Column:
    """The host itself or a subdomain of one of these."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d) | host.endswith("." + d)
    return hit


def status_ok(status: Column, allowed: list[int] = ()) -> Column:
    return status.between(200, 399) | status.isin(*allowed) if allowed else status.between(200, 399)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; 0 for an empty one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    p = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.coalesce(F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - p(c) * F.log2(p(c))), F.lit(0.0))


def pdf_date(value: Column) -> Column:
    """A page format's date (D:YYYYMMDDHHmmSS+HH'mm', all but the year optional) as a UTC timestamp; null if it is none.

    After the mark come digits, two for each part after the year; what follows them is the zone.
    """
    body = F.when(value.startswith("D:"), F.substring(value, F.lit(3), F.length(value)))
    digits = F.length(body) - F.length(F.ltrim(body, F.lit("0123456789")))
    parts = F.least(F.lit(5), F.floor((digits - 4) / 2)).cast("int")  # of month, day, hour, minute, second
    part = lambda k, default: F.when(parts > k, F.substring(body, F.lit(5 + 2 * k), F.lit(2)).cast("int")).otherwise(default)
    zone = F.substring(body, 5 + 2 * parts, F.length(body))
    two = lambda text, at: F.substring(text, F.lit(at), F.lit(2)).try_cast("int")
    minutes = F.ltrim(F.substring(zone, F.lit(4), F.length(zone)), F.lit("'"))
    sign = F.when(zone.startswith("+"), 1).when(zone.startswith("-"), -1).otherwise(0)
    offset = sign * (F.coalesce(two(zone, 2), F.lit(0)) * 3600 + F.coalesce(two(minutes, 1), F.lit(0)) * 60)
    # months, days and hours beyond their range run over into the next
    first = F.make_date(F.substring(body, F.lit(1), F.lit(4)).try_cast("int"), F.lit(1), F.lit(1))
    day = F.date_add(F.add_months(first, part(0, 1) - 1), part(1, 1) - 1)
    seconds = part(2, 0) * 3600 + part(3, 0) * 60 + part(4, 0)
    return F.when(digits >= 4, F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + seconds - offset))


def percent_encode(text: Column) -> Column:
    """Percent escapes of all but letters, digits and -_.!~*'()."""
    out = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def replace_fragment(target: Column, fragment: Column) -> Column:
    """A target with another fragment, percent-escaped if the old one was; a target without any stays as it is."""
    at = F.instr(target, "#")
    escaped = F.contains(F.substring(target, at + 1, F.length(target)), F.lit("%"))
    return F.when(at > 0, F.concat(F.substring(target, F.lit(1), at), F.when(escaped, percent_encode(fragment)).otherwise(fragment))).otherwise(target)
