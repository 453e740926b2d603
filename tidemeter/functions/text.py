"""Small functions on strings, times and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def loop_key(text: Column) -> Column:
    return F.concat(F.lit("auto-"), F.substring(F.sha2(text, 256), 1, 8))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(path, "/+$", ""), "([^/]*)$", 1)


def rfc3339(ms: Column) -> Column:
    """UTC, '' for 0 and less."""
    return F.when(ms <= 0, "").otherwise(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def compact_duration(ms: Column) -> Column:
    """5s, 12m, 3h20m, 2d4h: the two largest units, the smaller one only if it is not zero."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    two = lambda n, a, m, b: F.concat(n, F.lit(a), F.when(m > 0, F.concat(m, F.lit(b))).otherwise(""))
    whole = lambda d: F.floor(s / d).cast("bigint")
    return F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(whole(60), F.lit("m"))).when(s < 86400, two(whole(3600), "h", whole(60) % 60, "m")).otherwise(two(whole(86400), "d", whole(3600) % 24, "h"))


DAY_MS, GRACE_MS, NAMED_DAYS = 86_400_000, 10_800_000, 6


def deadline_phrase(at_ms: Column, now_ms: Column) -> Column:
    """in 19h, on fri, on fri 15:30, in 7d: a countdown within a day, then the weekday (UTC).

    Within GRACE_MS of a midnight the weekday that it opens stands alone. Weekdays over NAMED_DAYS ahead could be mistaken, so those are countdowns too.
    """
    day = lambda ms: F.floor(ms / DAY_MS).cast("bigint")
    midnight = day(at_ms + DAY_MS // 2)
    bare = F.abs(at_ms - midnight * DAY_MS) <= GRACE_MS
    named = F.when(bare, midnight).otherwise(day(at_ms))
    weekday = F.element_at(F.array(*[F.lit(x) for x in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")]), (F.pmod(named + 4, F.lit(7)) + 1).cast("int"))
    clock = F.when(bare, "").otherwise(F.date_format(F.timestamp_millis(at_ms), " HH:mm"))
    by_name = (at_ms - now_ms >= DAY_MS) & (named - day(now_ms)).between(1, NAMED_DAYS)
    return F.when(at_ms.isNull(), None).when(by_name, F.concat(F.lit("on "), weekday, clock)).otherwise(F.concat(F.lit("in "), compact_duration(at_ms - now_ms)))


def instant(spec: Column, now_ms: Column) -> Column:
    """Milliseconds of a lower-case 1h30m (from now), 18:00 or 18:00:30 (today or else tomorrow), 2026-08-20 or 2026-08-20t15:04 (UTC); null if it is none of them."""
    number = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ms|h|m|s)"
    unit = lambda p: F.when(p.endswith("ms"), 1).when(p.endswith("s"), 1000).when(p.endswith("m"), 60_000).otherwise(3_600_000)
    lasts = F.aggregate(F.regexp_extract_all(spec, F.lit(number), F.lit(0)), F.lit(0.0), lambda n, p: n + F.regexp_extract(p, "^[0-9.]+", 0).try_cast("double") * unit(p))
    length = F.when(spec.rlike(rf"^\+?({number})+$"), now_ms + F.floor(lasts).cast("bigint"))
    part = F.split(F.when(spec.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"), spec), ":")
    n = lambda i: F.get(part, F.lit(i)).try_cast("bigint")
    today = now_ms - F.pmod(now_ms, F.lit(DAY_MS)) + n(0) * 3_600_000 + n(1) * 60_000 + F.coalesce(n(2), F.lit(0)) * 1000
    dates = [F.try_to_timestamp(F.upper(spec), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss")]
    return F.coalesce(length, F.when(today > now_ms, today).otherwise(today + DAY_MS), F.unix_millis(F.coalesce(*dates)))


def short_number(n: Column) -> Column:
    """999, 1.5k, 2.0M, 3.1B."""
    unit = lambda d, u: F.concat(F.format_string("%.1f", F.floor(n * 10.0 / d + 0.5) / 10.0), F.lit(u))
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, unit(1e3, "k")).when(n < 1_000_000_000, unit(1e6, "M")).otherwise(unit(1e9, "B"))


def band(pct: Column) -> Column:
    """Colour band of a percentage: 40, 70 and 90 begin the higher ones."""
    return F.when(pct >= 90, "critical").when(pct >= 70, "high").when(pct >= 40, "medium").otherwise("low")


#: Names of months as panels write them.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_clock = r"(?:(0?[0-9]|1[0-2])(?::([0-5][0-9]))?(am|pm)|([01]?[0-9]|2[0-3]):([0-5][0-9]))"


def reset_ms(hint: F.Column, zone: F.Column, now_ms: F.Column) -> F.Column:
    """The instant that a panel's ``Resets`` hint means, in milliseconds; null where it is none.

    A hint is a clock time (``1am``, ``10:50am``, ``15:04``), perhaps behind a month and day, with or
    without white space (``May1,1am``). It is wall time in the named zone, or in UTC where that is missing or
    unknown. What lies before the observation means the next day, or with a date the next year; a day that a month lacks runs on into the next one.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(hint, "([A-Za-z])([0-9])", "$1 $2"), ",", ", "), r"\s+", " "))
    dated = s.rlike(rf"^(?i:{'|'.join(MONTHS)}) ")
    # letters before digits are set apart in dates alone, so that a clock time stays whole
    pattern = rf"^(?:((?i:{'|'.join(MONTHS)})) ([1-9]|[12][0-9]|3[01]), )?{_clock}$"
    part = lambda k: F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))
    whole = s.rlike(pattern)
    zone = F.trim(F.coalesce(zone, F.lit("")))
    # a name that no clock knows would be an error later on
    known = F.when((zone != "") & F.try_to_timestamp(F.concat(F.lit("2000-01-01 00:00:00 "), zone)).isNotNull(), zone).otherwise("UTC")
    now = F.convert_timezone(F.lit("UTC"), known, F.timestamp_millis(now_ms).cast("timestamp_ntz"))
    month, day = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(1))), part(2).cast("int")
    noon = F.when(part(5) == "pm", 12).otherwise(0)
    hour = F.when(part(5).isNotNull(), part(3).cast("int") % 12 + noon).otherwise(part(6).cast("int"))
    minute = F.coalesce(part(4), part(7), F.lit("0")).cast("int")
    fits = ~dated | (day <= F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31))
    first = F.when(dated, F.make_date(F.year(now), month.cast("int"), F.lit(1))).otherwise(F.to_date(now))
    date = F.date_add(first, F.when(dated, day - 1).otherwise(0))
    # a year on is the same month and day of the next year
    later = F.when(dated, F.date_add(F.make_date(F.year(date) + 1, F.month(date), F.lit(1)), F.dayofmonth(date) - 1)).otherwise(F.date_add(date, 1))
    at = lambda d: F.unix_millis(F.convert_timezone(known, F.lit("UTC"), F.to_timestamp_ntz(F.concat(d.cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00")))).cast("timestamp"))
    return F.when(whole & fits, F.when(at(date) < now_ms, at(later)).otherwise(at(date)))


def salvaged(text: Column, schema: str) -> Column:
    """Fields of the JSON object that a text is or holds (from its first brace to its last) as a struct; null where there is none that can be read."""
    whole = F.trim(text)
    inner = F.nullif(F.regexp_extract(whole, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda t: F.get_json_object(t, "$").isNotNull() & t.startswith("{")
    return F.when(valid(whole), F.from_json(whole, schema)).when(valid(inner), F.from_json(inner, schema))


def display_name(account_id: Column, label: Column, email: Column, org: Column) -> Column:
    """What an account is called: its label, else its email with its organisation, else the one of them it has, else its number. Never empty."""
    has = lambda c: F.nullif(c, F.lit(""))
    both = F.concat(has(email), F.lit(" ("), has(org), F.lit(")"))
    return F.coalesce(has(label), both, has(email), has(org), F.concat(F.lit("account "), account_id))
