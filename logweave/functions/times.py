"""Times of log records: parsing, formatting, durations. Times are microseconds; null is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.text import once

DAY = 86_400_000_000
HOUR = 3_600_000_000
#: Microseconds from 1970-01-01 to the first day of year 1.
FIRST_DAY = -719_162 * DAY
#: Where a format names none: these two by the length of the text, else the general parse by the shape of the date.
AUTO = {23: "yyyy-MM-dd HH:mm:ss.SSS", 19: "yyyy-MM-dd HH:mm:ss"}
GENERAL = {
    r"\d{4}-": "yyyy-M-d",
    r"\d{4}/": "yyyy/M/d",
    r"\d{1,2}/": "M/d/yyyy",
    r"\d{1,2} [A-Za-z]{3} ": "d MMM yyyy",
    r"\d{1,2} [A-Za-z]": "d MMMM yyyy",
    r"[A-Za-z]{3} \d{1,2}, ": "MMM d, yyyy",
    r"[A-Za-z]+ \d{1,2}, ": "MMMM d, yyyy",
}


def java_layout(layout: str) -> str:
    """Fractions are written with f in log formats."""
    return layout.replace("f", "S")


def is_time_only(layout: str | None) -> bool:
    """A layout without year, month and day gives times of day."""
    return bool(layout) and not set("yMd") & set(layout)


def _tried(text: Column, layout: str) -> Column:
    return F.unix_micros(F.try_to_timestamp(text, F.lit(layout)))


def _general(text: Column) -> Column:
    """English dates with or without a time, in 24 or 12 hours, with or without an offset."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9}, +", ""), r"(?<=\d)T(?=\d)", " ")
    half = r"(?i).*\d ?[ap]m$"
    one = F.regexp_replace(F.regexp_replace(plain, "(?i) ?gmt$", "Z"), "(?i)(?<=\\d) ?([ap]m)$", " $1")

    def read(t: Column) -> Column:
        out = None
        for shape, date in GENERAL.items():
            this = F.when(t.rlike(half), _tried(t, f"{date} h:m[:s[.SSSSSSSSS]] a")).otherwise(_tried(t, f"{date}[ H:m[:s[.SSSSSSSSS]][XXX]]"))
            out = F.when(t.rlike(f"^{shape}"), this) if out is None else out.when(t.rlike(f"^{shape}"), this)
        return out

    return once(one, read)


def parse(text: Column, layout: str | None = None) -> Column:
    """Microseconds since 1970-01-01, or of the day for a layout without a date; null where the text doesn't fit. Without a
    layout, English dates are read; a time of day alone has no date and is missing."""
    if layout:
        return _tried(text, java_layout(layout))
    quick = [F.when(F.length(text) == n, _tried(text, x)) for n, x in AUTO.items()]
    return F.coalesce(*quick, _general(text))


def show(micros: Column, time_only: bool = False) -> Column:
    """With the date, or the time alone for the first year of a log of times of day; empty if missing."""
    if not time_only:
        return F.coalesce(F.when(micros >= 0, F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd HH:mm:ss.SSS")), F.lit(""))
    at = F.timestamp_micros(micros + F.lit(FIRST_DAY))  # such logs count from the first day of year 1
    shown = F.when(micros < 365 * DAY, F.date_format(at, "HH:mm:ss.SSS")).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS"))
    return F.coalesce(F.when(micros >= 0, shown), F.lit(""))


def show_duration(micros: Column) -> Column:
    """Milliseconds, seconds rounded to one digit, minutes and seconds, hours and minutes, or days and hours; a second part
    that is zero is left out."""
    minute = 60_000_000
    whole = lambda unit: F.floor(micros / F.lit(unit))
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))

    def both(large, name, small, part):
        rest = F.floor(F.pmod(micros, F.lit(large)) / F.lit(small))
        return F.concat(said(whole(large), name), F.when(rest > 0, F.concat(F.lit(" "), said(rest, part))).otherwise(F.lit("")))

    tenths = F.floor((micros + 50_000) / F.lit(100_000))
    digit = F.pmod(tenths, F.lit(10))
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.when(digit > 0, F.concat(F.lit("."), digit.cast("string"))).otherwise(F.lit("")), F.lit(" sec"))
    return (
        F.when(micros <= 0, "0 ms")
        .when(micros < 1_000_000, said(whole(1000), "ms"))
        .when(micros < minute, seconds)
        .when(micros < HOUR, both(minute, "min", 1_000_000, "sec"))
        .when(micros < DAY, both(HOUR, "h", minute, "min"))
        .otherwise(both(DAY, "d", HOUR, "h"))
    )
