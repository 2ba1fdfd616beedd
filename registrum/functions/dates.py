"""Date functions as Column expressions. Source text never raises: what can't be read stays as it is, or becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions import fixed
from registrum.functions.text import blank_to_null, clean_text, col, let

_DAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)(?:day|sday|nesday|rsday|urday)? (?=\d{1,2} [a-z])"


def council_date(c: Column | str) -> Column:
    """A DATE from any of the register formats (fixed.DATE_FORMATS), else null: one shape test, then one format.

    Two-digit years from 69 on are of the last century.
    """

    def read(t: Column) -> Column:
        slashed = F.replace(t, F.lit("-"), F.lit("/"))
        year = F.regexp_extract(slashed, r"(\d+)$", 1)
        century = F.when(F.length(year) == 4, "").when(year.try_cast("int") >= 69, "19").otherwise("20")
        day_first = F.try_to_date(F.concat(F.regexp_replace(slashed, r"\d+$", ""), century, year), "d/M/yyyy")
        named = F.initcap(F.replace(t, F.lit("-"), F.lit(" ")))
        short = F.length(F.regexp_extract(named, "([A-Za-z]+)", 1)) == 3
        return (
            F.when(t.rlike(r"^\d{1,2}([/-])\d{1,2}\1(\d{2}|\d{4})$"), day_first)
            .when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d"))
            .when(t.rlike(r"^\d{1,2}([ -])[A-Za-z]+\1\d{4}$"), F.when(short, F.try_to_date(named, "d MMM yyyy")).otherwise(F.try_to_date(named, "d MMMM yyyy")))
        )

    return let(F.regexp_replace(clean_text(c), _DAY, ""), read)


def parse_council_date(c: Column | str) -> Column:
    """ISO text of council_date, or the cleaned text where no format fits."""
    return F.coalesce(F.date_format(council_date(c), "yyyy-MM-dd"), clean_text(c))


def iso_date(c: Column | str) -> Column:
    """Strict yyyy-MM-dd of the first ten characters."""
    t = F.left(col(c), F.lit(10))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def date_part(c: Column | str) -> Column:
    return F.split_part(col(c), F.lit("T"), F.lit(1))


def first_date(c: Column | str) -> Column:
    """The first thing in a text that looks like a register date."""
    return blank_to_null(F.regexp_extract(col(c), r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}|\d{1,2} [A-Za-z]{3,9} \d{4})\b", 1))


def labelled_date(c: Column, label: str) -> Column:
    """The ISO date that follows a label in a listing's line."""
    return parse_council_date(blank_to_null(F.regexp_extract(c, rf"(?i)\b{label}\s*:\s*({fixed.SHOWN_DATE})", 1)))


def weekday_date(c: Column) -> Column:
    """The first numeric date of a text, or one with its weekday."""
    return blank_to_null(F.regexp_extract(c, rf"\b{fixed.SHOWN_DATE}\b", 0))


def year_keywords(start: Column, end: Column, prefix: str = "P/") -> Column:
    """Reference prefixes of a window's years, for registers that are searched by them; an open end is the other one."""
    a, b = F.year(F.coalesce(start, end)), F.year(F.coalesce(end, start))
    return F.transform(F.sequence(a, b), lambda y: F.concat(F.lit(prefix), F.lpad((y % 100).cast("string"), 2, "0")))


def form_date(d: Column, page_text: Column) -> Column:
    """A date as a search form wants it: the page's text says if with hyphens."""
    return F.when(page_text.rlike(fixed.HYPHEN_FORMAT), F.date_format(d, "dd-MM-yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))


def effective_date(received: Column | str, validated: Column | str) -> Column:
    return F.coalesce(blank_to_null(received), blank_to_null(validated))


def in_window(d: Column, start: str, end: str) -> Column:
    """Closed window; a date is required."""
    return F.coalesce(d.between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.lit(False))


def in_window_or_unknown(d: Column, start: str | None, end: str | None) -> Column:
    """Open-ended window; unknown dates pass."""
    ok = F.lit(True)
    if start:
        ok = ok & (d >= F.lit(start).cast("date"))
    if end:
        ok = ok & (d <= F.lit(end).cast("date"))
    return F.coalesce(ok, F.lit(True))


def week_starts(start: Column, end: Column) -> Column:
    """Mondays of the weeks that a range touches."""
    return F.sequence(F.date_trunc("week", start).cast("date"), end, F.expr("interval 7 days"))


def days(start: Column, end: Column) -> Column:
    return F.sequence(start, end, F.expr("interval 1 day"))


def previous_week(d: Column) -> Column:
    monday = F.date_sub(F.date_trunc("week", d).cast("date"), 7)
    return F.named_struct(F.lit("start"), monday, F.lit("end"), F.date_add(monday, 6))


def whole_weeks(start: Column, end: Column) -> Column:
    return (F.dayofweek(start) == 2) & (F.dayofweek(end) == 1) & ((F.datediff(end, start) + 1) % 7 == 0)


def ticks_to_london_date(ticks: Column) -> Column:
    """100 ns ticks since year 1, two flag bits masked."""
    ms = F.floor(ticks.bitwiseAND(F.lit(0x3FFFFFFFFFFFFFFF)) / 10_000) - F.lit(62_135_596_800_000)
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms.cast("long")), "Europe/London"))


def run_clock(at: str | None = None) -> Column:
    """The run's UTC time as ISO text; given for runs that must repeat."""
    return F.lit(at) if at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def london_midnight_ms(d: Column) -> Column:
    return F.unix_millis(F.to_utc_timestamp(d.cast("timestamp"), "Europe/London"))


def retry_after_seconds(c: Column | str, now: Column, most: float) -> Column:
    """Seconds or an HTTP date, from 0 to most; unreadable: null."""
    t = F.trim(col(c))
    at = F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    s = F.coalesce(F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")), F.unix_timestamp(at) - F.unix_timestamp(now))
    return F.when(s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(most)), s)))  # least and greatest skip nulls
