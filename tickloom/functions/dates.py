"""Expiry dates and calendar rules as column expressions (epochs are UTC seconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSION_CLOSE_MINUTE = 15 * 60 + 30  # 15:30, fixed value

def day_of(epoch: Column) -> Column:
    return F.to_date(F.timestamp_seconds(epoch))


def minute_of_day(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(86400)) / 60)


def next_thursday(epoch: Column) -> Column:
    """Same day on a Thursday before 15:30, a week later after it, else the coming Thursday."""
    day = day_of(epoch)
    ahead = F.pmod(F.lit(3) - F.weekday(day), F.lit(7))
    late = (ahead == 0) & (minute_of_day(epoch) >= SESSION_CLOSE_MINUTE)
    return F.date_add(day, F.when(late, 7).otherwise(ahead).cast("int"))


def expiry_text(day: Column) -> Column:
    """``dd-MMM``, e.g. ``16-Jan``."""
    return F.date_format(day, "dd-MMM")


def last_thursday(day: Column) -> Column:
    """Last Thursday of the month ``day`` lies in."""
    return F.next_day(F.date_sub(F.last_day(day), 7), "THU")


def month_number(name: Column) -> Column:
    """1-12 from a month name's first three letters, null when unknown."""
    short = F.initcap(F.substring(name, 1, 3))
    return F.month(F.try_to_date(F.concat(F.lit("1-"), short, F.lit("-2000")), "d-MMM-yyyy"))


def parse_expiry(text: Column, reference: Column, rule: str = "season") -> Column:
    """Date of an expiry text: ``2026-01-16``, ``16-Jan-2026``, ``16-Jan`` or ``Jan2026`` (last Thursday).

    ``16-Jan`` takes its year from ``reference`` (a date):

    * ``season``     a Nov/Dec reference puts Jan/Feb into the next year, the reverse into the last
    * ``half_year``  the next year when the date would lie over 180 days before the reference
    * ``reference``  the reference's year

    The last two fall back to the next year when the date does not exist (29-Feb).
    """
    if rule not in ("season", "half_year", "reference"):
        raise ValueError(f"unknown rule {rule!r}; use season, half_year or reference")
    day_month = r"^(\d{1,2})-([A-Za-z]{3})(?:-(\d{4}))?$"
    month_year = r"^([A-Za-z]{3})(\d{4})$"
    trimmed = F.trim(text)
    parts = F.struct(
        F.regexp_extract(trimmed, day_month, 1).alias("day"),
        month_number(F.regexp_extract(trimmed, day_month, 2)).alias("month"),
        F.regexp_extract(trimmed, day_month, 3).alias("year"),
        month_number(F.regexp_extract(trimmed, month_year, 1)).alias("month_only"),
        F.regexp_extract(trimmed, month_year, 2).alias("year_only"),
        F.when(trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(trimmed, "yyyy-MM-dd")).alias("iso"),
        reference.alias("ref"),
    )
    return _bind(parts, lambda p: _dated(p, rule))


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _dated(p: Column, rule: str) -> Column:
    day = lambda year: F.try_to_date(F.concat_ws("-", year, p["month"], p["day"]), "y-M-d")
    base = F.year(p["ref"])
    if rule == "season":
        at, month = F.month(p["ref"]), p["month"]
        shift = F.when((at >= 11) & (month <= 2), 1).when((at <= 2) & (month >= 11), -1).otherwise(0)
        inferred = day(base + shift)
    elif rule == "half_year":
        years = F.struct(day(base).alias("this"), day(base + 1).alias("next"), p["ref"].alias("ref"))
        late = lambda y: y["this"].isNull() | (F.datediff(y["ref"], y["this"]) > 180)
        inferred = _bind(years, lambda y: F.when(late(y), y["next"]).otherwise(y["this"]))
    else:
        inferred = F.coalesce(day(base), day(base + 1))
    first = F.try_to_date(F.concat_ws("-", p["year_only"], p["month_only"], F.lit("1")), "y-M-d")
    return F.coalesce(
        p["iso"],
        F.when(p["month"].isNotNull(), F.when(p["year"] != "", day(p["year"])).otherwise(inferred)),
        F.when(p["month_only"].isNotNull(), last_thursday(first)),
    )
