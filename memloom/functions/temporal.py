"""Time predicates and calendar columns of the memory model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersects(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Whether a range meets [from_, to). Without an end, or with one equal to its start, it is a point, which must lie inside; a null start never does."""
    point = end.isNull() | (end == start)
    return F.coalesce(F.when(point, (start >= from_) & (start < to)).otherwise((start < to) & (end > from_)), F.lit(False))


def envelope_intersects(start: Column, end: Column, from_: Column | None, to: Column | None) -> Column:
    """Whether an evidence envelope meets the query range; a missing bound takes the other's value, and the end counts as inside."""
    if from_ is None and to is None:
        return F.lit(True)
    s, e = F.coalesce(start, end), F.coalesce(end, start)
    ok = s.isNotNull()
    if from_ is not None:
        ok = ok & (e >= from_)
    if to is not None:
        ok = ok & (s < to)
    return F.coalesce(ok, F.lit(False))


def drop_reason(basis: str, evidence: tuple[Column, Column], valid: tuple[Column, Column], from_: Column, to: Column) -> Column:
    """Why a row is dropped from a query over [from_, to) on evidence, valid or auto basis; null if it stays. Evidence falls back to valid times."""
    on_valid = intersects(*valid, from_, to)
    if basis == "evidence":
        kept = intersects(*evidence, from_, to) | (valid[0].isNotNull() & on_valid)
        return F.when(evidence[0].isNull(), "temporal_metadata_missing").when(~kept, "outside_evidence_time_range")
    return F.when(valid[0].isNotNull() & ~on_valid, "outside_valid_time_range")


def local_day_start(at: Column, zone: str) -> Column:
    """The instant at which the local day of an instant began in the zone."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(at, zone)), zone)


def last_cutoff(at: Column, zone: str, hour: int = 23) -> Column:
    """The latest daily cutoff (hour o'clock local time) that is not after the instant."""
    local = F.from_utc_timestamp(at, zone)
    shift = F.make_interval(hours=F.lit(hour))
    return F.to_utc_timestamp(F.date_trunc("day", local - shift) + shift, zone)


def relative_days(text: Column, reference: Column) -> Column:
    """The [first, end) days (as dates) that an English time expression names, seen from the reference date; null if it names none.

    today, yesterday, tomorrow, the days beside them, this/last/next week (Monday first), last/this/next weekday, and "N days/weeks/months ago".
    """
    t, d = F.lower(text), F.to_date(reference)
    monday = F.to_date(F.date_trunc("week", d))
    span = lambda a, b: F.struct(a.alias("first"), b.alias("end"))
    day = lambda n: span(F.date_add(d, n), F.date_add(d, n + 1))
    week = lambda n: span(F.date_add(monday, 7 * n), F.date_add(monday, 7 * n + 7))
    number = F.array_position(F.array(*map(F.lit, ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"))), F.regexp_extract(t, r"\b(?:last|this|next) (\w+day)\b", 1)).cast("int")
    diff = F.pmod(F.dayofweek(d) - number, F.lit(7))
    shift = F.when(t.rlike(r"\blast \w+day\b"), F.when(diff == 0, -7).otherwise(-diff)).when(t.rlike(r"\bthis \w+day\b"), -diff).when(t.rlike(r"\bnext \w+day\b"), 7 - diff)
    ago = F.regexp_extract(t, r"\b(\d+) (?:day|week|month)s? ago\b", 1).try_cast("int")
    back = F.when(t.rlike(r"\d days? ago"), F.date_add(d, -ago)).when(t.rlike(r"\d weeks? ago"), F.date_add(d, -7 * ago)).when(t.rlike(r"\d months? ago"), F.add_months(d, -ago))
    return (
        F.when(t.rlike(r"\bday before yesterday\b"), day(-2))
        .when(t.rlike(r"\byesterday\b"), day(-1))
        .when(t.rlike(r"\btoday\b"), day(0))
        .when(t.rlike(r"\bday after tomorrow\b"), day(2))
        .when(t.rlike(r"\btomorrow\b"), day(1))
        .when(t.rlike(r"\blast week\b"), week(-1))
        .when(t.rlike(r"\bthis week\b"), week(0))
        .when(t.rlike(r"\bnext week\b"), week(1))
        .when(number > 0, span(F.date_add(d, shift), F.date_add(d, shift + 1)))
        .when(back.isNotNull(), span(back, F.date_add(back, 1)))
    )
