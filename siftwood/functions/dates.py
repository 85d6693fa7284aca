"""Relative and absolute dates of listings as Columns. The session's time zone is expected to be UTC."""

from __future__ import annotations

from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..fixed_values import MONTHS, TODAY_WORDS, YESTERDAY_WORDS
from .text import Text, col, contains_any, first_non_empty, norm_key, text

NOT_AVAILABLE = "No disponible"
# Units of relative dates, in the order in which they are tried.
UNITS = (("hours", "hora|horas|hour|hours"), ("days", "dia|dias|day|days"), ("mins", "minuto|minutos|minute|minutes"))


def relative_posted(posted: Text, now: Column) -> Column:
    """Time that words like 'hoy', 'ayer' or 'hace 3 horas' mean, seen from now; NULL if none is said."""
    t = norm_key(posted)
    out = F.lit(None).cast("timestamp")
    for unit, words in reversed(UNITS):
        n = F.try_to_number(F.nullif(F.regexp_extract(t, rf"(?:hace|ago)\s+(\d{{1,9}})\s+(?:{words})", 1), F.lit("")), F.lit("999999999")).cast("int")
        out = F.when(n.isNotNull(), now - F.make_dt_interval(**{unit: n})).otherwise(out)
    return F.when(contains_any(t, TODAY_WORDS), now).when(contains_any(t, YESTERDAY_WORDS), now - F.make_dt_interval(days=F.lit(1))).otherwise(out)


def absolute_posted(posted: Text) -> Column:
    """Day-first or ISO date found in a text, midnight unless a time follows; NULL without one."""
    t = norm_key(posted)
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2}(?:[t ]\d{2}:\d{2}(?::\d{2})?)?)", 1)
    dmy = F.regexp_extract(t, r"(?<!\d)(\d{1,2}[/-]\d{1,2}[/-]\d{4})(?!\d)", 1)
    named = F.regexp_extract(t, rf"(?<!\d)(\d{{1,2}})(?: de)? (?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*(?: de)? (\d{{4}})", 0)
    month = F.array_position(F.array(*(F.lit(m[:3]) for m in MONTHS)), F.regexp_extract(named, r"([a-z]{3})[a-z]* (?:de )?\d{4}$", 1))
    built = F.concat_ws("-", F.regexp_extract(named, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(named, r"^(\d{1,2})", 1), 2, "0"))
    return F.coalesce(
        F.try_to_timestamp(F.nullif(F.replace(iso, F.lit("t"), F.lit(" ")), F.lit(""))),
        F.try_to_timestamp(F.nullif(F.replace(dmy, F.lit("-"), F.lit("/")), F.lit("")), F.lit("d/M/yyyy")),
        F.try_to_timestamp(F.when(named != "", built), F.lit("yyyy-MM-dd")),
    )


def published(posted: Text, now: Column) -> Column:
    return F.coalesce(relative_posted(posted, now), absolute_posted(posted))


def is_fresh(published_at: Text, now: Column, hours: int = DEFAULTS.freshness_hours) -> Column:
    """Published within the horizon, its end included; unknown dates are fresh."""
    return F.coalesce(col(published_at) >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True))


def known_zone(name: str | None) -> str:
    """The zone if it exists, else UTC."""
    wanted = (name or "").strip() or DEFAULTS.timezone
    try:
        ZoneInfo(wanted)
    except Exception:  # noqa: BLE001  whatever is wrong with a name, UTC stands in
        return "UTC"
    return wanted


def local_text(ts: Text, zone: str | None = None) -> Column:
    """Local date and minute, the date alone at midnight, a label without a time."""
    local = F.from_utc_timestamp(col(ts), known_zone(zone))
    midnight = F.date_format(local, "HH:mm:ss") == "00:00:00"
    return F.when(col(ts).isNull(), NOT_AVAILABLE).when(midnight, F.date_format(local, "yyyy-MM-dd")).otherwise(F.date_format(local, "yyyy-MM-dd HH:mm"))


def publication_text(published_at: Text, raw: Text, zone: str | None = None) -> Column:
    return F.when(col(published_at).isNotNull(), local_text(published_at, zone)).otherwise(F.coalesce(F.nullif(first_non_empty(raw), F.lit("")), F.lit(NOT_AVAILABLE)))


def month_year(value: Text) -> Column:
    """struct(year, month) of a text with a Spanish month followed by a year, else NULL."""
    t, dated = norm_key(value), rf"({'|'.join(MONTHS)})\s+(\d{{4}})"
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.regexp_extract(t, dated, 1)).cast("int")
    year = F.regexp_extract(t, dated, 2)
    return F.when((month > 0) & (year != ""), F.struct(F.nullif(year, F.lit("")).cast("int").alias("year"), month.alias("month")))


def iso_utc(ts: Text) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def after(ts: Text, **parts: Column | int) -> Column:
    return col(ts) + F.make_dt_interval(**{k: v if isinstance(v, Column) else F.lit(v) for k, v in parts.items()})


__all__ = ["absolute_posted", "after", "is_fresh", "iso_utc", "known_zone", "local_text", "month_year", "publication_text", "published", "relative_posted", "text"]
