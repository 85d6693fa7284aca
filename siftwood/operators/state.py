"""Schedule and failure state of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .merge import updated


def is_paused(now: Column, paused_until: str = "paused_until") -> Column:
    return F.coalesce(F.col(paused_until) > now, F.lit(False))


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Enabled, not paused, and never checked or checked an interval ago or longer."""
    again = F.col("last_checked_at") + F.make_dt_interval(mins=F.col("interval_minutes"))
    return sources.where(F.col("enabled") & ~is_paused(now) & F.coalesce(again <= now, F.lit(True)))


def selected(sources: DataFrame, now: Column, force_all: bool = False) -> DataFrame:
    """Sources of a cycle with skipped: those due (or all enabled), and the paused ones, marked."""
    run = sources.where("enabled").where(~is_paused(now)) if force_all else due(sources, now)
    held = sources.where(F.col("enabled") & is_paused(now)).join(run.select("id"), "id", "left_anti")
    return run.withColumn("skipped", F.lit(False)).unionByName(held.select(*sources.columns).withColumn("skipped", F.lit(True)))


def failure_islands(events: DataFrame, source: str, order: list[str], ok: Column, failed: Column, at: str, after: int = DEFAULTS.failures_before_pause, hours: int = DEFAULTS.pause_hours) -> DataFrame:
    """events with failure_count (consecutive failures since the last success) and paused_until (set from a number of failures on).

    A success starts a new island; what is neither leaves the counter. Exact for recorded events; what a pause would have kept
    from happening is the streaming machine's business.
    """
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("__island", F.sum(ok.cast("int")).over(w))
    inside = Window.partitionBy(source, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("failure_count", F.sum(failed.cast("int")).over(inside).cast("int"))
    pause = F.when(failed & (F.col("failure_count") >= after), F.col(at) + F.make_dt_interval(hours=F.lit(hours)))
    rows = rows.withColumn("paused_until", F.max(pause).over(inside))
    return rows.drop("__island")


def checked(sources: DataFrame, where: Column, at: Column, error: Column | None = None) -> DataFrame:
    """After a check: a success resets failures, pause and error; an error that is no block only leaves its text."""
    if error is not None:
        return updated(sources, where, last_checked_at=at, last_error=error)
    null = F.lit(None)
    return updated(sources, where, last_checked_at=at, last_error=null.cast("string"), failure_count=F.lit(0), paused_until=null.cast("timestamp"), last_failed_at=null.cast("timestamp"))


def blocked(sources: DataFrame, where: Column, at: Column, error: Column, after: int = DEFAULTS.failures_before_pause, hours: int = DEFAULTS.pause_hours) -> DataFrame:
    """After a block: one failure more, and a pause from a number of failures on."""
    n = F.coalesce("failure_count", F.lit(0)) + 1
    pause = F.when(n >= after, at + F.make_dt_interval(hours=F.lit(hours))).otherwise(F.col("paused_until"))
    return updated(sources, where, paused_until=pause, failure_count=n, last_error=error, last_failed_at=at, last_checked_at=at)


def unpaused(sources: DataFrame, where: Column) -> DataFrame:
    null = F.lit(None)
    return updated(sources, where, failure_count=F.lit(0), paused_until=null.cast("timestamp"), last_failed_at=null.cast("timestamp"), last_error=null.cast("string"))


def disabled_when_blocked(sources: DataFrame, least: int = DEFAULTS.failures_before_pause) -> DataFrame:
    return updated(sources, F.col("enabled") & (F.col("failure_count") >= least), enabled=F.lit(False))


def valid_interval(minutes: Column, least: int = DEFAULTS.min_interval_minutes) -> Column:
    """The interval, or an error if it is below the least one."""
    return F.when(minutes >= least, minutes).otherwise(F.raise_error(F.concat(F.lit("interval below minimum: "), minutes.cast("string"))).cast("int"))


def added(sources: DataFrame, new: DataFrame, least: int = DEFAULTS.min_interval_minutes) -> DataFrame:
    """sources with new ones: portal trimmed and lower case, interval checked, nothing checked yet."""
    rows = new.withColumn("portal", F.lower(F.trim("portal"))).withColumn("interval_minutes", valid_interval(F.col("interval_minutes"), least)).withColumn("failure_count", F.lit(0))
    return sources.unionByName(rows, allowMissingColumns=True)


def with_intervals(sources: DataFrame, where: Column, minutes: int, enabled_only: bool = False, least: int = DEFAULTS.min_interval_minutes) -> DataFrame:
    hit = where & F.col("enabled") if enabled_only else where
    return updated(sources, hit, interval_minutes=valid_interval(F.lit(minutes), least))


def pause_lines(sources: DataFrame, now: Column) -> DataFrame:
    """A line of text for each paused source."""
    return sources.where(is_paused(now)).select("id", F.format_string("%s #%d en pausa hasta %s", "portal", "id", F.date_format("paused_until", "yyyy-MM-dd HH:mm")).alias("line"))
