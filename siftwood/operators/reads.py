"""Relational reads and deletes of the listing tables: filters, orders and limits as plans, nothing collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import json_list, text
from .merge import updated


def _named(c: str, value: str | None) -> Column:
    """Whether a column is a value, whatever its case; no value: always."""
    return F.lit(True) if not value else F.lower(c) == value.lower()


def _last_seen(rows: DataFrame, *names: str) -> Column:
    return F.coalesce(*(F.col(c) for c in names if c in rows.columns))


def offers(rows: DataFrame, portal: str | None = None) -> DataFrame:
    """Offers of a portal (or all), the latest found first; a unique id last keeps the order whole."""
    return rows.where(_named("portal", portal)).orderBy(_last_seen(rows, "found_at", "created_at").desc(), *_id(rows))


def fresh_offers(rows: DataFrame, now: Column, hours: int = 24, portal: str | None = None) -> DataFrame:
    """Offers that were found, published or created within so many hours before now."""
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    recent = F.lit(False)
    for c in ("found_at", "published_at", "created_at"):
        if c in rows.columns:
            recent = recent | F.coalesce(F.col(c) >= since, F.lit(False))
    return offers(rows.where(recent), portal)


def pending_offers(rows: DataFrame, threshold: float, portal: str | None = None, source_id: int | None = None) -> DataFrame:
    """Offers not yet notified with the wanted score, the best and then the latest first."""
    out = rows.where(~F.coalesce("notified", F.lit(False)) & (F.col("compatibility_score") >= threshold) & _named("portal", portal))
    out = out if source_id is None else out.where(F.col("source_id") == source_id)
    return out.orderBy(F.desc("compatibility_score"), _last_seen(rows, "found_at", "created_at").desc(), *_id(rows))


def _id(rows: DataFrame) -> list[Column]:
    return [F.col(c).desc() for c in ("id", "seq", "url_hash") if c in rows.columns][:1]


def _discarded(rows: DataFrame, portal: str | None, target_role: str | None) -> Column:
    return _named("portal", portal) & _named("target_role", target_role)


def discarded(rows: DataFrame, portal: str | None = None, target_role: str | None = None, limit: int | None = 20) -> DataFrame:
    """Discarded rows of a portal and target (or all), the latest seen first; limit None: all."""
    out = rows.where(_discarded(rows, portal, target_role)).orderBy(_last_seen(rows, "last_seen_at", "found_at", "created_at").desc(), *_id(rows))
    return out if limit is None else out.limit(limit)


def discarded_count(rows: DataFrame, portal: str | None = None, target_role: str | None = None) -> DataFrame:
    """One row with n, zero where there are none."""
    return rows.where(_discarded(rows, portal, target_role)).agg(F.count(F.lit(1)).alias("n"))


def discarded_listing(rows: DataFrame, portal: str | None = None, target_role: str | None = None, limit: int = 20) -> DataFrame:
    """The listing's rows with n_total, the number without the limit, and a line to show for each."""
    total = discarded_count(rows, portal, target_role).withColumnRenamed("n", "n_total")
    line = F.concat_ws(" | ", text("title"), text("company"), text("portal"), text("target_role"), short_reason("discard_reasons"), F.coalesce(F.nullif("normalized_url", F.lit("")), "url"))
    # the other side is one row
    return discarded(rows, portal, target_role, limit if limit > 0 else 20).crossJoin(F.broadcast(total)).withColumn("line", line)


def short_reason(reasons: Column | str) -> Column:
    """The first reason of a list; without one a default."""
    return F.coalesce(F.try_element_at(F.col(reasons) if isinstance(reasons, str) else reasons, F.lit(1)), F.lit("sin razon registrada"))


def without_discarded(rows: DataFrame, portal: str | None = None, target_role: str | None = None) -> DataFrame:
    """What remains when the discarded rows of a portal and target (or all) are cleared."""
    return rows.where(~F.coalesce(_discarded(rows, portal, target_role), F.lit(False)))


def sources(rows: DataFrame, portal: str | None = None, enabled_only: bool = False) -> DataFrame:
    """Search sources in the order of their ids."""
    out = rows.where(_named("portal", portal))
    return (out.where(F.coalesce("enabled", F.lit(False))) if enabled_only else out).orderBy("id")


def by_key(rows: DataFrame, **keys) -> DataFrame:
    """The rows with these values; an empty or missing value finds none. Equalities reach the scan."""
    out = rows
    for c, v in keys.items():
        out = out.where(F.lit(False)) if v in (None, "") else out.where(F.col(c) == F.lit(v))
    return out


def first_by(rows: DataFrame, order: str) -> DataFrame:
    """One row: the first by a column, as for the one stored profile."""
    return rows.orderBy(F.col(order).asc_nulls_last()).limit(1)


def possible_duplicates(rows: DataFrame, title: str, company: str, portal: str) -> DataFrame:
    """Offers with the same names, whatever their case."""
    return rows.where(_named("title", title or "") & _named("company", company or "") & _named("portal", portal or "")) if title and company and portal else rows.where(F.lit(False))


def json_block(stored: Column | str) -> Column:
    """A stored list as indented JSON; '[]' for none."""
    items = json_list(stored)
    quoted = F.transform(items, lambda x: F.concat(F.lit("  "), F.substring(F.to_json(F.array(x)), 2, 1 << 30)))
    body = F.array_join(F.transform(quoted, lambda x: F.substring(x, 1, F.length(x) - 1)), ",\n")
    return F.when(F.size(items) == 0, "[]").otherwise(F.concat(F.lit("[\n"), body, F.lit("\n]")))


def with_status(rows: DataFrame, id_col: str, id_: int, **values: Column) -> DataFrame:
    """rows with new values in one of them."""
    return updated(rows, F.col(id_col) == F.lit(id_), **values)
