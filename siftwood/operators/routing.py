"""Gates: which listings are accepted, which are discarded and why, and counts of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.urls import canonical_url, url_hash
from .scoring import with_match, with_relevance

NOT_EASY_APPLY = "no es solicitud sencilla"


def needs_easy_apply(only_easy_apply: bool, portal: str = "linkedin") -> Column:
    """Listings of a portal whose application type the settings do not want."""
    if not only_easy_apply:
        return F.lit(False)
    return (F.lower(F.trim("portal")) == portal) & (F.coalesce("application_type", F.lit(V.UNKNOWN_APPLY)) != V.EASY_APPLY)


def routed(listings: DataFrame, target: Column | str, profile: DataFrame | None = None, only_easy_apply: bool = False) -> DataFrame:
    """listings with normalized_url, url_hash, score, reasons and review: NULL if accepted, else struct(reasons, keywords, score).

    The application type is looked at first and gives no score; then relevance for the target.
    """
    rows = with_match(with_relevance(listings, target), profile)
    gate = needs_easy_apply(only_easy_apply)
    review = F.when(gate, F.struct(F.array(F.lit(NOT_EASY_APPLY)).alias("reasons"), F.expr("cast(array() as array<string>)").alias("keywords"), F.lit(None).cast("double").alias("score"))).when(
        ~F.col("relevance.relevant"), F.struct(F.col("relevance.reasons").alias("reasons"), F.col("relevance.keywords").alias("keywords"), F.col("score").cast("double").alias("score"))
    )
    url = canonical_url("url")
    return rows.withColumn("normalized_url", url).withColumn("url_hash", url_hash("normalized_url")).withColumn("review", review)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("review is null").drop("review")


def discarded(rows: DataFrame) -> DataFrame:
    return rows.where("review is not null")


def run_stats(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: found, accepted and discarded rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("review").isNull()).alias("accepted"), F.count_if(F.col("review").isNotNull()).alias("discarded"))


def as_listing(discarded_rows: DataFrame) -> DataFrame:
    """Discarded rows as listings to be gated anew; their publication time is not kept."""
    return discarded_rows.withColumn("published_at", F.lit(None).cast("timestamp"))


def reprocessed(discarded_rows: DataFrame, target: Column | str, profile: DataFrame | None = None, only_easy_apply: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that pass now, rows that stay discarded with their new reasons); the application type counts only if asked for."""
    rows = routed(as_listing(discarded_rows), target, profile, only_easy_apply)
    return accepted(rows), discarded(rows)


def notifiable(rows: DataFrame, now: Column, threshold: float, hours: int = 24, only_easy_apply: bool = False, fresh_only: bool = True) -> DataFrame:
    """Offers not yet notified with the wanted score, fresh (if asked for) and of the wanted application type."""
    from ..functions.dates import is_fresh

    out = rows.where(~F.coalesce("notified", F.lit(False)) & (F.col("compatibility_score") >= threshold) & ~needs_easy_apply(only_easy_apply))
    return out.where(is_fresh("published_at", now, hours)) if fresh_only else out
