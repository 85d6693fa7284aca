"""A monitoring cycle as one plan: gate, merge, remember, queue, pack."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators.digest import digest
from ..operators.identity import components, known_by
from ..operators.merge import merged_discarded, merged_offers, seen_hashes, without_accepted
from ..operators.routing import accepted, discarded, notifiable, routed, run_stats
from ..operators.scoring import with_match
from ..shared import written


@dataclass
class CycleResult:
    offers: DataFrame
    discarded: DataFrame
    seen: DataFrame
    stats: DataFrame
    digest: DataFrame
    gated: DataFrame
    tokens: DataFrame | None = None


def run_cycle(listings: DataFrame, offers: DataFrame, rejected: DataFrame, seen: DataFrame, target: Column | str, now: Column, profile: DataFrame | None = None, settings: Settings = DEFAULTS, chains: DataFrame | None = None) -> CycleResult:
    """One cycle over a batch of listings (with seq, larger than any before) and the snapshots so far.

    chains: what the offers so far are known by (seq, token). With it chains of alike listings of any length are one offer, and tokens of the result has what
    its offers and the batch's accepted listings are known by, each token with the offer that it leads to.

    Running the same batch again changes no offer and queues nothing that is notified. The gated batch and the
    merged offers feed several outputs and are written to the shared folder for them, each worked out once.
    """
    # worked out once each: a plan that holds the rules of the gate, of identity and of the score at once takes minutes to build
    gated = written(routed(listings, target, profile, settings.only_easy_apply))
    yes, no = accepted(gated), discarded(gated)
    leads = None
    if chains is not None:
        members = written(chains.select("seq", "token").unionByName(known_by(yes)))
        found = written(components(members))
        leads = members.join(found, "seq").select("token", F.col("component").alias("seq")).distinct()
    merged = merged_offers(offers, yes.drop("relevance", "score", "reasons"), found=found if chains is not None else None)
    if chains is None:
        merged = written(merged)
    merged = with_match(merged, profile).withColumn("compatibility_score", F.col("score").cast("double")).withColumnRenamed("reasons", "match_reason").drop("score")
    old = offers.select(F.col("seq").alias("__seq"), *(c for c in ("notified", "notified_at", "created_at") if c in offers.columns))
    if chains is not None:  # offers made one were notified if one of them was
        old = old.join(found.select(F.col("seq").alias("__seq"), "component"), "__seq", "left").groupBy(F.coalesce("component", "__seq").alias("__seq")).agg(
            *(f.alias(c) for c, f in (("notified", F.bool_or("notified")), ("notified_at", F.max("notified_at")), ("created_at", F.min("created_at"))) if c in offers.columns), F.count(F.lit(1)).alias("__n")
        ).drop("__n")
    merged = merged.join(old, F.col("seq") == F.col("__seq"), "left").drop("__seq")
    for c, t in (("notified", "boolean"), ("notified_at", "timestamp"), ("created_at", "timestamp")):
        if c not in merged.columns:
            merged = merged.withColumn(c, F.lit(None).cast(t))
    lost = no.select("*", F.col("review.reasons").alias("discard_reasons"), F.col("review.keywords").alias("detected_keywords"), F.col("review.score").alias("compatibility_score")).drop("review", "relevance", "score", "reasons")
    kept = without_accepted(merged_discarded(rejected, lost), yes)
    again = yes.select("url_hash", F.col("found_at").alias("first"), F.col("found_at").alias("last"), "portal")
    old_seen = seen.select("url_hash", F.col("first_seen_at").alias("first"), F.col("last_seen_at").alias("last"), "portal")
    hashes = old_seen.unionByName(again).groupBy("url_hash").agg(F.min("first").alias("first_seen_at"), F.max("last").alias("last_seen_at"), F.min_by("portal", "first").alias("portal"))
    merged = written(merged)  # for the snapshot and for the queue
    queue = notifiable(merged, now, settings.match_threshold, settings.freshness_hours, settings.only_easy_apply)
    return CycleResult(merged, kept, hashes, run_stats(gated, "source_id", "portal"), digest(queue, settings), gated, leads)


def dry_run(listings: DataFrame, target: Column | str, settings: Settings = DEFAULTS) -> DataFrame:
    """What a cycle would do with each listing, without writing anything and without a profile."""
    rows = routed(listings, target, None, settings.only_easy_apply)
    return rows.select("title", "url", F.when(F.col("review").isNull(), "accepted").otherwise("discarded").alias("outcome"), F.coalesce(F.col("review.reasons"), F.col("relevance.reasons")).alias("reasons"))


__all__ = ["CycleResult", "dry_run", "run_cycle", "seen_hashes"]
