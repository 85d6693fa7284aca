"""The watch loop: cycles over batches of listings, on bucketed snapshots that survive a replay.

A batch reads of the snapshots only the rows that it can change. Offers are found by what they are known by (a table of tokens); as offers that share a
token are one offer already, one look finds all that a batch can touch, also where it makes several offers one. Discarded rows and
sightings are found by their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from ..config import DEFAULTS, Settings
from ..functions.urls import canonical_url, url_hash
from ..operators.identity import known_by
from ..shared import written
from ..streaming.machine import run_cycles
from .cycle import run_cycle
from .snapshots import Snapshots, Table

OFFER = """seq BIGINT, title STRING, url STRING, company STRING, portal STRING, normalized_url STRING, url_hash STRING, location STRING, modality STRING, salary STRING,
description STRING, requirements STRING, raw_posted_text STRING, published_at TIMESTAMP, found_at TIMESTAMP, source_id BIGINT, application_type STRING, notes STRING, sightings BIGINT,
compatibility_score DOUBLE, match_reason ARRAY<STRING>, notified BOOLEAN, notified_at TIMESTAMP, created_at TIMESTAMP"""
DISCARDED = """seq BIGINT, url_hash STRING, title STRING, company STRING, portal STRING, normalized_url STRING, location STRING, modality STRING, salary STRING, description STRING, requirements STRING,
raw_posted_text STRING, discard_reasons ARRAY<STRING>, detected_keywords ARRAY<STRING>, compatibility_score DOUBLE, found_at TIMESTAMP, last_seen_at TIMESTAMP, seen_count INT"""
SEEN = "url_hash STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, portal STRING"
MESSAGE = "id STRING, batch BIGINT, part INT, parts INT, message STRING, keys ARRAY<STRING>"
STATS = "id STRING, batch BIGINT, source_id BIGINT, portal STRING, found BIGINT, accepted BIGINT, discarded BIGINT"


def store(spark: SparkSession, root: str, buckets: int = 256) -> Snapshots:
    """The snapshots of a watch: offers by seq of their first listing, tokens, discarded and seen by hash, and each cycle's messages and counts."""
    ddl = lambda text: StructType.fromDDL(text)
    return Snapshots(spark, root, {
        "offers": Table("seq", ddl(OFFER), buckets), "tokens": Table("token", ddl("token STRING, seq BIGINT"), buckets), "discarded": Table("url_hash", ddl(DISCARDED), buckets),
        "seen": Table("url_hash", ddl(SEEN), buckets), "messages": Table("id", ddl(MESSAGE), buckets), "stats": Table("id", ddl(STATS), buckets),
    })


def apply_batch(kept: Snapshots, stream: str, batch: int, listings: DataFrame, target: Column | str, now: Column, profile: DataFrame | None = None, settings: Settings = DEFAULTS) -> dict[str, set[int]]:
    """One cycle over a batch of listings (schema.LISTING; seq larger than any before), written to the snapshots at once; the buckets rewritten of each table.

    A batch that is in the snapshots already is left out. Whatever a batch that was cut short has written does not count, so it may simply come again.
    """
    if kept.holds(stream, batch):
        return {}
    rows = written(schema.evolved(listings, schema.LISTING))
    linked = written(kept.matching("tokens", known_by(rows).select("token")))
    offers = written(kept.matching("offers", linked.select("seq")))
    hashes = written(rows.select(url_hash(canonical_url("url")).alias("url_hash")).distinct())
    rejected, seen = kept.matching("discarded", hashes), kept.matching("seen", hashes)
    out = run_cycle(rows, offers, rejected, seen, target, now, profile, settings, chains=linked)
    merged, leads, lost, again = out.offers, written(out.tokens), written(out.discarded), written(out.seen)
    # offers that became part of another leave tokens behind that the batch does not have; they are looked for only then
    gone = written(offers.select("seq").join(merged.select("seq"), "seq", "left_anti"))
    if not gone.isEmpty():
        into = linked.join(gone, "seq").join(leads.withColumnRenamed("seq", "__to"), "token").select("seq", "__to").distinct()
        left = kept.read("tokens").join(into, "seq").select("token", F.col("__to").alias("seq"))
        leads = written(leads.unionByName(left.join(leads.select("token"), "token", "left_anti")))
    told = lambda rows, *key: rows.withColumn("batch", F.lit(batch).cast("long")).withColumn("id", F.concat_ws(":", F.lit(stream), F.lit(str(batch)), *key))
    done = kept.commit(stream, batch, {
        "offers": (offers.select("seq"), merged), "tokens": (leads.select("token"), leads), "discarded": (hashes, lost), "seen": (hashes, again),
        "messages": (hashes.where("false"), told(written(out.digest), F.col("part").cast("string"))), "stats": (hashes.where("false"), told(written(out.stats), F.col("source_id").cast("string"), F.col("portal"))),
    })
    return done


def watch(stream: DataFrame, kept: Snapshots, name: str, target: Column | str, now: Column, checkpoint: str, profile: DataFrame | None = None, settings: Settings = DEFAULTS, every: str | None = None):
    """Runs a cycle on each micro-batch of a stream of listings: all that is there, then stops; or every so often until stopped. May be restarted at any time with the same checkpoint."""

    def cycle(rows: DataFrame, number: int) -> None:
        # a micro-batch has a session of its own, in which the store's tables would not be found
        apply_batch(kept, name, number, rows, target, now, profile, settings)

    return run_cycles(stream, cycle, checkpoint, every)
