"""Streams whose memory is a stored snapshot: what is known of a key lies in hash buckets, and a micro-batch reads and rewrites the buckets of its keys alone.

The stream itself holds no state, so nothing grows in its executors and no event is too late: a late one goes into the buckets of its
window, whatever their age. A batch that comes again is known by the ledger of the snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..plans.snapshots import Snapshots, Table
from ..shared import written
from .machine import run_cycles


def _fields(rows: DataFrame, *names: str) -> list[StructField]:
    return [StructField(n, rows.schema[n].dataType) for n in names]


# ------------------------------------------------------------------ windows


def window_store(spark: SparkSession, root: str, events: DataFrame, id: str, keys: list[str], buckets: int = 256) -> Snapshots:
    """Tables of a count in windows: windows(start, end, keys, n) by start and ids(span, id) by the span of an event's time, so that recent events touch few buckets. The names start, end, n and span are taken."""
    counted = StructType.fromDDL("start TIMESTAMP, end TIMESTAMP")
    windows = StructType([*counted.fields, *_fields(events, *keys), *StructType.fromDDL("n BIGINT").fields])
    ids = StructType([*StructType.fromDDL("span TIMESTAMP").fields, StructField("id", events.schema[id].dataType)])
    return Snapshots(spark, root, {"windows": Table("start", windows, buckets), "ids": Table("span", ids, buckets)})


def apply_events(kept: Snapshots, stream: str, batch: int, events: DataFrame, id: str, at: str, length: str, slide: str, keys: list[str], within: str = "7 days") -> dict[str, set[int]]:
    """Adds a batch of events to the counts of the sliding windows that they lie in; the buckets rewritten of each table.

    An event is its id and the slide that its time lies in: repeated ones count once, by the least time and keys, whether they repeat in a batch or over batches.
    Ids older than `within` before a batch's last event are forgotten when their bucket is next rewritten; what repeats after that counts again. Late
    events always count. Events without a time are in no window; those without an id are all different. Null keys are a group.
    """
    if kept.holds(stream, batch):
        return {}
    rows = events.where(F.col(at).isNotNull()).select(F.window(at, slide)["start"].alias("span"), F.col(id).alias("id"), F.struct(F.col(at).alias("at"), *keys).alias("what"))
    named = written(rows.where("id is not null").groupBy("span", "id").agg(F.min("what").alias("what")))
    known = kept.read("ids", kept.touched("ids", named.select("span")))
    fresh = written(named.join(known, ["span", "id"], "left_anti"))
    last = named.agg(F.max("what.at").alias("last"))
    expired = known.select("span").distinct().join(F.broadcast(last), F.expr(f"span < last - interval {within}")).select("span")
    counts = fresh.select("what").unionByName(rows.where("id is null").select("what")).groupBy(F.window("what.at", length, slide).alias("w"), *(F.col(f"what.{k}").alias(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.select("w.start", "w.end", *keys, "n"))
    merged = kept.matching("windows", counts.select("start")).unionByName(counts).groupBy("start", "end", *keys).agg(F.sum("n").alias("n"))
    return kept.commit(stream, batch, {"ids": (expired, fresh.select("span", "id")), "windows": (counts.select("start"), merged)})


def count_windows(stream: DataFrame, kept: Snapshots, name: str, checkpoint: str, id: str, at: str, length: str, slide: str, keys: list[str], within: str = "7 days", every: str | None = None):
    """Counts a stream's events in sliding windows of a window_store: all that is there, then stops; or every so often until stopped."""
    return run_cycles(stream, lambda rows, number: apply_events(kept, name, number, rows, id, at, length, slide, keys, within), checkpoint, every)


# ------------------------------------------------------------------ sightings


def sighting_store(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], buckets: int = 256) -> Snapshots:
    """The table sightings(keys, first_seen_at, last_seen_at), in buckets by the hash of all keys; the names __key, first_seen_at and last_seen_at are taken."""
    fields = [*StructType.fromDDL("__key BIGINT").fields, *_fields(rows, *keys), *StructType.fromDDL("first_seen_at TIMESTAMP, last_seen_at TIMESTAMP").fields]
    return Snapshots(spark, root, {"sightings": Table("__key", StructType(fields), buckets)})


def apply_sightings(kept: Snapshots, stream: str, batch: int, rows: DataFrame, at: str, keys: list[str]) -> dict[str, set[int]]:
    """Widens first and last sighting of the keys of a batch; the buckets rewritten. Repeated rows change nothing, late ones move the first sighting back.

    A null key is a key; rows without a time make a key known and move nothing. Keys whose hashes meet are rewritten together and stay apart.
    """
    if kept.holds(stream, batch):
        return {}
    found = rows.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
    found = written(found.withColumn("__key", F.xxhash64(*keys)))
    both = kept.matching("sightings", found.select("__key")).unionByName(found)
    merged = both.groupBy("__key", *keys).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return kept.commit(stream, batch, {"sightings": (found.select("__key"), merged)})


def keep_sightings(stream: DataFrame, kept: Snapshots, name: str, checkpoint: str, at: str, keys: list[str], every: str | None = None):
    """First and last sightings of a stream's keys in a sighting_store. The stored form of machine.first_sightings, whose state is kept in the executors for good."""
    return run_cycles(stream, lambda rows, number: apply_sightings(kept, name, number, rows, at, keys), checkpoint, every)
