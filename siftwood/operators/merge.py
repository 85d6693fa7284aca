"""Keyed merges: sightings into snapshots, field by field. Arrival order is a column, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import append_line, text
from ..functions.urls import canonical_url, url_hash
from .identity import with_component

FIRST_TEXT = ("company", "portal", "normalized_url", "url_hash")
LONGEST = ("location", "modality", "salary", "description", "requirements", "raw_posted_text")
FIRST_VALUE = ("published_at", "found_at", "source_id")


def longest(c: str, seq: str = "seq") -> Column:
    """The longest text; the earliest of equally long ones."""
    return F.coalesce(F.max_by(text(c), F.struct(F.length(text(c)), -F.col(seq))), F.lit(""))


def first_text(c: str, seq: str = "seq") -> Column:
    """The earliest text that is not empty."""
    return F.coalesce(F.min_by(c, F.when(F.trim(text(c)) != "", F.col(seq))), F.lit(""))


def first_value(c: str, seq: str = "seq") -> Column:
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))


def last_value(c: str, seq: str = "seq") -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))


def notes_in_order(c: str = "notes", seq: str = "seq") -> Column:
    """Notes one after the other in order of arrival, none that is said already."""
    said = F.array_sort(F.collect_list(F.when(F.trim(text(c)) != "", F.struct(F.col(seq).alias("seq"), F.col(c).alias("note")))))
    return F.aggregate(said, F.lit(""), lambda all_, n: append_line(all_, n["note"]))


def keep_first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def own_key() -> Column:
    """The url of an offer; without one its seq."""
    return F.coalesce(F.nullif(F.trim(text("url")), F.lit("")), F.concat(F.lit("#"), F.col("seq").cast("string")))


def identified(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with key: the url of the offer that it is, by url, else by canonical url, else by title, company and portal in lower case, else its own.

    existing: offers with url, normalized_url, title, company, portal and seq; of several matches the earliest counts. Each match is a join
    of its own, whose right side has one row for a key. A blank url matches nothing, nor do names without a title and a company; a
    row that matches nothing and has no url is an offer of its own, whose key is made of its seq.
    """
    lower = lambda c: F.lower(text(c))
    order = [F.col("found_at").asc_nulls_last(), F.col("seq")]
    by_url = existing.where(text("url") != "").select("url", F.col("url").alias("__by_url")).distinct()
    by_norm = keep_first_rows(existing.where(text("normalized_url") != ""), ["normalized_url"], order).select("normalized_url", F.col("url").alias("__by_norm"))
    nat = existing.withColumns({"__t": lower("title"), "__c": lower("company"), "__p": lower("portal")}).where("trim(__t) <> '' and trim(__c) <> '' and url <> ''")
    by_nat = keep_first_rows(nat, ["__t", "__c", "__p"], order).select("__t", "__c", "__p", F.col("url").alias("__by_nat"))
    rows = incoming.withColumn("normalized_url", F.when(F.trim(text("url")) == "", "").otherwise(canonical_url("url"))).withColumn("url_hash", url_hash("normalized_url"))
    rows = rows.withColumns({"__t": lower("title"), "__c": lower("company"), "__p": lower("portal")})
    rows = rows.join(by_url, "url", "left").join(by_norm, "normalized_url", "left").join(by_nat, ["__t", "__c", "__p"], "left")
    # new among themselves: the earliest row of the same canonical url, then of the same names, gives the key
    fresh = F.coalesce("__by_url", "__by_norm", "__by_nat")
    # rows without the one or the other are each alone, so they neither meet nor pile up in one task
    alone = F.concat(F.lit("#"), F.col("seq").cast("string"))
    rows = rows.withColumn("__u", F.coalesce(F.nullif("normalized_url", F.lit("")), alone))
    rows = rows.withColumn("__own", F.first(own_key()).over(Window.partitionBy("__u").orderBy("seq")))
    rows = rows.withColumn("__t", F.when((F.trim("__t") == "") | (F.trim("__c") == ""), alone).otherwise(F.col("__t")))
    same_name = F.first("__own").over(Window.partitionBy("__t", "__c", "__p").orderBy("seq"))
    rows = rows.drop("__u")
    return rows.withColumn("key", F.coalesce(fresh, same_name)).drop("__t", "__c", "__p", "__own", "__by_url", "__by_norm", "__by_nat")


def merged_offers(existing: DataFrame, incoming: DataFrame, chains: bool = False, found: DataFrame | None = None) -> DataFrame:
    """Snapshot of accepted offers after a batch, one row per key.

    The title and url stay the first ones; company, portal, canonical url and hash are the first that are not empty; place, modality, salary and
    texts the longest; dates and source the first known; the application type the first known; notes are added. Both
    inputs have seq, smaller in existing. chains: offers are the same through any number of others (A like B by url, B like C by
    name), which may make two existing offers one; found says which (seq, component), else it is worked out from the rows. Without chains they end after two links.
    """
    if chains or found is not None:
        arrived = incoming.withColumn("normalized_url", F.when(F.trim(text("url")) == "", "").otherwise(canonical_url("url"))).withColumn("url_hash", url_hash("normalized_url"))
        both = with_component(existing.unionByName(arrived, allowMissingColumns=True), found).withColumnRenamed("component", "key")
    else:
        both = existing.withColumn("key", own_key()).unionByName(identified(existing, incoming), allowMissingColumns=True)
    have = set(both.columns)
    for c in ("notes", "application_type"):
        if c not in have:
            both = both.withColumn(c, F.lit("").cast("string"))
    known = F.min_by("application_type", F.when(~text("application_type").isin("", "unknown"), F.col("seq")))
    return both.groupBy("key").agg(
        F.min_by("title", "seq").alias("title"), F.min_by("url", "seq").alias("url"),
        *(first_text(c).alias(c) for c in FIRST_TEXT if c in have), *(longest(c).alias(c) for c in LONGEST if c in have),
        *(first_value(c).alias(c) for c in FIRST_VALUE if c in have), F.coalesce(known, F.lit("unknown")).alias("application_type"),
        notes_in_order().alias("notes"), F.min("seq").alias("seq"), F.sum(F.coalesce("sightings", F.lit(1).cast("long")) if "sightings" in have else F.lit(1).cast("long")).alias("sightings"),
    ).drop("key")


def merged_discarded(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshot of discarded rows after a batch, one row per url_hash.

    seen_count goes up by one a sighting (an old count below one is one); reasons, keywords, found and last seen are those of the last arrival; the
    score is the last one known; texts are the longest.
    """
    old = existing.withColumn("__n", F.greatest(F.lit(1), F.coalesce("seen_count", F.lit(0))))
    new = incoming.withColumn("__n", F.lit(1)).withColumn("last_seen_at", F.col("found_at"))
    both = old.unionByName(new, allowMissingColumns=True).where(text("url_hash") != "")
    have = set(both.columns)
    last = [c for c in ("discard_reasons", "detected_keywords", "target_role", "source_url") if c in have]
    return both.groupBy("url_hash").agg(
        F.min_by("title", "seq").alias("title"), *(first_text(c).alias(c) for c in ("company", "portal", "normalized_url") if c in have),
        *(longest(c).alias(c) for c in LONGEST if c in have), *(F.max_by(c, "seq").alias(c) for c in last), last_value("compatibility_score").alias("compatibility_score"),
        F.max_by("found_at", "seq").alias("found_at"), F.max_by("last_seen_at", "seq").alias("last_seen_at"), F.sum("__n").cast("int").alias("seen_count"), F.min("seq").alias("seq"),
    )


def seen_hashes(sightings: DataFrame, hash_col: str = "url_hash", at_col: str = "found_at", portal_col: str = "portal") -> DataFrame:
    """First and last time of each hash, and the portal of the first."""
    return sightings.groupBy(hash_col).agg(F.min(at_col).alias("first_seen_at"), F.max(at_col).alias("last_seen_at"), F.min_by(portal_col, at_col).alias(portal_col))


def without_accepted(discarded: DataFrame, accepted: DataFrame) -> DataFrame:
    """Discarded rows whose hash was not accepted meanwhile."""
    return discarded.join(accepted.select("url_hash"), "url_hash", "left_anti")


def cascade(offers: DataFrame, where: Column, **dependents: DataFrame) -> dict[str, DataFrame]:
    """Deletes the offers for which a condition holds, and the rows of dependent tables (by url_hash) with them: the tables that remain."""
    gone = offers.where(where).select("url_hash").distinct()
    out = {"offers": offers.where(~F.coalesce(where, F.lit(False)))}
    for name, table in dependents.items():
        out[name] = table.join(gone, "url_hash", "left_anti")
    return out


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Rows with new values where a condition holds: status, notes, intervals, flags."""
    return rows.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full overwrite by key: the new row where there is one, else the old."""
    value_cols = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*value_cols).alias("__old"))
    n = new.select(*keys, F.struct(*value_cols).alias("__new"))
    both = o.join(n, keys, "full_outer").withColumn("__v", F.coalesce("__new", "__old"))
    return both.select(*keys, *(F.col(f"__v.{c}").alias(c) for c in value_cols))
