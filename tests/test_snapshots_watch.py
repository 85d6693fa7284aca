"""Chains of alike listings, bucketed snapshots, and the watch loop under replays and failures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftwood import schema
from siftwood.operators import identity, merge
from siftwood.plans import cycle, snapshots, watch

NOW = dt.datetime(2024, 1, 2)


def plain_components(members):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for node, token in members:
        a, b = find(("v", node)), find(("t", token))
        up[a] = b
    groups = {}
    for node, _ in members:
        groups.setdefault(find(("v", node)), set()).add(node)
    return {n: min(g) for g in groups.values() for n in g}


def test_components_of_chains_and_hot_tokens(spark):
    rng = random.Random(1)
    members = [(i, f"link{i}") for i in range(40)] + [(i + 1, f"link{i}") for i in range(40)]  # a chain of forty links
    members += [(1000 + i, "hot") for i in range(300)] + [(rng.randrange(2000, 2200), f"t{rng.randrange(150)}") for _ in range(250)] + [(5000, "alone")] * 2
    rng.shuffle(members)
    rows = spark.createDataFrame([*members, (None, "hot"), (7000, None)], "seq long, token string")
    assert {r["seq"]: r["component"] for r in identity.components(rows).collect()} == plain_components(members)
    assert identity.components(rows.where("false")).count() == 0


def listing(seq, url, title="Desarrollador backend junior", company="c", text="SQL Python APIs", **more):
    row = {"seq": seq, "url": url, "title": title, "company": company, "portal": "p", "location": "", "modality": "", "salary": "", "description": text, "requirements": "", "published_at": None,
           "found_at": NOW + dt.timedelta(minutes=seq), "raw_posted_text": "", "source_id": 1, "application_type": "unknown"}
    return tuple((row | more)[c.split()[0]] for c in schema.LISTING.replace("\n", " ").split(", "))


def test_ten_links_are_one_offer(spark):
    # 0 and 1 share a url, 1 and 2 a name, 2 and 3 a url ...
    rows = [listing(i, f"http://x/{i // 2}", title=f"Backend junior {(i + 1) // 2}", text="d" * i) for i in range(11)]
    batch = spark.createDataFrame([*rows, listing(20, "", company=""), listing(21, "", company="")], schema.LISTING)
    got = sorted((r["seq"], r["sightings"], r["description"]) for r in merge.merged_offers(batch.where("false").withColumns({"normalized_url": F.lit(""), "url_hash": F.lit("")}), batch, chains=True).collect())
    assert got == [(0, 11, "d" * 10), (20, 1, "SQL Python APIs"), (21, 1, "SQL Python APIs")]


def files(kept, table):
    found = {}
    for bucket, path in kept.files(table).items():
        found[bucket] = path
    return found


def test_a_batch_rewrites_only_the_buckets_that_it_touches(spark, tmp_path):
    kept = snapshots.Snapshots(spark, str(tmp_path / "s"), {"t": snapshots.Table("k", StructType.fromDDL("k LONG, v STRING"), 64)})
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    nothing = rows.select("k").where("false")
    kept.commit("s", 0, {"t": (nothing, rows)})
    before = files(kept, "t")
    assert len(before) == 64 and kept.read("t").count() == 1000
    new = spark.createDataFrame([(k, "new") for k in range(10)] + [(2000, "new")], "k long, v string")
    hit = kept.commit("s", 1, {"t": (new.select("k"), new)})["t"]
    after = files(kept, "t")
    assert {b for b in after if after[b] != before[b]} == hit and len(hit) <= 11
    assert {(r["k"], r["v"]) for r in kept.read("t").collect()} == {(k, "new" if k < 10 else "old") for k in range(1000)} | {(2000, "new")}
    # the same batch again changes nothing, nor does one whose state another has written
    assert kept.commit("s", 1, {"t": (nothing, rows)}) == {} and files(kept, "t") == after
    # a bucket may become empty
    kept.commit("s", 2, {"t": (kept.read("t").select("k"), rows.where("k = 5"))})
    assert [r["k"] for r in kept.read("t").collect()] == [5] and len(kept.files("t")) == 1
    gone = kept.vacuum(keep=1)
    assert {g for g in gone if g.startswith("t/")} == {"t/version=1", "t/version=2"} and [r["k"] for r in kept.read("t").collect()] == [5]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    kept = snapshots.Snapshots(spark, str(tmp_path / "s"), {"t": snapshots.Table("k", StructType.fromDDL("k LONG"), 4)})
    rows = spark.range(5).select(F.col("id").alias("k"))
    kept.commit("s", 0, {"t": (rows.where("false"), rows)})
    stale = kept.state()
    kept.commit("s", 1, {"t": (rows.where("false"), rows.selectExpr("k + 10 as k"))})
    monkeypatch.setattr(kept, "state", lambda: stale)
    with pytest.raises(RuntimeError):
        kept.commit("other", 0, {"t": (rows.where("false"), rows.selectExpr("k + 20 as k"))})


OFFER_COLUMNS = ("seq", "title", "url", "company", "description", "sightings", "compatibility_score", "normalized_url", "notified")


def rows_of(df, columns=OFFER_COLUMNS):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def batches():
    first = [listing(i, f"http://x/{i}", company=f"c{i}") for i in range(12)] + [listing(12, "http://x/3?utm_source=a", company="", text="a longer text with Python"), listing(13, "http://z/1", title="Asesor comercial", company="z")]
    second = [listing(20, "http://y/20", company="c4", text="another place"), listing(21, "http://x/5", company="c6", text="two offers become one"), listing(22, "http://z/1", title="Asesor comercial", company="z"), listing(23, "http://n/1", company="n")]
    # known by what only earlier sightings of the merged offers said
    third = [listing(30, "http://y/20", title="Backend junior otro", company="w", text="x" * 200), listing(31, "http://x/6", title="Backend junior otro", company="v")]
    return [first, second, third]


def test_batches_equal_the_merge_of_whole_snapshots(spark, tmp_path):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    kept = watch.store(spark, str(tmp_path / "w"), buckets=16)
    offers = spark.createDataFrame([], watch.OFFER)
    rejected, seen = spark.createDataFrame([], watch.DISCARDED), spark.createDataFrame([], watch.SEEN)
    links = spark.createDataFrame([], "seq long, token string")
    for number, rows in enumerate(batches()):
        batch = spark.createDataFrame(rows, schema.LISTING)
        before = kept.files("offers")
        hit = watch.apply_batch(kept, "s", number, batch, "backend_junior", now)
        assert {b for b, p in kept.files("offers").items() if before.get(b) != p} <= hit["offers"] and (number == 0 or len(hit["offers"]) < 8)
        whole = cycle.run_cycle(batch, offers, rejected, seen, "backend_junior", now, chains=links)
        offers, rejected, seen = (spark.createDataFrame(x.collect(), x.schema) for x in (whole.offers, whole.discarded, whole.seen))
        new = whole.tokens.collect()
        named = {r["token"]: r["seq"] for r in new}
        moved = {r["seq"]: named[r["token"]] for r in links.collect() if r["token"] in named}
        every = {r["token"]: moved.get(r["seq"], r["seq"]) for r in links.collect()} | named
        links = spark.createDataFrame([(s, t) for t, s in every.items()], "seq long, token string")
        assert rows_of(kept.read("offers")) == rows_of(offers)
        assert rows_of(kept.read("discarded"), ("url_hash", "seen_count", "title")) == rows_of(rejected, ("url_hash", "seen_count", "title"))
        assert rows_of(kept.read("seen"), ("url_hash", "first_seen_at", "last_seen_at")) == rows_of(seen, ("url_hash", "first_seen_at", "last_seen_at"))
        assert rows_of(kept.read("tokens"), ("token", "seq")) == rows_of(links, ("token", "seq"))
    found = {r["seq"]: r["sightings"] for r in kept.read("offers").collect()}
    assert found[3] == 2 and found[4] == 3 and found[5] == 4 and 6 not in found and found[23] == 1
    assert {r["seen_count"] for r in kept.read("discarded").collect()} == {2}


def test_a_stream_that_is_cut_between_two_writes_and_restarted(spark, tmp_path, monkeypatch):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    kept, whole = (watch.store(spark, str(tmp_path / n), buckets=8) for n in ("streamed", "batched"))
    publish = snapshots.Snapshots._publish

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema.LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        listings = spark.readStream.schema(StructType.fromDDL(schema.LISTING)).parquet(str(tmp_path / "in"))
        watch.watch(listings, kept, "s", "backend_junior", now, str(tmp_path / "ck")).awaitTermination()

    def cut(self, state):
        raise OSError("killed between two writes")

    for number, rows in enumerate(batches()[:2]):
        watch.apply_batch(whole, "s", number, spark.createDataFrame(rows, schema.LISTING), "backend_junior", now)
    run(batches()[0])
    first = rows_of(kept.read("offers"))
    monkeypatch.setattr(snapshots.Snapshots, "_publish", cut)
    with pytest.raises(Exception, match="killed between two writes"):
        run(batches()[1])
    # its buckets are written, but nothing reads them
    assert rows_of(kept.read("offers")) == first and not kept.holds("s", 1)
    monkeypatch.setattr(snapshots.Snapshots, "_publish", publish)
    run(None)
    assert watch.apply_batch(kept, "s", 1, spark.createDataFrame(batches()[1], schema.LISTING), "backend_junior", now) == {}
    for table, columns in (("offers", OFFER_COLUMNS), ("discarded", ("url_hash", "seen_count")), ("messages", ("id", "message")), ("stats", ("id", "found", "accepted"))):
        assert rows_of(kept.read(table), columns) == rows_of(whole.read(table), columns), table
    assert kept.read("messages").count() > 0 and kept.state()["batches"] == {"s": 1}
