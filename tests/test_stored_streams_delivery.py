"""Counts and sightings in stored snapshots, and delivery with a journal, against plain loops."""

import datetime as dt
import os
from collections import Counter
from types import SimpleNamespace

import pytest

from siftwood.sources import delivery
from siftwood.streaming import windows

EVENTS = "id long, at timestamp, kind string, start int"
DAY = dt.datetime(2024, 1, 1)


def event(id, hours, kind="a"):
    return (id, None if hours is None else DAY + dt.timedelta(hours=hours), kind, 0)


def plain(events):
    """Counts in windows of four hours that slide by two, of events that differ in id and slide; those without an id are all different."""
    known, out = set(), Counter()
    for n, (id, at, kind, _) in enumerate(events):
        if at is None:
            continue
        slide = int((at - DAY).total_seconds() // 7200)
        if (id if id is not None else f"null-{n}", slide) in known:
            continue
        known.add((id if id is not None else f"null-{n}", slide))
        for back in (0, 1):
            out[(DAY + dt.timedelta(hours=2 * (slide - back)), kind)] += 1
    return dict(out)


def test_windows_count_late_and_repeated_events_once(spark, tmp_path):
    batches = [
        [event(1, 1), event(1, 1), event(2, 3, "b"), event(None, 5), event(None, 5), event(3, None)],
        [],
        [event(1, 1), event(4, 9, None), event(2, 3, "b")],
        # late by days, and an id that comes at another time
        [event(5, -60), event(1, 7), event(4, 9, None)],
    ]
    kept = windows.window_store(spark, str(tmp_path / "w"), spark.createDataFrame([], EVENTS), "id", ["kind"], buckets=8)
    for number, rows in enumerate(batches):
        before = kept.files("windows")
        hit = windows.apply_events(kept, "s", number, spark.createDataFrame(rows, EVENTS), "id", "at", "4 hours", "2 hours", ["kind"])
        assert {b for b, p in kept.files("windows").items() if before.get(b) != p} <= hit["windows"]
        assert hit["windows"] or not rows
        # a batch that comes again changes nothing
        assert windows.apply_events(kept, "s", number, spark.createDataFrame(rows, EVENTS), "id", "at", "4 hours", "2 hours", ["kind"]) == {}
    got = {(r["start"], r["kind"]): r["n"] for r in kept.read("windows").collect()}
    assert got == plain([e for rows in batches for e in rows])


def test_old_ids_are_forgotten_and_counts_stay(spark, tmp_path):
    kept = windows.window_store(spark, str(tmp_path / "w"), spark.createDataFrame([], EVENTS), "id", ["kind"], buckets=1)
    for number, rows in enumerate([[event(1, 1)], [event(2, 100)], [event(1, 1)]]):
        windows.apply_events(kept, "s", number, spark.createDataFrame(rows, EVENTS), "id", "at", "2 hours", "2 hours", ["kind"], within="1 day")
        if number == 1:
            assert [r["id"] for r in kept.read("ids").collect()] == [2]
    assert {r["start"].hour: r["n"] for r in kept.read("windows").collect()} == {0: 2, 4: 1}


def test_sightings_of_a_stream(spark, tmp_path):
    rows = [event(n % 7, (n * 37) % 50, None if n % 5 == 0 else "k") for n in range(60)] + [event(9, None)]
    for part in range(3):
        spark.createDataFrame(rows[part::3] + rows[:5], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = windows.sighting_store(spark, str(tmp_path / "s"), spark.createDataFrame([], EVENTS), ["id", "kind"], buckets=4)
    windows.keep_sightings(stream, kept, "s", str(tmp_path / "ck"), "at", ["id", "kind"]).awaitTermination()
    want = {}
    for id, at, kind, _ in rows:
        first, last = want.get((id, kind), (None, None))
        want[(id, kind)] = (at, at) if first is None else (min(first, at), max(last, at))
    assert {(r["id"], r["kind"]): (r["first_seen_at"], r["last_seen_at"]) for r in kept.read("sightings").collect()} == want


# ------------------------------------------------------------------ delivery


def posting(log, ends_at=None, fails=()):
    """A post that appends to a file; it ends the worker at its n-th message and raises for some."""

    def post(recipient, message):
        if message in fails:
            raise ConnectionError("unreachable")
        if ends_at is not None and os.path.exists(log) and sum(1 for _ in open(log)) >= ends_at:
            os._exit(1)
        with open(log, "a") as f:
            f.write(f"{recipient}:{message}\n")

    return post


def test_a_run_cut_half_way_resends_only_what_was_not_sent(spark, tmp_path):
    log, path = str(tmp_path / "posts"), str(tmp_path / "outbox")
    messages = spark.createDataFrame([(f"i{n}", "r", f"m{n}", n) for n in range(40)], "id string, recipient string, message string, run int").coalesce(1)
    with pytest.raises(Exception):  # noqa: B017  the worker's end comes as one of several errors
        delivery.deliver_pending(messages, path, "first", posting(log, ends_at=25), every=1)
    assert len(open(log).readlines()) == 25
    assert delivery.journal(spark, path).where("delivered").count() == 25
    delivery.deliver_pending(messages, path, "second", posting(log), every=7)
    assert sorted(open(log).read().split()) == sorted(f"r:m{n}" for n in range(40))
    told = {r["run"]: r for r in delivery.runs(spark, path).collect()}
    assert told["second"]["whole"] and told["second"]["delivered"] == 15 and not told.get("first", {"whole": False})["whole"]
    delivery.deliver_pending(messages, path, "third", posting(log))
    assert len(open(log).readlines()) == 40


def test_failed_posts_come_again_and_odd_rows_have_a_rule(spark, tmp_path):
    log, path = str(tmp_path / "posts"), str(tmp_path / "outbox")
    rows = [("a", "r", "x"), ("b", "r", "bad"), ("c", None, None), (None, "r", "lost"), ("d", "s", "2"), ("d", "r", "1"), ("e", "r", "long " * 50_000)]
    messages = spark.createDataFrame(rows, delivery.MESSAGE)
    delivery.deliver_pending(messages, path, "1", posting(log, fails=("bad",)))
    notes = {r["id"]: (r["recipient"], r["delivered"], r["error"]) for r in delivery.journal(spark, path).collect()}
    assert notes == {"a": ("r", True, None), "b": ("r", False, "ConnectionError: unreachable"), "c": (None, True, None), "d": ("r", True, None), "e": ("r", True, None)}
    delivery.deliver_pending(messages, path, "2", posting(log))
    assert sorted(x[:5] for x in open(log).read().splitlines()) == ["None:", "r:1", "r:bad", "r:lon", "r:x"]
    empty = str(tmp_path / "none")
    delivery.deliver_pending(messages.where("false"), empty, "1", posting(log))
    assert delivery.journal(spark, empty).count() == 0


def test_an_attempt_that_is_run_again_reads_the_notes_before_it(spark, tmp_path):
    import pyarrow as pa

    sent = []

    def post(recipient, message):
        if len(sent) == 3 and message == "m3" and "again" not in sent:
            sent.append("again")
            raise SystemExit
        sent.append(message)

    poster = delivery.Poster(post, str(tmp_path / "o"), "r", 2)
    batch = pa.RecordBatch.from_pylist([{"id": f"i{n}", "recipient": "r", "message": f"m{n}"} for n in range(6)])
    with pytest.raises(SystemExit):
        poster.write(iter([batch]))
    # of the two posts of a note the second never came, so the first is sent again
    told = poster.write(iter([batch]))
    assert [x for x in sent if x != "again"] == ["m0", "m1", "m2", "m2", "m3", "m4", "m5"] and (told.delivered, told.failed) == (6, 0)


def test_speculation_is_refused():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "true"))
    with pytest.raises(RuntimeError, match="speculation"):
        delivery.deliver_pending(SimpleNamespace(sparkSession=session), "/o", "r", print)
