"""Digests of any length: the scan over chunks equals packing entry by entry, for any chunks and partitions."""

import random

import pytest
from pyspark.sql import functions as F

from siftwood.config import Settings
from siftwood.operators import digest, long_digest


def one_by_one(chars, room):
    part, size, out = 0, None, []
    for n in chars:
        if size is None or size + 2 + n > room:
            part, size = part + 1, n
        else:
            size += 2 + n
        out.append(part)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_chunks_compose_to_the_fold(seed):
    rng = random.Random(seed)
    room = rng.choice([-5, 0, 1, 7, 40, 300])
    chars = [rng.choice([0, 1, rng.randrange(12), rng.randrange(400)]) if seed % 3 else rng.randrange(4) for _ in range(rng.randrange(1, 60))]
    import numpy as np

    cuts, at = [], 0
    while at < len(chars):
        n = rng.randrange(1, 9)
        cuts.append(np.array(chars[at : at + n], dtype=np.int64))
        at += n
    tables = [long_digest.cases(c, room) for c in cuts]
    whole = tables[0]
    for case in tables[1:]:
        whole = long_digest.composed(whole, case, room)
    for size in {0, max(0, room), *(rng.randrange(max(1, room + 1)) for _ in range(9))}:
        part, now = 0, size
        for c in chars:
            part, now = (part + 1, c) if now + 2 + c > room else (part, now + 2 + c)
        assert long_digest.after_chunk(size, room, whole) == (part, min(now, max(0, room)))


@pytest.mark.parametrize("chunk,fan", [(1, 2), (3, 2), (7, 3), (4096, 64)])
def test_parts_equal_the_fold_in_any_chunks(spark, chunk, fan):
    rng = random.Random(chunk)
    lists = {b: ([rng.choice([0, 3, 90, rng.randrange(200)]) for _ in range(n)], room) for b, n, room in ((0, 83, 100), (83, 1, 5), (84, 40, 2000), (124, 30, -9))}
    rows = [(b, i + 1, c, room) for b, (chars, room) in lists.items() for i, c in enumerate(chars)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "base long, position long, chars long, room long").repartition(3)
    got = {(r["base"], r["position"]): r["part"] for r in long_digest.part_numbers(df, chunk, fan).collect()}
    assert got == {(b, i + 1): p for b, (chars, room) in lists.items() for i, p in enumerate(one_by_one(chars, room))}
    assert long_digest.part_numbers(df.where("false"), chunk, fan).count() == 0


def offers(spark, n, groups=3):
    rows = spark.range(n).select(
        F.concat(F.lit("h"), "id").alias("url_hash"), F.concat(F.lit("T"), F.expr("repeat('x', int(id * 7 % 90))")).alias("title"), F.when(F.col("id") % 11 > 0, (F.col("id") % 5).cast("double")).alias("compatibility_score"),
        F.when(F.col("id") % 3 > 0, F.lit("2024-01-01").cast("timestamp")).alias("found_at"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("").alias("raw_posted_text"),
        F.lit("u").alias("url"), F.lit("unknown").alias("application_type"), F.when(F.col("id") % 7 > 0, (F.col("id") % groups).cast("string")).alias("company"), F.lit("p").alias("portal"), F.lit("").alias("location"), F.lit("").alias("modality"),
    )
    return rows.withColumn("compatibility_score", F.coalesce("compatibility_score", F.lit(0.0)))


@pytest.mark.parametrize("by", [None, "company"])
def test_unbounded_digest_equals_the_bounded_one(spark, by):
    rows = offers(spark, 400)
    # a bound that is never reached packs in one task
    want = digest.digest(rows, Settings(digest_max_rows=10_000, digest_max_chars=900), by=by)
    got = digest.digest(rows, Settings(digest_max_chars=900), by=by)
    assert sorted(got.columns) == sorted(want.columns)
    cols = [*([by] if by else []), "part", "parts", "message", "keys"]
    key = lambda r: tuple(map(str, r))
    a, b = (sorted((tuple(r) for r in x.select(*cols).collect()), key=key) for x in (got, want))
    assert len(a) > 20
    assert a == b and (not by or any(r[0] is None for r in a))


def test_no_window_over_all_rows(spark):
    out = digest.digest(offers(spark, 50), Settings())
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_and_single(spark):
    rows = offers(spark, 400)
    assert digest.digest(rows.where("false"), Settings()).count() == 0
    one = digest.digest(rows.limit(1), Settings(digest_max_chars=1, digest_min_chars=1)).collect()
    assert len(one) == 1 and one[0]["parts"] == 1 and "Parte" not in one[0]["message"]
