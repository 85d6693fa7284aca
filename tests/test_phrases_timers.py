"""Phrases by dictionary against term by term search, and the failure machine's timers."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siftwood import fixed_values as V
from siftwood.functions import phrases, text
from siftwood.streaming import machine

TERMS = ["c#", ".net", "node.js", "front end", "sql", "a", "r", "react native", "+", "c++", "é", "SQL", "mesa de ayuda", "2.0", "x" * 30, "it's", "back\\slash"]


def texts():
    rng = random.Random(4)
    parts = [*TERMS, *V.SENIOR[:5], "the", "asp.net", "javascript", "sqlite", "reactnative", "я", "-", "mesa  de", "node", "js"]
    some = ["", "a", "c#", "ac# .net", "asp.net", "front end", "front  end", "xfront end", "front endx", "яsql", "c++11", "node.js!", "it's", "back\\slash"]
    return some + ["".join(rng.choice(parts) + rng.choice([" ", "", ", ", "."]) for _ in range(rng.randrange(1, 15))) for _ in range(300)]


def test_found_terms_equal_single_searches(spark):
    rows = spark.createDataFrame([(t,) for t in [*texts(), None]], "n string")
    got = rows.select("n", phrases.found_terms("n", TERMS).alias("found"), text.term_hits(F.coalesce("n", F.lit("")), TERMS).alias("want"), phrases.found_terms("n", []).alias("none")).collect()
    for r in got:
        assert r["found"] == (r["want"] if r["n"] is not None else []) and r["none"] == []
    rules = [("sql", 5, "knows sql"), ("c#", -3, "c sharp"), ("sql", 1, "again")]
    r = spark.createDataFrame([("sql c#",)], "n string").withColumn("f", phrases.found_terms("n", ["c#", "sql"])).select(phrases.points_of("f", rules).alias("p"), phrases.reasons_of("f", rules).alias("w"), phrases.among("f", ["sql", "a", "c#"]).alias("a")).first()
    assert (r["p"], r["w"], r["a"]) == (3, ["knows sql", "c sharp", "again"], ["sql", "c#"])


def test_rules_as_a_table(spark):
    rows = spark.createDataFrame([*enumerate(texts()), (9000, None)], "id long, n string")
    rules = spark.createDataFrame([(t, i) for i, t in enumerate(TERMS)] + [(None, 99), ("sql", 100)], "term string, rule int")
    got = sorted((r["id"], r["rule"]) for r in phrases.rule_hits(rows, "id", "n", rules).collect())
    worded = [(i, t) for i, t in [*enumerate(TERMS), (100, "sql")] if phrases.key_of(t)]
    single = rows.select("id", *(F.coalesce(text.has_term(F.col("n"), t), F.lit(False)).alias(f"r{i}") for i, t in worded)).collect()
    assert got == sorted((r["id"], i) for r in single for i, _ in worded if r[f"r{i}"])
    assert phrases.rule_hits(rows, "id", "n", rules.where("false")).count() == 0


def test_timers_end_pauses_over_micro_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    hour = lambda h: start + dt.timedelta(hours=h)
    events = [("s", hour(h), "blocked") for h in range(3)] + [("s", hour(10), "ok"), ("s", hour(40), "blocked"), ("t", hour(1), "blocked"), ("t", hour(2), "ok"), ("u", hour(60), "ok")]
    for low, high in ((0, 5), (5, 30), (30, 50), (50, 99)):
        part = [e for e in events if hour(low) <= e[1] < hour(high)]
        spark.createDataFrame(part, "source string, at timestamp, outcome string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source string, at timestamp, outcome string").parquet(str(tmp_path / "in"))
        machine.failure_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["source"], r["at"], r["outcome"], r["skipped"], r["failure_count"], r["paused_until"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["source"], r["at"], r["outcome"], r["skipped"], r["failure_count"], r["paused_until"]) for r in machine.simulate_failures(spark.createDataFrame(events, "source string, at timestamp, outcome string")).collect())
    assert [g for g in got if g[2] != machine.RESUMED] == want
    assert [g[:2] for g in got if g[2] == machine.RESUMED] == [("s", hour(26))]
