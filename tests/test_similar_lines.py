"""Similar lines by a join on rare words equal the loop over all kept lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftwood.fixed_values import TOKEN_STOPWORDS
from siftwood.operators import profile, similar_lines


def words(line):
    return {t for t in re.findall(r"[a-z0-9#+]+", (line or "").lower()) if t not in TOKEN_STOPWORDS and len(t) >= 3}


def loop(lines):
    kept = []
    for at, line in lines:
        s = words(line)
        if s and not any((o := len(s & k)) and ((o >= min(len(s), len(k)) >= 4) or (o >= 4 and o * 4 >= max(len(s), len(k)) * 3)) for _, _, k in kept):
            kept.append((at, line, s))
    return {(at, line) for at, line, _ in kept}


@pytest.mark.parametrize("seed,vocabulary", [(1, 9), (2, 14), (3, 30)])
def test_join_equals_the_loop(spark, seed, vocabulary):
    rng = random.Random(seed)
    names = [f"word{i}" for i in range(vocabulary)]
    lists = {g: [" ".join(rng.choice(names) for _ in range(rng.choice([0, 2, 4, 5, 8, 12]))) for _ in range(n)] for g, n in (("a", 150), ("b", 30), (None, 40))}
    rows = [(g, i, x) for g, lines in lists.items() for i, x in enumerate(lines)] + [("a", 1000, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, line string").withColumn("sig", F.lit(1)).withColumn("at", F.lit(2))
    got = {(r["g"], r["i"], r["line"]) for r in similar_lines.distinct_lines(df, "g", "i", "line").collect()}
    assert got == {(g, *x) for g, lines in lists.items() for x in loop(enumerate(lines))}


def test_copies_and_chains(spark):
    hot = [("h", i, "alpha beta gamma delta epsilon") for i in range(3000)]
    # each line is similar to the next alone: every other one stays
    chain = [("c", i, " ".join(f"w{j:03d}" for j in range(2 * i, 2 * i + 14))) for i in range(12)]
    df = spark.createDataFrame(hot + chain, "g string, i int, line string").repartition(3)
    got = sorted((r["g"], r["i"]) for r in similar_lines.distinct_lines(df, "g", "i", "line").collect())
    assert got == sorted([("h", 0)] + [("c", i) for i, _ in loop([(i, x) for _, i, x in chain])])
    assert len(got) == 7
    assert similar_lines.distinct_lines(df.where("false"), "g", "i", "line").count() == 0


def test_both_forms_agree(spark):
    lines = ["alpha beta gamma delta epsilon", "alpha beta gamma delta", "one two three", "one two three", "alpha beta gamma delta omega", "", "x", "four five six seven eight", "six seven eight four five nine"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "g int, i int, line string")
    got = [r["line"] for r in similar_lines.distinct_lines(df, "g", "i", "line").orderBy("i").collect()]
    assert got == spark.createDataFrame([(lines,)], "x array<string>").select(profile.distinct_bullets("x")).first()[0]
