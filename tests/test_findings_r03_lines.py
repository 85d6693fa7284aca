"""Similar lines of short lists are joined where the lists are gathered (F8)."""

import random

import pytest

from siftwood.operators import similar_lines
from test_similar_lines import loop


@pytest.mark.parametrize("most", [0, 900, 1 << 15])
def test_short_and_long_lists_follow_one_rule(spark, most, monkeypatch):
    monkeypatch.setattr(similar_lines, "PAIRS", 16)
    rng = random.Random(most)
    names = [f"word{i}" for i in range(12)]
    lists = {g: [" ".join(rng.choice(names) for _ in range(rng.choice([0, 2, 4, 5, 8, 12]))) for _ in range(n)] for g, n in [(None, 25), *((g, rng.choice([0, 1, 5, 20, 60])) for g in range(12))]}
    rows = [(g, i, x) for g, lines in lists.items() for i, x in enumerate(lines)] + [(3, 1000, None)]
    df = spark.createDataFrame(rows + rows[:40], "g int, i int, line string").repartition(3)
    got = [(r["g"], r["i"], r["line"]) for r in similar_lines.distinct_lines(df, "g", "i", "line", most).collect()]
    assert sorted(got, key=str) == sorted(((g, *x) for g, lines in lists.items() for x in loop(enumerate(lines))), key=str)


def test_short_lists_move_no_words(spark):
    """Lines are exchanged once, with their list; words by themselves never."""
    df = spark.createDataFrame([(g, i, f"alpha beta gamma delta x{g}") for g in range(5) for i in range(9)], "g int, i int, line string")
    plan = similar_lines.distinct_lines(df, "g", "i", "line")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
