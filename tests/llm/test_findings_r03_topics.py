"""Topics of the mix come from all texts (F4, F5)."""

import numpy as np

from siftwood.llm import mixing


def test_topics_are_fitted_on_every_text(spark):
    """A word that one text alone has is known to the topics, however many texts there are."""
    rng = np.random.default_rng(1)
    common = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(common, 8)) for _ in range(6000)] + [f"only{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string").repartition(5)
    mixed = {r["doc_id"]: r["__topic"] for r in mixing.mixture(docs, columns=("doc_id",)).collect()}
    assert mixing.NO_TOPIC not in mixed.values() and len(set(mixed.values())) == mixing.TOPICS
    # texts that go along with the rows are read anew: the same topics, and copies change none
    again = mixing.mixture(docs.unionByName(docs.where("doc_id % 3 = 0")))
    assert {(r["doc_id"], r["__topic"]) for r in again.select("doc_id", "__topic").collect()} == set(mixed.items())


def test_fewer_texts_than_topics(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, "c d", "s", "en"), (3, "a b", "s", "en"), (4, " ", "s", "en")], "doc_id long, text string, source string, lang string")
    got = {r["doc_id"]: r["__topic"] for r in mixing.mixture(docs, columns=("doc_id",)).collect()}
    assert got[1] == got[3] != got[2] and got[4] == mixing.NO_TOPIC and mixing.NO_TOPIC not in (got[1], got[2])
