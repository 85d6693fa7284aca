"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwood.llm import ann, chat, embed_dedup, langid, lm, mixing, packing, pii, queries, simhash, toxicity

TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, label string, length int, weight double, probability double, component_id string, fp string, t string, kept boolean, topic string, value array<int>, __kept boolean, __topic string, __entities string, __found string, __rows int, __label int, __id long, __t string, row string, p double, source_ string"
ODD = [
    (1, "the same text as another one", "en", "a"), (1, "the same text as another one", "en", "a"), (2, "the same text as another one", "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, "   \n\t ", None, "b"),
    (None, "text without an id at all", "de", "b"), (6, "long " * 60_000, "en", None), (7, "x" * 200_000, "fr", "a"), (8, "mail a.b@c.com and 10.0.0.1", "en", "a"), (9, "ünï ß <|endoftext|> [INST] \\ \x00  ", "de", "c"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, None, 5, "s", None, 1, 0.5, None, "c", "f", "t", True, "p", [1], True, "t", "e", "f", 2, 1, 7, "t", "r", 0.1, "s") for r in rows], DOCS)


@pytest.fixture
def docs(spark):
    return table(spark, ODD)


@pytest.fixture
def none(spark):
    return table(spark, [])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 1), (8, 0, 7)], "doc_id long, quality int, toxic int")


def test_toxicity(docs, none, labels):
    got = toxicity.toxicity(docs, labels, F.lit(True), carry=("n_chars",)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len({round(r["score"], 12) for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.toxicity(none, labels, F.lit(True)).count() == 0
    assert toxicity.toxicity(docs, labels.where("false"), F.lit(True)).where("score < 0.3").count() == len(ODD)
    assert toxicity.accepted(docs, labels).columns == docs.columns


def test_packing(docs, none):
    got = packing.pack_documents(docs, TOKENIZER).collect()
    assert sorted(r["id"] for r in got if r["piece"] == 0 and r["id"] is not None) == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert {r["length"] for r in got if r["id"] in (3, 4, 5)} == {1}
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def test_simhash(docs, none):
    got = [(r["id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ODD) and {c for i, _, c in got if i in (1, 2)} == {1}
    assert {(f, c) for i, f, c in got if i in (3, 4, 5)} == {(0, 3)}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 3, 6, 7, 8, 9, None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


def test_language_and_model_scores(docs, none):
    got = langid.identify(docs, F.lit(True), carry=("score",) if False else ()).collect()
    assert len(got) == len(ODD) and {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert langid.identify(none, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    scored = lm.score(docs, F.col("doc_id") < 8).collect()
    assert len(scored) == len(ODD) and {r["n_tokens"] for r in scored if r["doc_id"] in (3, 4, 5)} == {1} and all(r["score"] < 0 for r in scored)
    assert {r["n_known"] for r in lm.score(docs, F.lit(False)).collect()} == {0}
    assert lm.score(none, F.lit(True)).count() == 0


def test_mixing_and_pii(docs, none):
    mixed = mixing.mixture(docs)
    assert mixed.count() == len(ODD) and mixed.where("__probability is null or __probability > 1").count() == 0
    assert mixing.sampled(docs).columns == docs.columns and mixing.sampled(none).count() == 0
    assert mixing.mixture(docs, targets={"lang": {"en": 1.0}}).where("lang <> 'en' and __probability > 0").count() == 0
    assert set(mixing.ADDED) < set(mixing.mixture(docs).columns) and len(mixing.mixture(docs).columns) == len(set(docs.columns) | set(mixing.ADDED))
    out = pii.pseudonymised(docs, 'k')
    assert out.columns == docs.columns and pii.pseudonymised(docs, "k", entities_col="found").columns == [*docs.columns, "found"]
    assert out.count() == len(ODD) and out.where("size(__entities) > 0").count() == 1 and pii.pseudonymised(none, 'k').count() == 0
    assert out.where("doc_id = 3").first()["text"] is None


def test_conversations(spark):
    ddl = "conv_id long, turn long, role string, text string, seq string, rendered string"
    rows = [(1, 0, "user", "a" * 300_000, "s", "r"), (1, 0, "user", "a" * 300_000, "s", "r"), (None, None, None, None, None, None)]
    assert chat.digests(spark.createDataFrame(rows, ddl)).count() == 2 and chat.format_turns(spark.createDataFrame(rows, ddl)).count() == 3
    assert chat.digests(spark.createDataFrame([], ddl)).count() == 0 and chat.format_turns(spark.createDataFrame([], ddl)).count() == 0


def test_vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int, id string, vec int, score int, cell int, n_links int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [], 1), (7, [3.0], 1)]
    df = spark.createDataFrame([(*r, "i", 0, 0, 0, 0) for r in rows], ddl)
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (0, 7)}
    near = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") < 3).collect())
    assert near == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3)]
    empty = spark.createDataFrame([], ddl)
    assert embed_dedup.near_duplicates(empty).count() == 0 and ann.nearest(empty, F.lit(True)).count() == 0
    only_bad = df.where("vec_id in (4, 5)")
    assert embed_dedup.near_duplicates(only_bad).count() == 2 and ann.nearest(only_bad, F.lit(True)).count() == 0
    assert embed_dedup.deduplicated(df).where("vec_id = 2").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, docs, none, sf, tmp_path, name, stage, empty):
    source = none if empty else docs
    out = stage(spark, source, sf)
    out.write.parquet(str(tmp_path / "o"))
    back = spark.read.parquet(str(tmp_path / "o"))
    assert (back.count() == 0) == empty
    if name != corpus_pipeline.STAGES[-1][0]:
        assert back.columns == source.columns


def test_pipeline_equals_its_stages(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    got = corpus_pipeline.run(spark, sf)
    same = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert same(got) == same(rows) and got.count() > 0


@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_run(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_queries_equal_their_sql(spark, sf, tmp_path):
    import os
    import subprocess
    import sys

    for name in queries.oracle_sql():
        queries.queries()[name](spark, sf).write.parquet(str(tmp_path / name))
    script = os.path.join(os.path.dirname(os.path.dirname(__file__)), "compare_sql.py")
    done = subprocess.run([sys.executable, script, sf, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout + done.stderr


def test_long_entities_are_replaced_in_linear_time(spark, tmp_path):
    """100,000 repetitions of whatever a pattern repeats neither end the executor nor take long."""
    import time

    n = 100_000
    hostile = [
        "a@b" + ".c" * n, "a" * n + "@b.com", "a@" + "b" * n + ".com", "a@b.com" + "." * n, "a@" * n, "Mr " * n, "Mr" + " " * n, "Mr " + "Ab" * n, "Mr " + "Ab-" * n, "Mr O" + "'Ab" * n, "Mr A" + "b" * n,
        "password=" + "aB3/" * n, "token: " + "ab01" * n, "password=" * n, "10.0.0.1." * n, "+1 " + "234-" * n, "(22" * n, "1" * n, "4111 " * n, "DE12 " + "ABCD " * n, "Dr. Prof. " * n + "Smith",
    ]
    rows = table(spark, [(i, text, "en", "a") for i, text in enumerate(hostile)]).repartition(4)
    built = pii.pseudonymised(rows, "k")
    began = time.time()
    got = {r["doc_id"]: r for r in built.select("doc_id", "text", "__entities").collect()}
    assert time.time() - began < 60
    for i, text in enumerate(hostile):
        assert len(got[i]["text"]) == len(text)
        assert (got[i]["text"] == text) == all(e["entity"] == e["surrogate"] for e in got[i]["__entities"])
    told = lambda i: (got[i]["__entities"][0]["kind"], len(got[i]["__entities"][0]["entity"]))
    assert told(0) == ("email", 3 + 2 * 127) and told(3) == ("email", 7) and told(10) == ("name", 4 + n) and told(11) == ("secret", 9 + 4 * n) and told(12)[0] == "secret"
    assert not got[1]["__entities"] and not got[2]["__entities"] and not got[7]["__entities"] and not got[14]["__entities"]
    corpus_pipeline.replace_personal_data(spark, rows, "").write.parquet(str(tmp_path / "o"))
