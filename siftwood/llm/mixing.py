"""Mixing sources to target weights by iterative proportional fitting.

Words and the topic are worked out where documents are read, and tokens are counted per cell of source, language and topic.
A raked cell weight is n * a[source] * b[language] * c[topic]. A source's factor follows from b and c and its own cells alone, so a
round is one pass over the cells, grouped by source, that returns the sums by language and topic; b and c are then
fitted to those. What the driver holds is one number per language and topic, however many sources there are.
A document's probability is its cell's raked share over its present one, times a rate, capped at one and calibrated
anew after the cap. Sampling hashes the document id, so a rerun draws the same rows.

Topics are clusters of hashed words (spherical k-means over tf-idf), fitted on all distinct texts: texts become bags of
buckets once, and a round of k-means is a pass over the bags that returns sums by topic and bucket. A topic that is known
already can be given as a column.
"""

from __future__ import annotations

import json
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import Words, arrow_limits, as_strings, ensure_checkpoint_dir, give_back, row_sums, spans, written

ROUNDS, INNER_ROUNDS, TOLERANCE = 200, 20, 1e-9
#: Rounds without a gain of a thousandth after which targets that no weights can meet are given up.
PATIENCE = 10
#: Languages times topics that the driver may hold; more is an error, as such columns aren't languages or topics.
MAX_PAIRS = 2_000_000
#: Targets are the present shares to this power, renormalised (below one: small groups gain).
TEMPERATURE = 0.7
#: Share of all tokens that the mix should keep.
KEEP = 0.6
DIMS = ("source", "lang", "topic")
#: Hash buckets of words, topics, rounds of k-means between two splits and after the last, and splits beyond those that doubling takes.
BUCKETS, TOPICS = 4096, 8
SPLIT_ROUNDS, LAST_ROUNDS, MORE_SPLITS = 2, 8, 3
#: Components of unit vectors are added up as multiples of this share: sums of whole numbers are the same in any order.
GRAIN = 1 << 30
#: Numbers of a vector of sums that travel together.
SLICE = 512
NO_TOPIC = "none"


# ---------------------------------------------------------------- topics and tokens


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and the rows' starts."""
    from xxhash import xxh3_64_intdigest

    index, distinct = words.encoded()
    bucket = np.fromiter((xxh3_64_intdigest(w) & (BUCKETS - 1) for w in distinct.to_pylist()), np.int64, len(distinct))
    return bucket[index], words.row_starts()


def _bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each row, how often each is there, and the rows' starts in both."""
    bucket, starts = _buckets(words)
    rows = len(starts) - 1
    found, n = np.unique(np.repeat(np.arange(rows), np.diff(starts)) * BUCKETS + bucket, return_counts=True)
    return (found % BUCKETS).astype(np.uint16), n.astype(np.uint32), np.searchsorted(found, np.arange(rows + 1) * BUCKETS)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _unpacked(b: pa.Array, n: pa.Array, rows: int = 500):
    """(buckets, counts, starts) of so many rows at a time, which bounds the temporaries: a row has at most BUCKETS."""
    for i in range(0, len(b), rows):
        parts = [b.slice(i, rows), n.slice(i, rows)]
        starts = np.concatenate([[0], np.cumsum(pc.binary_length(parts[0]).to_numpy(zero_copy_only=False))]) // 2
        yield np.frombuffer(b"".join(parts[0].to_pylist()), np.uint16), np.frombuffer(b"".join(parts[1].to_pylist()), np.uint32), starts


def _bagged(docs: DataFrame) -> DataFrame:
    """docs, whose last column t is the text, with tokens, b and n (a bag: distinct buckets and their counts) instead of t."""
    kept = docs.columns[:-1]

    def run(batches):
        for batch in batches:
            col, parts = as_strings(batch.column(len(kept))), []
            for i, j in spans(col, 1 << 20):
                words = Words(col[i:j])
                b, n, starts = _bags(words)
                parts.append((pa.array(np.maximum(words.per_row, 1), pa.int64()), _packed(b, starts), _packed(n, starts)))
            if parts:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.concat_arrays(p) for p in zip(*parts, strict=True))], [*kept, "tokens", "b", "n"])
        give_back()

    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("tokens", T.LongType()), T.StructField("b", T.BinaryType()), T.StructField("n", T.BinaryType())])
    return docs.mapInArrow(run, schema)


def _added(rows: DataFrame, count, size: int) -> np.ndarray:
    """The sum over tasks of count(batches), a whole-number vector of that size; slices of the vectors are added where they meet."""
    slices = -(-size // SLICE)

    def cut(batches):
        total = np.zeros(slices * SLICE, np.int64)
        total[:size] = count(batches)
        at = np.flatnonzero(total.reshape(slices, SLICE).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in at], pa.binary())], ["at", "s"])
        give_back()

    def add(batches):
        sums = {}
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(s, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["at", "s"])

    got = rows.mapInArrow(cut, "at long, s binary").repartition("at").mapInArrow(add, "at long, s binary").toArrow()
    total = np.zeros(slices * SLICE, np.int64)
    for i, s in zip(got["at"].to_pylist(), got["s"].to_pylist(), strict=True):
        total[i * SLICE : (i + 1) * SLICE] = np.frombuffer(s, np.int64)
    return total[:size]


def _sums(bags: DataFrame, idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(centroids x buckets) sums, in GRAINs, of the unit tf-idf vectors nearest to each centroid."""
    k = len(centroids)
    told = bags.sparkSession.sparkContext.broadcast((idf, centroids * idf))

    def count(batches):
        weight, w = told.value
        total = np.zeros(k * BUCKETS, np.int64)
        for batch in batches:
            for b, n, starts in _unpacked(batch.column(0), batch.column(1)):
                b, n = b.astype(np.int64), n.astype(np.float64)
                near = np.stack([row_sums(n * c[b], starts) for c in w]).argmax(0)
                x = n * weight[b]
                norm, sizes = np.sqrt(row_sums(x * x, starts)), np.diff(starts)
                # rows of words that all texts have are nowhere
                x *= np.repeat(np.divide(GRAIN, norm, out=np.zeros_like(norm), where=norm > 0), sizes)
                total += np.bincount(np.repeat(near * BUCKETS, sizes) + b, np.rint(x), k * BUCKETS).astype(np.int64)
        return total

    sums = _added(bags.select("b", "n"), count, k * BUCKETS)
    told.destroy()
    return sums.reshape(k, BUCKETS)


def _kmeans(bags: DataFrame, idf: np.ndarray, topics: int) -> np.ndarray:
    """Unit centroids, at most so many: the fullest are split along fixed chance directions, whose sides are about equally full, and rounds follow."""
    rng = np.random.default_rng(17)
    c, full = np.zeros((1, BUCKETS)), np.ones(1)
    # a side may turn out empty and goes: some more splits than it takes to double up to topics
    for _ in range((topics - 1).bit_length() + MORE_SPLITS):
        most = np.argsort(-full, kind="stable")[: topics - len(c)]
        step = 0.1 * rng.standard_normal((len(most), BUCKETS)) / np.sqrt(BUCKETS)
        c = np.concatenate([np.delete(c, most, 0), c[most] + step, c[most] - step])
        last = None
        for _ in range(LAST_ROUNDS if len(c) == topics else SPLIT_ROUNDS):
            sums = _sums(bags, idf, c)
            if last is not None and np.array_equal(sums, last):
                break
            last, sums = sums, sums[(sums != 0).any(1)].astype(np.float64)
            if not len(sums):
                return sums
            full = np.linalg.norm(sums, axis=1)
            lost, c = len(c) - len(sums), sums / full[:, None]
            if lost:
                break
        if len(c) == topics:
            break
    return c


def fitted_topics(bags: DataFrame, topics: int = TOPICS) -> np.ndarray:
    """(buckets x topics) weights of words: centroids over all distinct texts of bags(h, b, n), where h is a hash of the text."""

    def count(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            total[:BUCKETS] += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16), minlength=BUCKETS)
            total[BUCKETS] += batch.num_rows
        return total

    distinct = written(bags.select("h", "b", "n").where("length(b) > 0").dropDuplicates(["h"]).select("b", "n"))
    df = _added(distinct.select("b"), count, BUCKETS + 1)
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS]))
    c = _kmeans(distinct, idf, topics) if df[BUCKETS] else []
    return (c * idf).T.astype(np.float32) if len(c) else np.zeros((BUCKETS, 1), np.float32)


def _topics(b: np.ndarray, n: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The name of each bag's topic."""
    best = np.stack([row_sums(n * c[b], starts) for c in w.T], 1)
    return np.where((best != 0).any(1), np.array([f"topic {i}" for i in range(w.shape[1])])[best.argmax(1)], NO_TOPIC)


def _featured(docs: DataFrame, wanted: list[str], source_col: str, lang_col: str, text_col: str, topic_col: str | None, topics: int) -> DataFrame:
    """(row struct of the columns wanted, source, lang, topic, tokens) per row of docs; tokens: its words, one at least."""
    arrow_limits(docs.sparkSession)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    inside = wanted.index(text_col) if text_col in wanted and dict(docs.dtypes)[text_col] == "string" else None
    text = F.col(text_col).cast("string").alias("t")
    h = F.xxhash64(text).alias("h")
    cols = [F.struct(*(F.col(f"`{c}`") for c in wanted)).alias("row"), key(source_col).alias("source"), key(lang_col).alias("lang")]
    row = docs.select(cols[0]).schema["row"]
    schema = T.StructType([row, *(T.StructField(d, T.StringType()) for d in DIMS), T.StructField("tokens", T.LongType())])
    names = ["row", *DIMS, "tokens"]
    if topic_col is None and inside is None:
        ensure_checkpoint_dir(docs.sparkSession)
        # texts are read once: bags serve the fit and the topics
        bags = _bagged(docs.select(*cols, h, text)).checkpoint()
        fitted = docs.sparkSession.sparkContext.broadcast(fitted_topics(bags, topics))

        def named(batches):
            for batch in batches:
                found = [_topics(*bag, fitted.value) for bag in _unpacked(batch.column(4), batch.column(5))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate(found) if found else [], pa.string()), batch.column(3)], names)
            give_back()

        return bags.drop("h").mapInArrow(named, schema)

    weights = docs.sparkSession.sparkContext.broadcast(None if topic_col else fitted_topics(_bagged(docs.select(h, text)), topics))
    cols += [key(topic_col).alias("topic")] if topic_col else []
    cols += [text] if inside is None else []

    def run(batches):
        w = weights.value
        for batch in batches:
            col = as_strings(batch.column(0).field(inside) if inside is not None else batch.column(batch.num_columns - 1))
            found, counts = [], []
            for a, b in spans(col, 1 << 20):
                words = Words(col[a:b])
                counts.append(np.maximum(words.per_row, 1))
                if w is not None:
                    found.append(_topics(*_bags(words), w))
            topic = batch.column(3) if w is None else pa.array(np.concatenate(found) if found else [], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], topic, pa.array(np.concatenate(counts) if counts else [], pa.int64())], names)
        give_back()

    return docs.select(*cols).mapInArrow(run, schema)


# ---------------------------------------------------------------- raking


def _aims(sums: dict[str, float], given: dict[str, float] | None, temperature: float) -> dict[str, float]:
    """Target shares of the groups that are there; where given ones are zero for all of them, the present shares."""
    aim = {k: float(given.get(k, 0.0)) for k in sums} if given else {k: v**temperature for k, v in sums.items()}
    whole = sum(aim.values())
    return {k: v / whole for k, v in aim.items()} if whole else {k: v / sum(sums.values()) for k, v in sums.items()}


def _sources(cells: DataFrame, given: dict[str, float] | None, temperature: float, langs: dict[str, int], topics: dict[str, int]) -> DataFrame:
    """(source, target, cells array<(l, t, n)>) written once; a source has at most languages x topics cells."""
    spark = cells.sparkSession
    codes = lambda name, known: F.broadcast(spark.createDataFrame(list(known.items()) or [("", 0)], f"{name} string, {name[0]} int"))
    coded = cells.join(codes("lang", langs), "lang").join(codes("topic", topics), "topic")
    rows = coded.groupBy("source").agg(F.sum("n").alias("m"), F.collect_list(F.struct("l", "t", "n")).alias("cells"))
    if given:
        told = spark.createDataFrame([(k, float(v)) for k, v in given.items()], "source string, aim double")
        rows = rows.join(told, "source", "left").withColumn("aim", F.coalesce("aim", F.lit(0.0)))
    else:
        rows = rows.withColumn("aim", F.pow("m", F.lit(temperature)))
    rows = written(rows)
    whole, total = rows.agg(F.sum("aim"), F.sum("m")).first()
    return rows.select("source", "cells", (F.col("aim") / F.lit(whole) if whole else F.col("m") / F.lit(total)).alias("target"))


def _with_factors(sources: DataFrame, b: np.ndarray, c: np.ndarray) -> DataFrame:
    """sources with b and c as arrays, and a: the factor with which a source's cells add up to its target."""
    # JSON of constants is folded into one literal, however long
    told = {n: F.from_json(F.lit(json.dumps(np.nan_to_num(v).tolist())), "array<double>") for n, v in (("b", b), ("c", c))}
    s = F.aggregate("cells", F.lit(0.0), lambda acc, x: acc + x["n"] * F.col("b")[x["l"]] * F.col("c")[x["t"]])
    return sources.withColumns(told).withColumn("s", s).withColumn("a", F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(0.0))


def rake(sources: DataFrame, lang_target: np.ndarray, topic_target: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """b and c with which the weights' sums over each dimension match its targets as nearly as the cells allow."""
    b, c = np.ones(len(lang_target)), np.ones(len(topic_target))
    best, since = np.inf, 0
    for _ in range(rounds):
        sums = _with_factors(sources, b, c).select("a", F.explode("cells").alias("x")).groupBy("x.l", "x.t").agg(F.sum(F.col("a") * F.col("x.n")).alias("w")).collect()
        m = np.zeros((len(b), len(c)))
        for r in sums:
            m[r["l"], r["t"]] = r["w"]
        now = m * b[:, None] * c
        off = max(np.abs(now.sum(1) - lang_target).max(), np.abs(now.sum(0) - topic_target).max())
        best, since = (off, 0) if off < 0.999 * best else (best, since + 1)
        if off < tolerance or since >= PATIENCE:
            break
        for _ in range(INNER_ROUNDS):
            for target, sums_of, axis in ((lang_target, b, 1), (topic_target, c, 0)):
                have = (m * b[:, None] * c).sum(axis)
                sums_of *= np.divide(target, have, out=np.ones_like(have), where=have > 0)
    return b, c


def _rate(sources: DataFrame, keep: float, total: float) -> float:
    """The rate with which min(1, rate * weight per token) keeps the wanted share of all tokens."""
    each = sources.select(F.explode(F.transform("cells", lambda x: F.struct(x["n"].alias("n"), (F.col("a") * F.col("b")[x["l"]] * F.col("c")[x["t"]]).alias("w")))).alias("x")).select("x.*")
    rate, n_full = 0.0, -1
    while True:
        over = F.col("w") * F.lit(rate) > 1
        got = each.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("n") * F.col("w")))).first()
        if got[0] <= n_full:
            return rate
        # full cells stay full, and the others' rate is worked out anew until no more get full
        n_full, rate = got[0], max(rate, (keep * total - float(got[1] or 0)) / got[2]) if got[2] else sys.float_info.max


def _mixed(featured: DataFrame, targets: dict[str, dict[str, float]] | None, keep: float, temperature: float) -> DataFrame:
    """featured with w (the raked weight of a token of the row's cell) and p (its probability)."""
    spark = featured.sparkSession
    cells = written(featured.groupBy(*DIMS).agg(F.sum("tokens").cast("double").alias("n")))
    sums = {}
    for d in ("lang", "topic"):
        got = cells.groupBy(d).agg(F.sum("n").alias("n")).orderBy(d).limit(MAX_PAIRS + 1).collect()
        sums[d] = {r[d]: r["n"] for r in got}
    if len(sums["lang"]) * len(sums["topic"]) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of a language and a topic")
    if not sums["lang"]:
        return featured.withColumns({"w": F.lit(0.0), "p": F.lit(0.0)})
    codes = {d: {k: i for i, k in enumerate(sums[d])} for d in sums}
    given = targets or {}
    aims = {d: np.array(list(_aims(sums[d], given.get(d), temperature).values())) for d in sums}
    sources = _sources(cells, given.get("source"), temperature, codes["lang"], codes["topic"])
    b, c = rake(sources, aims["lang"], aims["topic"])
    rated = _with_factors(sources, b, c)
    total = sum(sums["lang"].values())
    rate = _rate(rated, keep, total)
    # a row per source, left to Spark's size check; the others are as bounded as what the driver holds
    rows = featured.join(written(rated.select("source", "a")), "source")
    for d, values in (("lang", b), ("topic", c)):
        rows = rows.join(F.broadcast(spark.createDataFrame([(k, float(values[i])) for k, i in codes[d].items()], f"{d} string, {d}_factor double")), d)
    w = F.col("a") * F.col("lang_factor") * F.col("topic_factor")
    # sums come in any order: rounding keeps a rerun's draws the same
    return rows.select("row", *DIMS, "tokens", w.alias("w"), F.round(F.least(F.lit(1.0), w * F.lit(rate)), 9).alias("p"))


def _drawn(id_: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit(seed), id_), F.lit(1 << 30)) / F.lit(float(1 << 30))


ADDED = ("__topic", "__tokens", "__probability", "__kept")


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, topics: int = TOPICS, columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs with its columns (or those named) and __topic, __tokens, __probability, __kept (columns of docs with these names are left out).

    Where the text is not among them, texts are read once and what is counted of them is checkpointed; else they are read for the
    cells and again for the rows. targets: shares per dimension (source, lang, topic); without, the present shares are tempered.
    Groups missing from given targets get none; targets of absent groups don't count; where no group that is there has a
    target, the present shares stay. Targets that no weights can meet are met as nearly as raking gets. Null sources
    and languages (and given topics) form a group of their own (''); null, empty and blank texts have the topic 'none' and one token;
    equal ids are drawn alike; an empty table stays empty.
    """
    wanted = [c for c in columns or docs.columns if c.lower() not in ADDED]
    asked = wanted if id_col in wanted else [id_col, *wanted]
    featured = _featured(docs, asked, source_col, lang_col, text_col, topic_col, topics)
    if text_col not in asked:
        ensure_checkpoint_dir(docs.sparkSession)
        featured = featured.checkpoint()
    rows = _mixed(featured, targets, keep, temperature)
    cols = [F.col("row")[c].alias(c) for c in wanted]
    return rows.select(*cols, F.col("topic").alias("__topic"), F.col("tokens").alias("__tokens"), F.col("p").alias("__probability"), (_drawn(F.col("row")[id_col], seed) < F.col("p")).alias("__kept"))


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, temperature: float = TEMPERATURE, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, topics: int = TOPICS) -> DataFrame:
    """The rows of docs that the mix draws, with all their columns, whatever their names; other cases as in mixture()."""
    rows = _mixed(_featured(docs, docs.columns, source_col, lang_col, text_col, topic_col, topics), targets, keep, temperature)
    return rows.where(_drawn(F.col("row")[id_col], seed) < F.col("p")).select(*(F.col("row")[c].alias(c) for c in docs.columns))
