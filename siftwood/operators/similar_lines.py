"""Lines of a list without those similar to an earlier kept one, as a similarity join: lists of any length, no long list in one task.

Lists of a bounded size are gathered, so that each line travels once, and a task joins the lines of many lists; longer ones are joined by Spark, word
by word. Either way lines meet only by a rare word. Two similar lines share all words of the shorter, or three quarters of the longer; so of the shorter's n words, rarest
first, one of the first n - ceil(3n / 4) + 1 is in the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.text import norm_key
from ..shared import small_batches, written
from ..shipping import ship_package
from .profile import similar

SHORTEST = 4  # lines of fewer words are similar to none
MOST = 1 << 15  # characters of a list, with one more a line, that a task may join
PAIRS = 1 << 20  # pairs that a task compares at once, unless one list has more


def similar_pairs(nodes: DataFrame) -> DataFrame:
    """(early, late): pairs of nodes(v, list, at, sig) of one list with similar signatures, the earlier by at first, each once; v is unique.

    Words of a list meet by a 64-bit hash; every pair that met is compared by its words, so a hash of two words costs time and no result. A word of one
    line leads nowhere, and most words are such: they go no further than the count, as a line's number of them says how much of its prefix they fill.
    """
    words = nodes.select("v", F.size("sig").alias("n"), "list", F.explode("sig").alias("word")).select("v", "n", F.xxhash64("list", "word").alias("key"))
    counts = words.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    shared = words.join(counts, "key")
    ranked = shared.groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("words"))
    # unique words are the rarest and come first; of the prefix that is left the shared ones are probed
    room = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1 - (F.col("n") - F.size("words"))
    probes = ranked.select(F.col("v").alias("a"), F.col("n").alias("na"), F.explode(F.slice("words", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("w"))
    probes = probes.select("a", "na", F.col("w.key").alias("key"))
    index = shared.select("key", F.col("v").alias("b"), F.col("n").alias("nb"))
    met = probes.join(index, "key").where("na < nb or (na = nb and a < b)").select("a", "b").distinct()
    side = lambda c: nodes.select(F.col("v").alias(c), F.col("list").alias(f"list_{c}"), F.col("sig").alias(f"sig_{c}"), F.col("at").alias(f"at_{c}"))
    near = met.join(side("a"), "a").join(side("b"), "b").where(F.col("list_a").eqNullSafe(F.col("list_b")) & similar(F.col("sig_a"), F.col("sig_b")))
    first = F.col("at_a") < F.col("at_b")
    return near.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"))


def dropped(pairs: DataFrame) -> DataFrame:
    """(v): nodes that have an earlier neighbour which is kept.

    In a round nodes without an earlier neighbour are kept, their neighbours go, and so do the pairs of those; there are as many rounds as links in
    the longest chain of such decisions.
    """
    pairs = written(pairs)
    gone = []
    while not pairs.isEmpty():
        kept = pairs.select("early").distinct().join(pairs.select(F.col("late").alias("early")), "early", "left_anti")
        out = written(pairs.join(kept, "early", "left_semi").select(F.col("late").alias("v")).distinct())
        gone.append(out)
        pairs = written(pairs.join(out.withColumnRenamed("v", "late"), "late", "left_anti").join(out.withColumnRenamed("v", "early"), "early", "left_anti"))
    found = pairs.select(F.col("late").alias("v"))
    for out in gone:
        found = found.unionByName(out)
    return found


def _words(line: Column) -> Column:
    """Runs of three characters at least, each once and sorted, without the words that say nothing."""
    found = F.regexp_extract_all(norm_key(line), F.lit("[a-z0-9#+]{3,}"), 0)
    return F.sort_array(F.array_except(found, F.array(*(F.lit(x) for x in (*V.TOKEN_STOPWORDS, "proyecto", "linea")))))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _kept(lists: np.ndarray, sig: pa.Array) -> np.ndarray:
    """Whether each line stays; lists: ascending numbers of their lists, sig: their sorted words with a blank between, in order of the lines."""
    kept = pc.greater(pc.binary_length(sig), 0).to_numpy(zero_copy_only=False)
    split = pc.split_pattern(sig, " ")
    n = np.where(kept, np.diff(split.offsets.to_numpy()), 0)
    # of equal lines the first
    alike = lists * (len(sig) + 1) + sig.dictionary_encode().indices.to_numpy()
    first = np.zeros(len(sig), bool)
    first[np.unique(alike, return_index=True)[1]] = True
    kept &= first | (n < SHORTEST)
    nodes = np.flatnonzero(first & (n >= SHORTEST))
    if not len(nodes):
        return kept
    coded = split.flatten().dictionary_encode()
    base, n = split.offsets.to_numpy()[:-1][nodes], n[nodes]
    # words of all nodes, node by node; a key is a word of a list
    v, word = np.repeat(np.arange(len(nodes)), n), coded.indices.to_numpy()[_ranges(base, n)].astype(np.int64)
    width, at = len(coded.dictionary), np.cumsum(n) - n
    has = np.sort(v * width + word)
    _, key, count = np.unique(lists[nodes][v] * width + word, return_inverse=True, return_counts=True)
    order = np.lexsort((key, count[key], v))
    # in v's prefix, rarest first, and shared
    probes = order[(np.arange(len(order)) - at[v] < (n - -(-3 * n // 4) + 1)[v]) & (count[key[order]] > 1)]
    index, start = np.argsort(key, kind="stable"), np.cumsum(count) - count
    cost = np.cumsum(count[key[probes]])
    of, i = lists[nodes][v[probes]], 0
    while i < len(probes):
        # some lists at once, one at least: pairs are of one list, so what is settled of one stays
        j = int(np.searchsorted(cost, (cost[i - 1] if i else 0) + PAIRS, "right"))
        j = max(int(np.searchsorted(of, of[j], "left")), int(np.searchsorted(of, of[i], "right"))) if j < len(probes) else j
        some = probes[i:j]
        a, b = np.repeat(v[some], count[key[some]]), v[index[_ranges(start[key[some]], count[key[some]])]]
        met = np.unique((a * len(nodes) + b)[(n[a] < n[b]) | ((n[a] == n[b]) & (a < b))])
        near = []
        for k in range(0, len(met), PAIRS // 8):
            a, b = np.divmod(met[k : k + PAIRS // 8], len(nodes))
            wanted = np.repeat(b, n[a]) * width + word[_ranges(at[a], n[a])]
            found = has[np.minimum(np.searchsorted(has, wanted), len(has) - 1)] == wanted
            both = np.add.reduceat(found, np.cumsum(n[a]) - n[a], dtype=np.int64)
            ok = (both == n[a]) | ((both >= SHORTEST) & (both * 4 >= n[b] * 3))
            near.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], 1))
        pairs = np.concatenate(near) if near else np.zeros((0, 2), np.int64)
        # by the later line: what is before it is settled
        for early, late in nodes[pairs[np.lexsort((pairs[:, 0], pairs[:, 1]))]].tolist():
            if kept[early]:
                kept[late] = False
        i = j
    return kept


def _gathered(signed: DataFrame) -> DataFrame:
    """(list, at) of signed(list, at) that stay; every list is a row for a task's batches."""
    spark = signed.sparkSession
    ship_package(spark)
    small_batches(spark)
    lists = signed.groupBy("list").agg(F.array_sort(F.array_distinct(F.collect_list("at"))).alias("lines"))
    lists = lists.select("list", "lines", F.transform("lines", lambda x: F.coalesce(F.array_join(_words(x["line"]), " "), F.lit(""))).alias("sig"))

    def run(batches):
        for batch in batches:
            sig, lines = batch.column(2), batch.column(1)
            of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(sig).to_numpy(zero_copy_only=False))
            stay = np.flatnonzero(_kept(of, sig.flatten()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[stay])), lines.flatten().take(pa.array(stay))], ["list", "at"])

    return lists.mapInArrow(run, T.StructType([signed.schema["list"], signed.schema["at"]]))


def distinct_lines(rows: DataFrame, group: str, pos: str, line: str, most: int = MOST) -> DataFrame:
    """(group, pos, line): the lines of each group, in order of pos, without those similar to an earlier one that is kept; lines without words are dropped.

    The same rule as profile.distinct_bullets. Null is a group; lines of one pos are ordered by their text, and equal ones count once; a null line has no
    words. Of lines with the same words (four at least) the first counts, so copies meet nowhere. Other columns are ignored. Lists of at most so many
    characters are joined in tasks; which way a list goes changes no result.
    """
    signed = rows.select(F.col(group).alias("list"), F.struct(F.col(pos).alias("pos"), F.col(line).alias("line")).alias("at"))
    size = F.sum(F.coalesce(F.length("at.line"), F.lit(0)) + 1)
    long = written(signed.groupBy("list").agg(size.alias("size")).where(F.col("size") > most).select(F.col("list").alias("long")))
    if long.isEmpty():
        found = _gathered(signed)
    else:
        same = F.col("list").eqNullSafe(F.col("long"))
        found = _gathered(signed.join(long, same, "left_anti")).unionByName(_joined(signed.join(long, same, "left_semi")))
    return found.select(F.col("list").alias(group), F.col("at.pos").alias(pos), F.col("at.line").alias(line))


def _joined(signed: DataFrame) -> DataFrame:
    """(list, at) of signed(list, at) that stay, by joins of words."""
    signed = signed.withColumn("sig", _words(F.col("at.line")))
    # short lines are told apart by where they are, longer ones by their words
    here = F.when(F.size("sig") < SHORTEST, F.to_json("at"))
    first = signed.groupBy("list", F.md5(F.concat_ws(" ", here, F.array_join("sig", " ")).cast("binary")).alias("key")).agg(F.min("at").alias("at"))
    # words are made anew behind the aggregate: moving them would cost more
    nodes = written(first.drop("key").withColumn("sig", _words(F.col("at.line"))).where(F.size("sig") > 0).withColumn("v", F.monotonically_increasing_id()))
    lost = dropped(similar_pairs(nodes.where(F.size("sig") >= SHORTEST)))
    return nodes.join(lost, "v", "left_anti").select("list", "at")
