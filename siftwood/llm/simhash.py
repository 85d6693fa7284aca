"""SimHash near-duplicates, joined by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments. A segment is read as a word of the perfect binary Golay code
(23 bits, 4096 codewords, every word within 3 errors of exactly one): its keys are the codewords that it and its
one-bit neighbours decode to, six at most, and two segments that differ in up to two bits share one. Of four or fewer
differing bits in three segments, two segments have at most two each (pigeonhole), so a shared pair of keys of
two segments finds every link; candidates are then verified on the whole fingerprint. Equal fingerprints are one
node from the start. Inside a bucket, links are followed from a frontier to what is not yet reached and only a spanning
star is emitted, never all pairs.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import EDGE_SCHEMA, connected_components, forest
from .textkit import Words, arrow_limits, as_strings, ensure_checkpoint_dir, free_name, give_back, row_sums, spans

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: (first bit, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys that one task joins.
TASK_KEYS = 1_000_000
_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23, 12) Golay code


def fingerprints_of(col: pa.Array, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """SimHash of every row as uint64."""
    from xxhash import xxh64_intdigest

    words = Words(col)
    joined, starts = words.joined()
    per_row, first = words.per_row, words.row_starts()[:-1]
    shingles = np.where(per_row == 0, 0, np.maximum(per_row - shingle_words + 1, 1))
    at = np.arange(int(shingles.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(shingles)[:-1]]).astype(np.int64), shingles)
    to = at + np.repeat(np.minimum(per_row, shingle_words), shingles)
    raw = memoryview(joined)
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(starts[at].tolist(), (starts[to] - 1).tolist(), strict=True)), np.uint64, len(at))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    ones = np.zeros((len(per_row), 64), np.int64)
    row = 0
    while row < len(per_row):  # some rows at a time: one bit takes a byte here
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + 200_000, "right")) - 1)
        bits = np.unpackbits(hashes[bounds[row] : bounds[end]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[row:end] = row_sums(bits, bounds[row : end + 1] - bounds[row])
        row = end
    packed = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
    return packed.view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long) per row; fp holds the 64 bits as a signed number."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for batch in batches:
            col = as_strings(batch.column(1))
            fps = [fingerprints_of(col[a:b], shingle_words) for a, b in spans(col, 1 << 20)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps).view(np.int64) if fps else [], pa.int64())], ["id", "fp"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high and the low 12 bits of a word, and the error of each syndrome."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= _GENERATOR << (bit - 11)
        return v

    low = np.array([syndrome(v) for v in range(1 << 12)], np.int32)
    high = np.array([syndrome(v << 12) for v in range(1 << 11)], np.int32)
    errors = np.zeros(1 << 11, np.int32)
    single = [1 << i for i in range(23)]
    for i in range(23):
        for e in [single[i], *(single[i] | single[j] for j in range(i)), *(single[i] | single[j] | single[k] for j in range(i) for k in range(j))]:
            errors[syndrome(e)] = e
    return high, low, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    high, low, errors = _tables()
    return (words ^ errors[high[words >> 12] ^ low[words & 4095]]) >> 11


def segment_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """The distinct codeword indices around each word in six columns; -1: none."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(words.dtype)
    keys = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    place = np.cumsum(fresh, axis=1) - 1
    out = np.full((len(words), 6), -1, np.int64)
    rows, cols = np.nonzero(fresh)
    out[rows, place[rows, cols]] = keys[rows, cols]
    return out


def pair_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all pair keys of uint64 fingerprints; a key names the two segments and a codeword of each."""
    parts = [segment_keys(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32), n) for at, n in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        both = (pair << 24) + (parts[i][:, :, None] << 12) + parts[j][:, None, :]
        row, x, y = np.nonzero((parts[i] >= 0)[:, :, None] & (parts[j] >= 0)[:, None, :])
        rows.append(row)
        keys.append(both[row, x, y])
    return np.concatenate(rows), np.concatenate(keys)


def links_in_bucket(fps: np.ndarray, ids: np.ndarray, bits: int = MAX_BITS, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links of one bucket join, found from a frontier to what is not yet reached."""
    a, b = [], []
    left = np.arange(len(fps))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            some, frontier = frontier[:block], frontier[block:]
            near = np.bitwise_count(fps[some][:, None] ^ fps[left][None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                a.append(ids[left[hit]])
                b.append(ids[some[near[:, hit].argmax(axis=0)]])
                frontier = np.concatenate([frontier, left[hit]])
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def links(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges for the verified links among rows that share a key."""
    order = np.argsort(keys, kind="stable")
    keys, fps, ids = keys[order], fps[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    a, b = [], []
    small = np.repeat((sizes > 1) & (sizes <= 24), sizes)
    keys_s, fps_s, ids_s = keys[small], fps[small], ids[small]
    for d in range(1, 24):
        if len(keys_s) <= d:
            break
        near = (keys_s[d:] == keys_s[:-d]) & (np.bitwise_count(fps_s[d:] ^ fps_s[:-d]) <= bits)
        a.append(ids_s[d:][near])
        b.append(ids_s[:-d][near])
    for at, n in zip(starts[sizes > 24].tolist(), sizes[sizes > 24].tolist(), strict=True):
        x, y = links_in_bucket(fps[at : at + n], ids[at : at + n], bits)
        a.append(x)
        b.append(y)
    return forest(np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp long, component_id) per row: the smallest id reachable over links of at most 4 differing bits.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts of fewer words than a
    shingle count as one shingle. Rows with equal ids share the smallest id of all they reach. An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    fps = fingerprints(docs, id_col, text_col, shingle_words).checkpoint()
    nodes = fps.groupBy("fp").agg(F.min("id").alias("rep")).checkpoint()
    tasks = max(1, math.ceil(nodes.count() * 84 / TASK_KEYS))

    def spread(batches):
        for batch in batches:
            fp, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(fp), 10_000):
                row, key = pair_keys(fp[at : at + 10_000])
                task = ((key * 0x9E3779B1) >> 7) % tasks
                order = np.argsort(task, kind="stable")
                row, key, task = row[order] + at, key[order].astype(np.uint32), task[order]
                cuts = np.searchsorted(task, np.arange(tasks + 1))
                out = [(t, key[i:j].tobytes(), fp[row[i:j]].tobytes(), rep[row[i:j]].tobytes()) for t, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["task", "keys", "fps", "reps"])

    def join(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", np.uint32), ("fps", np.uint64), ("reps", np.int64))]
        a, b = links(*parts)
        del parts
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    edges = nodes.where("rep is not null").mapInArrow(spread, "task int, keys binary, fps binary, reps binary").groupBy("task").applyInArrow(join, EDGE_SCHEMA)
    # an id whose rows have several fingerprints links their classes
    several = fps.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    shared = fps.join(several.select("id"), "id", "left_semi").join(nodes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(edges.unionByName(shared))
    classes = nodes.join(groups, nodes.rep == groups.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp").select("id", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group, with all their columns: those whose id is the smallest of their component.

    Of rows with one id the one with the smallest hash of its values stays (of equal rows, one); rows without an id belong
    to no group and stay. Null, empty and blank texts are one group. An empty table stays empty.
    """
    name, n = free_name(docs, "kept"), free_name(docs, "rows")
    ids = near_duplicates(docs, id_col, text_col).where("id = component_id").groupBy(F.col("id").alias(name)).agg(F.count(F.lit(1)).alias(n)).checkpoint()
    of = lambda some: docs.join(some, F.col(id_col).cast("long") == F.col(name), "left_semi")
    if not ids.where(F.col(n) > 1).limit(1).count():
        return of(ids).unionByName(docs.where(F.col(id_col).isNull()))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = of(ids.where(F.col(n) > 1)).groupBy(F.col(id_col).alias("id")).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return of(ids.where(F.col(n) == 1)).unionByName(first.select(*(F.col("row")[c].alias(c) for c in docs.columns))).unionByName(docs.where(F.col(id_col).isNull()))
