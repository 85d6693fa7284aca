"""Byte-level BPE over two tiers.

A text is cut by a pattern into pre-tokens. Each distinct one of a run is first looked up whole in a minimal perfect hash
of the vocabulary: one displacement and one slot, whose token is compared byte by byte, for a whole column at once. Only
those that are no token are merged: their bytes are a linked list, a heap holds the ranks of neighbours, and the
lowest rank, leftmost first, is joined until no neighbours are a token. Decoding takes the tokens' bytes by id.

Nothing is shuffled: rows are encoded where they are read. A text is taken in runs of pre-tokens, so that memory is
bounded by the run and by a text's longest pre-token, not by the text.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import arrow_limits, as_strings, free_name, give_back, ragged, spans

#: Pre-tokens encoded at once.
RUN = 400_000
#: Merged pre-tokens in each of the two generations that a Python worker keeps, and the longest that it keeps.
CACHE, CACHED_BYTES = 300_000, 64
#: Largest file of ranks that is read and broadcast.
MAX_FILE_BYTES = 64 << 20
_ODD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd 64-bit multipliers
_MASK = (1 << 64) - 1


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: n keys onto the slots 0 to n - 1.

    Keys fall into n buckets. Buckets of several keys, largest first, take the first displacement that sends all of them to free slots; buckets of one
    key then name a slot that is left. For other strings the slot is arbitrary, so the caller compares.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.seed, hashed = 0, _hashes(keys, 0)
        while len(np.unique(hashed)) < n:
            self.seed += 1
            if self.seed > 8:
                raise ValueError("keys are not distinct")
            hashed = _hashes(keys, self.seed)
        self.size, self.displaced = n, np.zeros(max(1, n), np.int64)
        buckets: dict[int, list[int]] = {}
        for h in hashed.tolist():
            buckets.setdefault(h % n, []).append(h)
        free = bytearray(b"\x01") * n
        for b, inside in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(inside) == 1:
                break
            d = 0
            while True:
                at = {self._slot(h, d) for h in inside}
                if len(at) == len(inside) and all(free[s] for s in at):
                    break
                d += 1
            for s in at:
                free[s] = 0
            self.displaced[b] = d
        left = iter([s for s in range(n) if free[s]])
        for b, inside in sorted(buckets.items()):
            if len(inside) == 1:
                self.displaced[b] = -1 - next(left)

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * _ODD & _MASK)) * _MIX) & _MASK) >> 32) % self.size

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key."""
        h = _hashes(keys, self.seed)
        if not self.size:
            return np.zeros(len(keys), np.int64)
        d = self.displaced[(h % np.uint64(self.size)).astype(np.int64)]
        moved = (((h ^ (np.maximum(d, 0).astype(np.uint64) * np.uint64(_ODD))) * np.uint64(_MIX)) >> np.uint64(32)) % np.uint64(self.size)
        return np.where(d < 0, -1 - d, moved.astype(np.int64))


def merged(piece: bytes, ranks: dict[bytes, int], two: list[int], longest: int) -> list[int]:
    """Ids of one pre-token by merging neighbours of its linked bytes, lowest rank first, leftmost of equal ones. two: ranks of all pairs of bytes, or -1."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
    pair.append(-1)
    heapify(heap)
    place = (1 << 40) - 1
    while heap:
        entry = heappop(heap)
        i = entry & place
        if pair[i] != entry >> 40:
            continue  # one of the two was merged since
        j = after[i]
        end = after[i] = after[j]
        pair[i] = pair[j] = -1
        if end < n:
            before[end] = i
            stop = after[end]
            if stop - i <= longest and (r := ranks.get(piece[i:stop])) is not None:
                pair[i] = r
                heappush(heap, r << 40 | i)
        p = before[i]
        if p >= 0:
            pair[p] = -1
            if end - p <= longest and (r := ranks.get(piece[p:end])) is not None:
                pair[p] = r
                heappush(heap, r << 40 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Vocabulary:
    """The tokens of a file of ranks (a base64 token and its rank in each line) in the order of the perfect hash, and the pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"ranks of more than {MAX_FILE_BYTES} bytes are not broadcast")
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f) if a]
        self.pattern, self.hash = pattern, PerfectHash([t for t, _ in pairs])
        at = self.hash.slots([t for t, _ in pairs])
        if missing := set(range(256)) - {t[0] for t, _ in pairs if len(t) == 1}:
            raise ValueError(f"{len(missing)} bytes have no token")
        tokens: list[bytes] = [b""] * len(pairs)
        self.ids = np.zeros(len(pairs), np.uint32)
        for s, (token, rank) in zip(at.tolist(), pairs, strict=True):
            tokens[s], self.ids[s] = token, rank
        self.tokens = pa.array(tokens, pa.binary())

    def __getstate__(self):
        return {"pattern": self.pattern, "hash": self.hash, "tokens": self.tokens, "ids": self.ids}

    def _ready(self) -> None:
        """What a worker makes for itself once."""
        import regex

        self.finder = regex.compile(self.pattern)
        tokens = self.tokens.to_pylist()
        self.ranks = dict(zip(tokens, self.ids.tolist(), strict=True))
        self.longest = max(map(len, tokens))
        self.two = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        place = np.full(int(self.ids.max()) + 2, len(tokens), np.int64)  # of ids without a token: a null
        place[self.ids] = np.arange(len(tokens))
        self.place = place

    def _merged(self, piece: bytes) -> bytes:
        """Ids of a pre-token that is no token, as unsigned 32-bit integers."""
        got = self.kept.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                got = array("I", merged(piece, self.ranks, self.two, self.longest)).tobytes()
            if len(piece) <= CACHED_BYTES:
                if len(self.kept) >= CACHE:  # those not seen for a generation go
                    self.older, self.kept = self.kept, {}
                self.kept[piece] = got
        return got

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, ids per pre-token)."""
        if not hasattr(self, "ranks"):
            self._ready()
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        index, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
        each = distinct.to_pylist()
        slot = self.hash.slots(each)
        whole = pc.equal(self.tokens.take(pa.array(slot)), distinct).to_numpy(zero_copy_only=False)
        count = np.ones(len(each), np.int64)
        missed = np.flatnonzero(~whole)
        parts = [self._merged(each[i]) for i in missed.tolist()]
        count[missed] = [len(p) >> 2 for p in parts]
        first = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), np.uint32)
        flat[first[whole]] = self.ids[slot[whole]]
        if parts:
            flat[ragged(first[missed], count[missed])] = np.frombuffer(b"".join(parts), np.uint32)
        return flat[ragged(first[index], count[index])], count[index]

    def runs(self, texts: list[str]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
        """([(row, ids)], ids) of at most some RUN pre-tokens; a row's ids may go on in the next run."""
        if not hasattr(self, "ranks"):
            self._ready()
        pieces: list[str] = []
        rows: list[tuple[int, int]] = []

        def flushed():
            flat, per_piece = self.encode_pieces(pieces)
            ends = np.cumsum(per_piece)
            told, a, at = [], 0, 0
            for row, n in rows:
                a += n
                to = int(ends[a - 1]) if a else 0
                told.append((row, to - at))
                at = to
            return told, flat

        for row, text in enumerate(texts):
            found = self.finder.findall(text) if len(text) <= RUN else None
            if found is not None:
                pieces += found
                rows.append((row, len(found)))
            else:
                matches = self.finder.finditer(text)
                while part := [m[0] for m in islice(matches, RUN)]:
                    pieces += part
                    rows.append((row, len(part)))
                    if len(pieces) >= RUN:
                        yield flushed()
                        pieces, rows = [], []
            if len(pieces) >= RUN:
                yield flushed()
                pieces, rows = [], []
        if rows:
            yield flushed()

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids one after the other, and where each id's begin and end; an id without a token is an error."""
        if not hasattr(self, "ranks"):
            self._ready()
        ids = np.asarray(ids, np.int64)
        at = self.place[np.clip(ids, -1, len(self.place) - 1)]
        if len(ids) and (ids.min() < 0 or at.max() >= len(self.tokens)):
            raise ValueError("an id has no token")
        taken = self.tokens.take(pa.array(at))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
        return memoryview(taken.buffers()[2] or b""), offsets


def _shared(rows: DataFrame, ranks: str, pattern: str):
    arrow_limits(rows.sparkSession)
    return rows.sparkSession.sparkContext.broadcast(Vocabulary(ranks, pattern))


def _with_column(rows: DataFrame, col: str, out_col: str, kind: str, values) -> DataFrame:
    """rows with out_col, made of the column col by values(array): a list or array of the same length."""
    held = free_name(rows, "given")
    kept = [c for c in rows.columns if c.lower() != out_col.lower()]
    given = rows.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{col}`").alias(held))

    def run(batches):
        for batch in batches:
            new = values(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], new], [*kept, out_col])
        give_back()

    return given.mapInArrow(run, given.drop(held).withColumn(out_col, F.lit(None).cast(kind)).schema)


def encoded(rows: DataFrame, ranks: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """rows with out_col: array<bigint> of the text's ids. Null and empty texts have no ids; strings of special tokens are ordinary text; no other column changes, but one named out_col gives way."""
    shared = _shared(rows, ranks, pattern)

    def values(col: pa.Array) -> pa.Array:
        texts = as_strings(col).to_pylist()
        lengths, parts = np.zeros(len(texts), np.int64), []
        for told, flat in shared.value.runs(texts):
            parts.append(flat)
            for row, n in told:
                lengths[row] += n
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat.astype(np.int64)))

    return _with_column(rows, text_col, out_col, "array<bigint>", values)


def decoded(rows: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with out_col: binary, the bytes of the ids' tokens. Null and empty lists give no bytes; an id without a token, or a null one, is an error."""
    shared = _shared(rows, ranks, pattern)

    def values(col: pa.Array) -> pa.Array:
        lists = [x or [] for x in col.to_pylist()]
        flat = [-1 if i is None else i for x in lists for i in x]
        raw, offsets = shared.value.decode(np.array(flat, np.int64))
        ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
        return pa.array([bytes(raw[offsets[b - len(x)] : offsets[b]]) for x, b in zip(lists, ends.tolist(), strict=True)], pa.binary())

    return _with_column(rows, ids_col, out_col, "binary", values)


def round_trips(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: digests of the ids (little-endian unsigned 32-bit) and of the bytes that they decode to.

    Null texts count as empty, whose digests are those of no bytes. Each row stands for itself: repeated rows and null ids are kept. An empty
    table gives no rows; other columns are ignored.
    """
    shared = _shared(docs, ranks, pattern)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            col = as_strings(batch.column(1))
            for a, b in spans(col):
                n = [0] * (b - a)
                coded, back = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
                for told, flat in shared.value.runs(col[a:b].to_pylist()):
                    raw, offsets = shared.value.decode(flat)
                    ids, at = memoryview(flat.astype("<u4")).cast("B"), 0
                    for row, size in told:
                        n[row] += size
                        coded[row].update(ids[4 * at : 4 * (at + size)])
                        back[row].update(raw[offsets[at] : offsets[at + size]])
                        at += size
                out = [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in coded]), pa.array([h.hexdigest() for h in back])]
                yield pa.RecordBatch.from_arrays(out, ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
