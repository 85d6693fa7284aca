"""Best-fit packing by the sum-of-squares rule.

Documents are tokenised where they are read; only piece lengths are shuffled. Pieces are dealt to shards by a
hash of their document, so a hot source or a group of copies spreads evenly, and every shard is packed on its
own: a document goes to the open sequence (or a new one) for which the sum over residual gaps of the squared
number of open sequences becomes smallest. A shard takes its pieces longest first, so the short ones fill what is left.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, arrow_limits, as_strings, give_back, ragged, row_sums, spans

CAPACITY = 4096
END_ID = 1
#: Documents in a shard; a shard wastes a few sequences at most, whatever the number of shards.
SHARD_ROWS = 40_000
#: Distinct words whose ids a Python worker keeps.
CACHE_WORDS = 1_200_000

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of texts under a tokenizer that never joins across ASCII white space; ids of seen words are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        # words by the sorted 64-bit hashes of their bytes: a few bytes each, where a dictionary takes hundreds
        self.keys = np.zeros(0, np.uint64)
        self.number = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)

    def learn(self, words: list[bytes], keys: np.ndarray) -> None:
        encode = self.tokenizer.encode
        got = [encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.number = np.insert(self.number, place, len(self.starts) - 1 + order)
        self.keys = np.insert(self.keys, place, keys[order])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in got], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), self.ids.dtype)])

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each distinct word; new ones are learned."""
        from xxhash import xxh3_64_intdigest

        keys = np.fromiter((xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        if len(self.keys) + len(words) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self.learn([words[i] for i in new.tolist()], keys[new])
            at = np.searchsorted(self.keys, keys)
        return self.number[at]

    def rows(self, col: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other as uint32, and where each row starts."""
        # lower-casing first is what the normaliser does anyway, except within special strings; letters and marks are
        # tokenised apart anyway, and cutting there leaves fewer distinct words (a final sigma looks across marks, though)
        raw = memoryview(col.buffers()[2] or b"").tobytes()
        plain = b"<|" not in raw
        words = Words(col, lower=plain, cut_marks=plain and b"\xce\xa3" not in raw)
        index, distinct = words.encoded()
        at = self.numbers(distinct.to_pylist())
        first, count = self.starts[at], np.diff(self.starts)[at] if len(at) else at
        lengths = count[index]
        per_row = row_sums(lengths, words.row_starts())
        flat = self.ids[ragged(first[index], lengths)]
        if end_id is None:
            return flat.astype(np.uint32), np.concatenate([[0], np.cumsum(per_row)])
        starts = np.concatenate([[0], np.cumsum(per_row + 1)])
        out = np.full(starts[-1], end_id, np.uint32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(per_row)), per_row)] = flat
        return out, starts


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece of 1 to capacity tokens; ties go to the smallest gap, then to the newest sequence."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences per residual gap; a full one (gap 0) is closed
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, far = 0, np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gap = 0
        if s < capacity:
            here = gaps[s:capacity]
            change = 2 * (gaps[: capacity - s] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = far
            best = int(change.argmin())
            if change[best] <= 2 * gaps[capacity - s] + 1:
                gap = best + s
        if gap:
            b = open_at[gap].pop()
            gaps[gap] -= 1
        else:
            b, gap, made = made, capacity, made + 1
        sequence[i], offset[i] = b, capacity - gap
        if gap > s:
            open_at[gap - s].append(b)
            gaps[gap - s] += 1
    return sequence, offset


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if keep_ids, the ids themselves."""
    arrow_limits(docs.sparkSession)

    def pieces(batches):
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        encoder = _encoders[tokenizer]
        for batch in batches:
            col, ids = as_strings(batch.column(1)), batch.column(0).to_pylist()
            for a, b in spans(col, 2 << 20):
                flat, starts = encoder.rows(col[a:b], end_id)
                rows: list[tuple] = []
                raw = memoryview(flat)
                for k, (lo, hi) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    for piece, at in enumerate(range(lo, hi, capacity)):
                        to = min(at + capacity, hi)
                        rows.append((ids[a + k], piece, at - lo, to - at, zlib.crc32(raw[at:to]), flat[at:to].tolist() if keep_ids else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                arrays = [pa.array(c, t) for c, t in zip(cols, (batch.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + keep_ids], ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
        give_back()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * keep_ids)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, shard_rows: int = SHARD_ROWS, keep_ids: bool = False) -> DataFrame:
    """Pack tokenised documents into sequences of at most capacity tokens.

    Returns one row per piece: id, piece, start, length, ids_crc32 [, ids], sequence_id, offset. Only documents
    of more than capacity tokens are cut; offsets in a sequence leave no gap. Null and empty texts hold the end id
    alone (without an end id: no piece). Repeated rows are packed as rows of their own; a null id is kept.
    An empty table gives no rows; other columns are ignored.
    """
    shards = max(1, math.ceil(docs.select(F.count(F.lit(1))).first()[0] / shard_rows))
    pieces = tokenised_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keep_ids)
    # equal pieces are counted first and numbered, so that copies of one row, however many, spread over the shards
    same = ["id", "piece", "start", "length", "ids_crc32"]
    counted = pieces.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), *([F.first("ids").alias("ids")] if keep_ids else []))
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    dealt = copies.withColumn("shard", F.pmod(F.xxhash64("id", "ids_crc32", "length", "copy"), F.lit(shards)).cast("int")).drop("copy")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        shard = table["shard"][0].as_py()
        out = table.drop_columns(["shard"])
        return out.append_column("sequence_id", pa.array(sequence + (shard << 32), pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(pack, schema)
