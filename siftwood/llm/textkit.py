"""Columnar text primitives shared by the corpus operators.

Everything here works on a whole Arrow column at once: words are found with byte masks, and each distinct
word of a chunk is handed to Python once, so the per-token work stays in numpy and Arrow kernels.
Words are maximal runs of bytes other than ASCII white space; only A-Z are lower-cased.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..shipping import ship_package

#: Text bytes handled at once; bounds the temporaries of a Python worker whatever the row sizes are.
CHUNK_BYTES = 4 << 20


def arrow_limits(spark, rows: int = 2000) -> None:
    """Keep Arrow batches small, for tables in which single rows may be very long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ensure_checkpoint_dir(spark) -> None:
    """Use the folder that spark.checkpoint.dir names; set a local one only where that is unset, as in tests. On a cluster without it this is an error: executors do not see the driver's disk."""
    ship_package(spark)
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "siftwood-checkpoints"))


def written(df):
    """The rows as a table in the shared checkpoint folder. Unlike checkpoint() it keeps no constraints of the plan, which grow from round to round."""
    import uuid

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, as Python workers outlive their tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bounded_rows(rows, most: int, *keys: str):
    """At most so many rows: one of each of the smallest hashes of the keys' values. Equal rows count once; most is the only bound."""
    from pyspark.sql import functions as F

    name = free_name(rows, "hash")
    hashed = rows.withColumn(name, F.xxhash64(*keys))
    cut = hashed.select(name).orderBy(name).limit(most).agg(F.max(name)).first()[0]
    return hashed.where(F.col(name) <= F.lit(cut)).dropDuplicates([name]).drop(name)


def arrow_type(table, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(table.select(column).schema).types[0]


def free_name(table, stem: str) -> str:
    """A column name that table doesn't have, in any case."""
    taken = {c.lower() for c in table.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def read(spark, sf_dir: str, table: str):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_strings(col: pa.Array) -> pa.Array:
    """One string array without nulls (null: empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "")


def spans(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit text bytes, or one row."""
    lengths = pc.binary_length(col).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield start, len(lengths)


class Words:
    """The words of a string column: bytes without white space, their lengths, and the number per row."""

    def __init__(self, col: pa.Array, lower: bool = True, letters_only: bool = False, cut_marks: bool = False):
        """letters_only: ASCII characters other than letters and digits separate words too.

        cut_marks: a word also ends where an ASCII letter meets an ASCII mark other than the apostrophe; the mark starts or ends the next.
        """
        n = len(col)
        buffers = col.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            upper = (data - np.uint8(65)) < 26
            data = data + (upper.astype(np.uint8) << 5)
        blank = (data == 32) | ((data - np.uint8(9)) < 5)
        if letters_only:
            blank = (data < 128) & ((data - np.uint8(48)) >= 10) & (((data | 32) - np.uint8(97)) >= 26)
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = True, blank[:-1]
            after[-1], after[:-1] = True, blank[1:]
            filled = offsets[1:] > offsets[:-1]
            before[offsets[:-1][filled]] = True
            after[offsets[1:][filled] - 1] = True
            if cut_marks:
                letter = ((data | 32) - np.uint8(97)) < 26
                mark = (data < 128) & ~letter & ~blank & ((data - np.uint8(48)) >= 10) & (data != 39)
                cut = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
                before[1:] |= cut
                after[:-1] |= cut
        first = np.flatnonzero(before & ~blank)
        last = np.flatnonzero(after & ~blank)
        self.lengths = last - first + 1
        self.bytes = data[~blank]
        self.per_row = np.diff(np.searchsorted(first, offsets))
        self.n = len(first)

    def row_starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.per_row)])

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """An index per word, and the distinct words as binary."""
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(self.lengths, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.bytes))])
        coded = words.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words followed by one space each, and the start of every word in that buffer."""
        starts = np.zeros(self.n + 1, np.int64)
        np.cumsum(self.lengths + 1, out=starts[1:])
        out = np.full(starts[-1], 32, np.uint8)
        out[np.arange(len(self.bytes)) + np.repeat(np.arange(self.n), self.lengths)] = self.bytes
        return out, starts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every range, one after the other."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else starts
    return np.arange(total) + np.repeat(shift, lengths)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values (along axis 0) between starts[i] and starts[i + 1]; empty ranges give zero."""
    total = np.zeros((len(starts) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    filled = starts[1:] > starts[:-1]
    if filled.any():
        total[filled] = np.add.reduceat(values, starts[:-1][filled], axis=0, dtype=total.dtype)
    return total
