"""Vector helpers of the two embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Neither null nor zero, and no null or non-finite component."""
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vec).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(F.col(vec), lambda x: x != 0)


def one_per_id(table: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(id, more..., vec) with one row per id (of several, the first in order of more, then vec); null ids go. Single precision stays that."""
    kept = F.col(vec_col) if dict(table.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.struct(*(F.col(c) for c in more), kept.alias("vec")).alias("s"))
    return rows.groupBy("id").agg(F.min("s").alias("s")).select("id", "s.*")


def dimensions(rows: DataFrame) -> list[int]:
    """The lengths of vec that occur, the commonest first; a cosine needs two vectors of one length."""
    return [r["d"] for r in rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").collect()]


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not dim:
        return np.zeros((len(col), 0))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, summed in one fixed order, so that equal pairs have equal values."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def bounded_sample(rows: DataFrame, dim: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows with the smallest id hashes; most is the only bound."""
    got = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    return got["id"].to_numpy(), matrix(got["vec"], dim)


def halve(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row sets of at most most rows: each cut in the middle along the direction that separates two far rows."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        some = todo.pop()
        if len(some) <= most:
            done.append(some)
            continue
        part = x[some]
        far = part[(part @ part[0]).argmin()]
        other = part[(part @ far).argmin()]
        order = np.argsort(part @ (far - other), kind="stable")
        todo += [some[order[: len(some) // 2]], some[order[len(some) // 2 :]]]
    return done


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; started from balanced halves of the sample, so no cell starts empty."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    parts = halve(x, max(1, -(-len(x) // max(1, cells))))
    c = np.stack([x[p].mean(0) for p in parts])
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(c)) > 0
        c = np.where(filled[:, None], sums, c)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
