"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

A vector has one home cell and visits every cell in which a vector of the wanted cosine could live: for unit vectors
at most d apart, the home of the other can be cell c only if x . (c0 - c) <= d * |c0 - c|. So no link is lost at a
border. Rows are compared only with home rows of the same label and cell, in blocks of bounded size, however full a cell is.
The number of cells follows the rows up to one cell to 8 rows of the fitted sample (8,192 cells); beyond that cells fill up and are
compared block by block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, forest
from .textkit import ensure_checkpoint_dir, free_name
from .vectors import bounded_sample, cosine, dimensions, matrix, one_per_id, spherical_kmeans, unit, usable

#: Vectors that the centroids are fitted on (every vector is placed), and bytes of them at most.
SAMPLE, SAMPLE_BYTES = 65_536, 128 << 20
#: Rows of one label that a cell should have.
CELL_ROWS = 1000
#: Bytes of double precision vectors on either side of a comparison.
BLOCK_BYTES = 4 << 20


def _star(links: np.ndarray, x_ids: np.ndarray, y_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of a block's links; labels spread over the matrix, so a dense block is never listed pair by pair."""
    xs, ys = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    links = links[np.ix_(xs, ys)]
    lx, ly = x_ids[xs].copy(), y_ids[ys].copy()
    far = np.iinfo(np.int64).max
    while True:
        ny = np.minimum(ly, np.where(links, lx[:, None], far).min(0)) if len(xs) else ly
        nx = np.minimum(lx, np.where(links, ny[None, :], far).min(1)) if len(ys) else lx
        if (nx == lx).all() and (ny == ly).all():
            break
        lx, ly = nx, ny
    return forest(np.concatenate([x_ids[xs], y_ids[ys]]), np.concatenate([lx, ly]))


def near_duplicates(table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) per id: links join vectors of one label with a cosine of threshold or more.

    Null labels, and vectors that are null, zero or hold null or non-finite components link with nothing; vectors of
    each length are compared among themselves. Of rows with one id the first in order (label, then vector) counts; null
    ids go. kept: the smallest id of a component. An empty table gives no rows; other columns are ignored.
    """
    ensure_checkpoint_dir(table.sparkSession)
    named = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    base = one_per_id(named, "id", "vec", "label")
    rows = base.where(F.col("label").isNotNull() & usable("vec")).checkpoint()
    parts = [_links(rows.where(F.size("vec") == dim), dim, threshold, sample) for dim in dimensions(rows) or [0]]
    found = functools.reduce(DataFrame.unionByName, parts).checkpoint()
    groups = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    out = base.select("id").join(counts, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.col("id") == F.col("component_id"))


def _links(rows: DataFrame, dim: int, threshold: float, sample: int) -> DataFrame:
    """(a, n, null): a row's number of links in one block; (a, 0, b): an edge of the links' forest."""
    spark = rows.sparkSession
    labels, n = rows.agg(F.countDistinct("label"), F.count(F.lit(1))).first()
    fitted = bounded_sample(rows, dim, min(sample, SAMPLE_BYTES // (8 * max(1, dim))))[1]
    fitted = unit(fitted) if len(fitted) else fitted
    cells = max(1, min(n // (CELL_ROWS * max(1, labels)), len(fitted) // 8))
    block_rows = max(1, BLOCK_BYTES // (8 * max(1, dim)))
    shared = spark.sparkContext.broadcast(spherical_kmeans(fitted, cells))
    apart = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def placed(batch: pa.RecordBatch):
        """(row, cell, home) of each cell that a row lives in or visits."""
        c = shared.value
        for a in range(0, batch.num_rows, 1000):
            some = batch.slice(a, 1000)
            near = unit(matrix(some.column(1), dim)) @ c.T
            home = near.argmax(1)
            to = np.linalg.norm(c[home][:, None, :] - c[None, :, :], axis=2) if len(c) <= 64 else np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 0)) + 1e-9
            row, cell = np.nonzero(near[np.arange(len(home)), home][:, None] - near <= apart * to + 1e-12)
            yield some, row, cell, home[row] == cell

    def place(batches):
        for batch in batches:
            for some, row, cell, home in placed(batch):
                yield pa.RecordBatch.from_arrays([*(some.column(i).take(pa.array(row)) for i in (0, 1, 2)), pa.array(cell, pa.int32()), pa.array(home)], ["id", "vec", "label", "cell", "home"])

    def tally(batches):
        for batch in batches:
            for some, row, cell, home in placed(batch):
                t = pa.table({"label": some.column(2).take(pa.array(row)), "cell": pa.array(cell, pa.int32()), "home": pa.array(home.astype(np.int64))}).group_by(["label", "cell"]).aggregate([("home", "sum"), ("home", "count")])
                yield from t.select(["label", "cell", "home_sum", "home_count"]).rename_columns(["label", "cell", "homes", "all"]).to_batches()

    kind, vec = dict(rows.dtypes)["label"], dict(rows.dtypes)["vec"]
    rows = rows.select("id", "vec", "label")
    blocks = lambda c: F.ceil(F.sum(c) / block_rows).cast("int")
    sizes = rows.mapInArrow(tally, f"label {kind}, cell int, homes long, all long").groupBy("label", "cell").agg(blocks("homes").alias("by"), blocks("all").alias("bx")).where("by > 0")
    sized = rows.mapInArrow(place, f"id long, vec {vec}, label {kind}, cell int, home boolean").join(sizes, ["label", "cell"])
    # each row asks all blocks of home rows of its cells; a home row is also held for all blocks of asking rows
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asks = F.transform(each("by"), lambda y: F.struct(block("bx").alias("x"), y.alias("y"), F.lit(True).alias("asks")))
    holds = F.transform(each("bx"), lambda x: F.struct(x.alias("x"), block("by").alias("y"), F.lit(False).alias("asks")))
    dealt = sized.select("label", "cell", "id", "vec", F.explode(F.when(F.col("home"), F.concat(asks, holds)).otherwise(asks)).alias("b")).select("label", "cell", "id", "vec", "b.*")

    def compare(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        x_ids, y_ids = (table["id"].to_numpy()[m] for m in (asks, ~asks))
        every = matrix(table["vec"], dim)
        x, y = every[asks], every[~asks]
        xu, yu = unit(x) if len(x) else x, unit(y) if len(y) else y
        n = np.zeros(len(x), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(x) if len(y) else 0, 256):
            near = xu[i : i + 256] @ yu.T
            links = near >= threshold
            # at the threshold itself the plain formula decides
            r, c = np.nonzero(np.abs(near - threshold) < 1e-9)
            links[r, c] = cosine(x[i + r], y[c]) >= threshold
            links &= x_ids[i : i + 256, None] != y_ids[None, :]
            n[i : i + 256] = links.sum(1)
            ends.append(_star(links, x_ids[i : i + 256], y_ids))
        some = n > 0
        a, b = forest(*(np.concatenate(e) for e in zip(*ends, strict=True))) if ends else (x_ids[:0], x_ids[:0])
        none, free = np.zeros(int(some.sum()), bool), np.zeros(len(a), np.int64)
        return pa.table({
            "a": pa.array(np.concatenate([x_ids[some], a]), pa.int64()), "n": pa.array(np.concatenate([n[some], free]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(len(none), np.int64), b]), pa.int64(), mask=np.concatenate([~none, np.zeros(len(a), bool)])),
        })

    return dealt.groupBy("label", "cell", "x", "y").applyInArrow(compare, "a long, n long, b long")


def deduplicated(table: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows that stand for their group, with all their columns: those whose id is the smallest of its component.

    Of an id that stands for its group every row stays; rows without an id belong to no group and stay.
    """
    kept = near_duplicates(table, threshold, id_col, vec_col, label_col).where("kept").select(F.col("id").alias(name := free_name(table, "kept")))
    return table.join(kept, F.col(id_col) == F.col(name), "left_semi").unionByName(table.where(F.col(id_col).isNull()))
