"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ensure_checkpoint_dir

EDGE_SCHEMA = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node reachable) with the same components as the edges given."""
    nodes, coded = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = coded[: len(a)], coded[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop
        if (label == before).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(batches):
    for batch in batches:
        a, b = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star rounds; each round is two aggregations that combine before their
    shuffle and two joins whose hot side Spark may split, so a node with very many neighbours stays spread
    out. The state of a round is written to the checkpoint folder, which cuts the lineage and survives the loss
    of executors. No edges: no rows. Self loops and repeated edges are harmless; null ends are dropped.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = e.mapInArrow(_contract, EDGE_SCHEMA).distinct().checkpoint()
    for _ in range(rounds):
        # done when every child has one parent and no parent is a child itself
        hanging = e.select(F.col("b").alias("a")).distinct().join(e.select("a"), "a", "left_semi").limit(1).count()
        if not hanging and not e.groupBy("a").count().where("count > 1").limit(1).count():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
