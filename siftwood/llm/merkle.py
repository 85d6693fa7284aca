"""Merkle manifest of a dataset, with the authentication path of every row.

Digests are lowercase hexadecimal SHA-256; a node is the digest of its children's texts, one after the other. Within a group the
leaves stand in order, every ARITY consecutive nodes (the last run: fewer, even one) become their parent while several remain,
and the groups' roots, in order of the group, make a tree of their own in the same way.

Groups are cut into aligned blocks of ARITY ** BLOCK_LEVELS leaves, so a tree is built from the bottom by rounds of whole blocks, each of which leaves
one row a block. Paths are then written from the top: a block gets the path of its root and goes through its leaves by fractal
traversal. Of the block's tree only a stack of subtrees of SUBTREE_LEVELS levels is there, the ones over the present leaf, and beside each
the next one at its place, which grows by one leaf whenever the traversal goes on by one. The block's own path is then completed
by the path of its root. A task holds one block's leaf digests and two stacks of subtrees, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import arrow_limits, arrow_type, free_name, written

ARITY = 8
#: Levels of a block's tree: 4,096 leaves.
BLOCK_LEVELS = 4
#: Levels of a subtree of the traversal's stack.
SUBTREE_LEVELS = 2
# The letters that tampering with a text lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Path = list[tuple[str, str]]  # from the bottom: the siblings on the left and on the right, joined


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column | str) -> Column:
    """The digest of a row's values in order: each a dash if null, else its number of UTF-8 bytes, a colon and itself."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    told = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*told).cast("binary"), 256)


class Subtree:
    """The nodes of levels low to high - 1 over leaves given one by one, and the root at level high. Of lower levels only open runs are held."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high
        self.open: list[list[str]] = [[] for _ in range(high + 1)]
        self.nodes: dict[int, list[str]] = {level: [] for level in range(low, high)}

    def add(self, node: str, level: int = 0) -> None:
        while True:
            if level >= self.low and level < self.high:
                self.nodes[level].append(node)
            self.open[level].append(node)
            if level == self.high or len(self.open[level]) < ARITY:
                return
            node = digest(*self.open[level])
            self.open[level].clear()
            level += 1

    def finish(self) -> Subtree:
        """Closes the runs that are not full, at the end of the leaves."""
        for level in range(self.high):
            if run := self.open[level]:
                node = digest(*run)
                run.clear()
                self.add(node, level + 1)
        return self

    def root(self) -> str:
        return self.open[self.high][0]


def levels_of(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def bands(levels: int) -> list[tuple[int, int]]:
    return [(low, min(low + SUBTREE_LEVELS, levels)) for low in range(0, levels, SUBTREE_LEVELS)]


def block_root(leaves: list[str], levels: int) -> str:
    tree = Subtree(levels, levels)
    for node in leaves:
        tree.add(node)
    return tree.finish().root()


def paths(leaves: list[str], levels: int) -> Iterator[Path]:
    """The authentication paths of a block's leaves, one after the other."""
    n, stack = len(leaves), bands(levels)

    def grown(low: int, high: int, start: int, most: int) -> Subtree:
        tree = Subtree(low, high)
        for node in leaves[start : min(start + most, n)]:
            tree.add(node)
        return tree

    spans = [ARITY**high for _, high in stack]
    existing = [grown(low, high, 0, span).finish() for (low, high), span in zip(stack, spans, strict=True)]
    desired = [Subtree(low, high) for low, high in stack]
    for t in range(n):
        path: Path = []
        for (low, high), tree, span in zip(stack, existing, spans, strict=True):
            inside = t % span
            for level in range(low, high):
                at = inside // ARITY**level
                run = at - at % ARITY
                nodes = tree.nodes[level]
                path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + ARITY])))
        yield path
        for k, span in enumerate(spans):
            if t + span < n:  # one leaf more for the next subtree of this place
                desired[k].add(leaves[t + span])
            if (t + 1) % span == 0:
                existing[k] = desired[k].finish()
                desired[k] = Subtree(*stack[k])


def folded(node: str, path: Path) -> str:
    """The root that a leaf and its path give."""
    for left, right in path:
        node = digest(left, node, right)
    return node


def path_text(path: Path) -> str:
    return ",".join(f"{left}:{right}" for left, right in path)


def parsed_path(text: str | None) -> Path:
    return [(left, right) for left, _, right in (level.partition(":") for level in text.split(","))] if text else []


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with __index, from 0 within the group in order, and __n, the group's rows; null groups are one group.

    Rows are dealt by ranges of group and order, so one large group lies in many partitions; counts of each group in each partition give the numbers.
    """
    mid = free_name(rows, "mid")
    dealt = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(mid, 33)
    counts = dealt.groupBy(part.alias("__p"), F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__c"), F.min(mid).alias("__first"))
    of_group = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__c").over(of_group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumns({"__before": before, "__n": F.sum("__c").over(of_group)})
    joined = dealt.join(starts, (part == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    return joined.withColumn("__index", F.col("__before") + F.col(mid) - F.col("__first")).drop(mid, "__p", "__g", "__c", "__first", "__before")


def _blocked(nodes: DataFrame, block_levels: int, above: DataFrame | None = None) -> DataFrame:
    """(g, block, index, n, node, other, path): the rows of a block together, in order, and its path from above, if given, as the row before them."""
    size = ARITY**block_levels
    rows = nodes.select("g", F.floor(F.col("index") / size).cast("long").alias("block"), "index", "n", "node", "other", F.lit(None).cast("string").alias("path"), "row")
    if above is not None:
        told = above.select("g", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "n", F.col("subroot").alias("node"), F.col("root").alias("other"), "path", F.lit(None).cast(dict(nodes.dtypes)["row"]).alias("row"))
        rows = rows.unionByName(told)
    return rows.repartition("g", "block").sortWithinPartitions("g", "block", "index")


def _blocks(batches) -> Iterator[tuple[tuple | None, list[tuple]]]:
    """(row from above, rows) of one block after the other; a block is all that is held."""
    key, above, rows = None, None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield above, rows
                key, above, rows = row[:2], None, []
            if row[2] < 0:
                above = row
            else:
                rows.append(row)
    if rows:
        yield above, rows


def _roots(nodes: DataFrame, block_levels: int) -> DataFrame:
    """The roots of all blocks, as nodes of the next round."""

    def run(batches):
        out = []
        for _, rows in _blocks(batches):
            g, block, n = rows[0][0], rows[0][1], rows[0][3]
            out.append((g, block, -(-n // ARITY**block_levels), block_root([r[4] for r in rows], min(block_levels, levels_of(n)))))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        types = (types_g, pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["g", "index", "n", "node"])

    kind = dict(nodes.dtypes)["g"]
    types_g = arrow_type(nodes, "g")
    found = _blocked(nodes, block_levels).drop("row").mapInArrow(run, f"g {kind}, index long, n long, node string")
    return written(found.withColumns({"other": F.lit(None).cast("string"), "row": F.lit(None).cast("string")}))


def _descended(nodes: DataFrame, above: DataFrame | None, block_levels: int) -> DataFrame:
    """(g, index, n, path, subroot, root) of nodes, whose blocks' roots have the paths of above; without above the block is the whole tree."""

    def run(batches):
        for up, rows in _blocks(batches):
            levels, told = min(block_levels, levels_of(rows[0][3])), parsed_path(up[6] if up else None)
            leaves = [r[4] for r in rows]
            top = block_root(leaves, levels) if up is None else ""
            out = [(r[0], r[2], r[3], path_text(p + told), up[4] if up else None, up[5] if up else top) for r, p in zip(rows, paths(leaves, levels), strict=True)]
            types = (types_g, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["g", "index", "n", "path", "subroot", "root"])

    kind = dict(nodes.dtypes)["g"]
    types_g = arrow_type(nodes, "g")
    return _blocked(nodes, block_levels, above).drop("row").mapInArrow(run, f"g {kind}, index long, n long, path string, subroot string, root string")


def _tree(nodes: DataFrame, block_levels: int) -> list[DataFrame]:
    """nodes, and the nodes of each round above them, up to one node a group."""
    rounds, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rounds.append(_roots(rounds[-1], block_levels))
        most = -(-most // ARITY**block_levels)
    return rounds


def manifest(rows: DataFrame, group: str, order: list[str], leaf_col: str = "leaf", other_col: str | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Each row with its proof: rows' columns, subroot (root of its group), root (of all), path (text: left and right siblings of each level), proof_sha256
    (digest of all siblings, from the bottom, left to right) and folded_root, which other_col (default: the leaf) gives with the path of the leaf.

    rows has leaf_col, digests as text, and order, which must set the order of unlike leaves; equal rows have neighbouring places, each with
    a path of its own. Nulls of group and order come first; null groups are one group. A group of one leaf is its own subroot. An empty table gives no
    rows. Columns named like a new one give way to it; other names do not matter.
    """
    spark = rows.sparkSession
    arrow_limits(spark)
    new = ["subroot", "root", "path", "proof_sha256", "folded_root"]
    kept = [c for c in rows.columns if c.lower() not in new]
    given = rows.select(F.col(f"`{group}`").alias("__group"), *(F.col(f"`{c}`").alias(f"__order{i}") for i, c in enumerate(order)), F.col(f"`{leaf_col}`").alias("__leaf"), F.col(f"`{other_col or leaf_col}`").alias("__other"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"))
    placed = numbered(given, "__group", [f"__order{i}" for i in range(len(order))])
    nodes = written(placed.select(F.col("__group").alias("g"), F.col("__index").alias("index"), F.col("__n").alias("n"), F.col("__leaf").alias("node"), F.col("__other").alias("other"), F.col("__row").alias("row")))
    rounds = _tree(nodes, block_levels)
    # the tree over the groups: one group whose leaves are the groups' roots
    tops = rounds[-1].select(F.lit(0).alias("one"), F.col("g").alias("group"), F.col("node").alias("leaf"))
    placed_tops = written(numbered(tops, "one", ["group"]))
    top_nodes = placed_tops.select(F.col("one").alias("g"), F.col("__index").alias("index"), F.col("__n").alias("n"), F.col("leaf").alias("node"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("row"))
    found = None
    for round_ in reversed(_tree(top_nodes, block_levels)):
        found = _descended(round_, found, block_levels)
    of_groups = placed_tops.join(written(found), F.col("__index") == F.col("index"))
    above = of_groups.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("index"), F.lit(1).cast("long").alias("n"), "path", F.col("leaf").alias("subroot"), "root")
    for round_ in reversed(rounds[1:-1]):
        above = _descended(round_, above, block_levels)

    def run(batches):
        for up, block in _blocks(batches):
            levels, told = min(block_levels, levels_of(block[0][3])), parsed_path(up[6])
            above_text, joined = path_text(told), "".join(left + right for left, right in told).encode()
            out: list[tuple] = []
            for r, p in zip(block, paths([r[4] for r in block], levels), strict=True):
                seen = hashlib.sha256("".join(left + right for left, right in p).encode())
                seen.update(joined)
                out.append((r[7], up[4], up[5], ",".join(x for x in (path_text(p), above_text) if x), seen.hexdigest(), folded(folded(r[5], p), told)))
                if len(out) >= 500:
                    yield proved(out)
                    out = []
            if out:
                yield proved(out)

    def proved(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], row_type), *(pa.array(c, pa.string()) for c in cols[1:])], ["row", *new])

    row_type = arrow_type(nodes, "row")
    kind = nodes.schema["row"].dataType.simpleString()
    # with one round the blocks are the groups
    proofs = _blocked(nodes, block_levels, above).mapInArrow(run, f"row {kind}, " + ", ".join(f"{c} string" for c in new))
    return proofs.select(*(F.col("row").getField(c).alias(c) for c in kept), *new)


def documents_manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "lang", text_col: str = "text", tampered: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(id, group, leaf, subroot, root, path, proof_sha256, folded_root, verified) of documents, in the order of id_col within the group.

    tampered: where it holds (never, if not given; null: not), the text's A-Z are lower-cased before its leaf is recomputed, and folded_root is what that leaf gives with the path of
    the leaf as it was; verified says whether this is the root. Nulls are leaves' dashes; rows of equal ids are ordered by their leaves.
    """
    texts = F.translate(text_col, UPPER, LOWER)
    own = leaf(*fields)
    changed = F.when(tampered, leaf(*(texts if f == text_col else f for f in fields))) if tampered is not None else F.lit(None).cast("string")
    # the texts are read once, here; only digests travel
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(group).alias("of"), own.alias("leaf"), changed.alias("changed")))
    rows = rows.withColumn("changed", F.coalesce("changed", "leaf"))
    found = manifest(rows, "of", ["id", "leaf"], "leaf", "changed", block_levels).drop("changed")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
