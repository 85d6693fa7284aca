"""Digests of any number of offers: next-fit packing as a scan over chunks, so that no task sees a whole list.

What a chunk of consecutive entries does to the part that is open before it depends on one number only, the characters in that part. As the
first entry that no longer fits settles all that follows, a chunk is a short table of cases. Tables of neighbouring chunks are composed level by
level up to one a list, then the sizes before every chunk are handed down, and every chunk is cut on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from ..shipping import ship_package

CHUNK = 4096
FAN = 64
SEP = 2  # characters between two entries
CASES = "base long, code long, room long, above array<long>, closed array<long>, ends array<long>, adds long"


def positions(rows: DataFrame, order: list[Column], by: str | None = None) -> DataFrame:
    """rows with position (from 1, in order), members (rows of the list) and base (a number of the list), of each group if by names one; null is a group.

    Ranges of the order lie in partitions, which are written; a partition's rows are numbered where they are and only the partitions' sizes, one number
    each, come to the driver. order must end in what tells rows apart.
    """
    spark = rows.sparkSession
    keys = ([F.col(by).asc()] if by else []) + order
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        starts.append((p, total))
        total += n
    first = F.broadcast(spark.createDataFrame(starts, "__p long, __first long"))
    numbered = placed.withColumn("__p", part).join(first, "__p").withColumn("__n", F.col("__first") + within).drop("__p", "__first", "__at")
    if by is None:
        return numbered.withColumns({"base": F.lit(0).cast("long"), "members": F.lit(total).cast("long"), "position": F.col("__n") + 1}).drop("__n")
    lists = numbered.groupBy(F.col(by).alias("__by")).agg(F.min("__n").alias("base"), F.count(F.lit(1)).alias("members"))
    return numbered.join(lists, F.col(by).eqNullSafe(F.col("__by"))).withColumn("position", F.col("__n") - F.col("base") + 1).drop("__n", "__by")


def _followers(chars: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters up to each entry, separators included, and the entry that begins the next part if one begins here."""
    upto = np.cumsum(chars + SEP)
    after = np.searchsorted(upto, room - chars + upto, side="right")
    return upto, np.maximum(after, np.arange(len(chars)) + 1)


def cases(chars: np.ndarray, room: int) -> tuple[list[int], list[int], list[int], int | None]:
    """What a chunk does to an open part of s characters: the first case with above < s closes so many parts and leaves an open one of so many
    characters; if s + adds fits the room, nothing is closed. Sizes count up to the room, as fuller parts behave alike."""
    upto, after = _followers(chars, room)
    n, cap = len(chars), max(0, room)
    closed, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j >= n:
            closed[i], ends[i] = 1, min(cap, int(chars[i] + upto[-1] - upto[i]))
        else:
            closed[i], ends[i] = closed[j] + 1, ends[j]
    some = 1 + int(np.searchsorted(upto[:-1], room, side="right"))
    adds = int(upto[-1]) if upto[-1] <= room else None
    return (room - upto[:some]).tolist(), closed[:some].tolist(), ends[:some].tolist(), adds


def after_chunk(size: int, room: int, case: tuple) -> tuple[int, int]:
    """(parts closed, characters in the open part) behind a chunk."""
    above, closed, ends, adds = case
    if adds is not None and size + adds <= room:
        return 0, size + adds
    i = next(i for i, low in enumerate(above) if low < size)
    return closed[i], ends[i]


def composed(first: tuple, then: tuple, room: int) -> tuple:
    """The cases of two chunks in a row."""
    above, closed, ends = [], [], []
    for low, n, end in zip(*first[:3], strict=True):
        more, last = after_chunk(end, room, then)
        above.append(low), closed.append(n + more), ends.append(last)
    if first[3] is None:
        return above, closed, ends, None
    # what passes the first chunk unbroken meets the second with more characters
    for low, n, end in zip(*then[:3], strict=True):
        above.append(low - first[3]), closed.append(n), ends.append(end)
        if low - first[3] < 0:
            break
    adds = None if then[3] is None or first[3] + then[3] > room else first[3] + then[3]
    return above, closed, ends, adds


def _case(row: dict) -> tuple:
    return row["above"], row["closed"], row["ends"], row["adds"]


def _learn(table: pa.Table) -> pa.Table:
    table = table.sort_by("position")
    room = table["room"][0].as_py()
    above, closed, ends, adds = cases(table["chars"].to_numpy().astype(np.int64), room)
    longs = pa.list_(pa.int64())
    return pa.table({"base": table["base"][:1], "code": table["code"][:1], "room": table["room"][:1], "above": pa.array([above], longs), "closed": pa.array([closed], longs), "ends": pa.array([ends], longs), "adds": pa.array([adds], pa.int64())})


def _compose(table: pa.Table) -> pa.Table:
    rows = table.sort_by("code").to_pylist()
    case = _case(rows[0])
    for row in rows[1:]:
        case = composed(case, _case(row), rows[0]["room"])
    longs = pa.list_(pa.int64())
    return pa.table({"base": table["base"][:1], "code": table["up"][:1], "room": table["room"][:1], "above": pa.array([case[0]], longs), "closed": pa.array([case[1]], longs), "ends": pa.array([case[2]], longs), "adds": pa.array([case[3]], pa.int64())})


def _hand_down(table: pa.Table) -> pa.Table:
    rows = table.sort_by("code").to_pylist()
    size, part, out = rows[0]["size"], rows[0]["part"], []
    for row in rows:
        out.append((row["base"], row["code"], size, part))
        closed, size = after_chunk(size, row["room"], _case(row))
        part += closed
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("base", "code", "size", "part"), zip(*out, strict=True), strict=True)})


def _cut(table: pa.Table) -> pa.Table:
    table = table.sort_by("position")
    chars, room, size = table["chars"].to_numpy().astype(np.int64), table["room"][0].as_py(), table["size"][0].as_py()
    upto, after = _followers(chars, room)
    begins = np.zeros(len(chars), np.int64)
    i = int(np.searchsorted(upto, room - size, side="right"))
    while i < len(chars):
        begins[i] = 1
        i = int(after[i])
    return pa.table({"base": table["base"], "position": table["position"], "part": pa.array(table["part"][0].as_py() + np.cumsum(begins))})


def part_numbers(entries: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(base, position, part from 1) for entries(base, position from 1, chars, room): in order, a new part where the open one, a separator and the entry exceed the room.

    An entry that exceeds the room stands alone. Longs without nulls; room is the same for all of a list. No entries: no rows. Results do not depend on chunk and fan.
    """
    ship_package(entries.sparkSession)
    sized = entries.select("base", "position", "chars", "room", F.floor((F.col("position") - 1) / chunk).alias("code"))
    levels = [written(sized.groupBy("base", "code").applyInArrow(_learn, CASES))]
    while not levels[-1].where("code > 0").isEmpty():
        levels.append(written(levels[-1].withColumn("up", F.floor(F.col("code") / fan)).groupBy("base", "up").applyInArrow(_compose, CASES)))
    # a full part number 0 is open before a list: the first entry closes it
    before = levels[-1].select("base", "code", F.greatest(F.lit(0).cast("long"), "room").alias("size"), F.lit(0).cast("long").alias("part"))
    for level in reversed(levels[:-1]):
        above = before.withColumnRenamed("code", "up")
        before = written(level.withColumn("up", F.floor(F.col("code") / fan)).join(above, ["base", "up"]).groupBy("base", "up").applyInArrow(_hand_down, "base long, code long, size long, part long"))
    return sized.join(before, ["base", "code"]).groupBy("base", "code").applyInArrow(_cut, "base long, position long, part long")
