"""Repair of conversations whose turns are damaged: the cheapest edits that give system? (user assistant)+, or nothing.

A conversation's turns and the state of the grammar span a lattice that is never built: a node is (turns consumed, state), and Dijkstra's
search takes the node with the smallest (cost, audit) from a heap, where the audit is the text of the edits' initials. The first
popped node that has consumed all turns in an accepting state is the answer.

What the search needs of a turn is one character. Narrow rows are dealt by conversation and sorted, so a conversation costs one byte a turn, whatever its
texts hold. A long one is searched block by block: at the end of a block the cheapest way into each state is kept, ranked by its audit, and
the next block's search starts from these, so neither the heap nor the audits in it grow with the conversation. Texts travel once, sorted behind
their conversation's answer, and are streamed into the digest of the repaired turns, which is sequential in its conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import arrow_limits, arrow_type, written

# Costs of edits, and what an undeleted truncated turn costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States of the grammar (nothing yet, after the system turn, after a user's, after an assistant's), what each takes, and where it may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
WANTED = ("user", "user", "assistant", "user")
#: Turns searched at once.
BLOCK = 256
# White space, and the marks that end a sentence.
BLANKS, MARKS = " \t\n\x0b\x0c\r", ".!?"
#: Characters of a turn: its role's initial in lower case as it is, in upper case if the text is truncated; other roles are o and O; x must go.
CODES = "suaoSUAOx"

Survivor = tuple[int, str]  # cost and audit


def _search(codes: str, starts: list[tuple[int, int, int]], last: bool) -> dict[int, tuple[int, int, str]]:
    """Cheapest ways through a block from starts (cost, rank, state): state to (cost, rank of its start, audit), of the first accepting end alone if last."""
    n = len(codes)
    heap = [(cost, rank, "", 0, state) for cost, rank, state in starts]
    heap.sort()
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, int, str]] = {}
    while heap:
        cost, rank, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not last:
                # the next block inserts before its own turns: here every way ends with a turn's edit
                if state not in found:
                    found[state] = (cost, rank, audit)
                if len(found) == len(NEXT):
                    break
                continue
            if state in ENDS:
                return {state: (cost, rank, audit)}
        else:
            code = codes[i]
            heappush(heap, (cost + DELETE, rank, audit + "D", i + 1, state))
            if code != "x":
                more = TRUNCATED if code.isupper() else 0
                to = NEXT[state].get(code.lower())
                if to is not None:
                    heappush(heap, (cost + KEEP + more, rank, audit + "K", i + 1, to))
                heappush(heap, (cost + REROLE + more, rank, audit + "R", i + 1, 3 if state == 2 else 2))
        heappush(heap, (cost + INSERT, rank, audit + "I", i, 3 if state == 2 else 2))
    return found


def _cheapest(codes: str) -> Survivor:
    starts, back = [(0, 0, 0)], []
    for at in range(0, max(1, len(codes)), BLOCK):
        last = at + BLOCK >= len(codes)
        found = _search(codes[at : at + BLOCK], starts, last)
        # ways of equal cost go on in the order of their audits, of which none is the beginning of another
        ranked = sorted((rank, audit, cost, state) for state, (cost, rank, audit) in found.items())
        starts = [(cost, place, state) for place, (_, _, cost, state) in enumerate(ranked)]
        back.append([(rank, audit) for rank, audit, _, _ in ranked])
    audits, place = [], 0
    for ways in reversed(back):
        place, audit = ways[place]
        audits.append(audit)
    return starts[0][0], "".join(reversed(audits))


_remembered = lru_cache(maxsize=50_000)(_cheapest)


def cheapest(codes: str) -> Survivor:
    """(cost, audit) of the cheapest edits of turns with these codes; of equally cheap ones the audit that is least in ASCII."""
    return _remembered(codes) if len(codes) <= 64 else _cheapest(codes)


def edits(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired turns (role, text) of an audit."""
    state = 0
    for edit in audit:
        if edit == "I":
            yield WANTED[state], ""
        else:
            role, text = next(turns)
            if edit == "D":
                continue
            if edit == "K":
                if state == 0 and role[:1] == "s":
                    state = 1
                    yield role, text
                    continue
                yield role, text
            else:
                yield WANTED[state], text
        state = 3 if state == 2 else 2


def _rows(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, h, n): the turns with nulls of role and text as one blank, the order's last key, and one copy each."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{id_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    return rows.withColumn("n", F.lit(1).cast("long"))


def damaged(rows: DataFrame, id_col: str = "conv") -> DataFrame:
    """Turns of _rows damaged by crc32(id:turn) modulo 20: 0 drops, 1 empties, 2 takes sentence marks, 3 makes two copies, 4 makes the user's. Null ids and turns are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank(id_col), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = rows.withColumn("fate", fate).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    return rows.withColumns({"text": text, "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role")), "n": F.when(F.col("fate") == 3, 2).otherwise(F.col("n"))}).drop("fate")


def _code(role: Column, text: Column) -> Column:
    first, last = F.substring(role, 1, 1), F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))
    known = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(last == "", "x").when(last.isin(*MARKS), known).otherwise(F.upper(known))


def _answers(rows: DataFrame) -> DataFrame:
    """(conv, cost, audit and the counts of faults) from narrow rows: the texts' digests and codes alone are shuffled."""
    code = _code(F.col("role"), F.col("text"))
    narrow = rows.select("conv", "turn", "role", F.md5(F.col("text").cast("binary")).alias("h"), code.alias("code"), "n")
    # equal turns are one row with a count before anything is shuffled
    counted = narrow.groupBy("conv", "turn", "role", "h", "code").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv", "role", "h").orderBy(F.col("turn").asc_nulls_first())
    told = counted.withColumn("first", F.row_number().over(earlier) == 1)
    told = told.select("conv", "turn", "role", "h", F.substring("role", 1, 1).alias("initial"), "code", "n", "first")
    kind = dict(rows.dtypes)["conv"]

    def run(batches):
        out: list[tuple] = []
        state = None
        for batch in batches:
            for conv, turn, initial, code, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != state["conv"]:
                    if state is not None:
                        out.append(closed(state))
                    state = {"conv": conv, "codes": [], "low": None, "high": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None}
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"], state["distinct"] = turn, state["distinct"] + 1
                again = n if not first else n - 1
                if code == "x":
                    state["blank"] += n
                    state["codes"].append("x" * n)
                else:
                    state["duplicate"] += again
                    state["truncated"] += first and code.isupper()
                    state["codes"].append((code if first else "") + "x" * again)
                if state["before"] is not None:
                    state["illegal"] += state["before"] + initial not in ("su", "ua", "au")
                state["illegal"] += n - 1 if initial + initial not in ("su", "ua", "au") else 0
                state["before"] = initial
            if len(out) >= 2000:
                yield answered(out)
                out = []
        if state is not None:
            out.append(closed(state))
        yield answered(out)

    def closed(s: dict) -> tuple:
        cost, audit = cheapest("".join(s["codes"]))
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["distinct"]
        return s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit

    def answered(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (conv_type, *[pa.int64()] * 6, pa.string()), strict=True)], ["conv", *COUNTS, "audit"])

    conv_type = arrow_type(rows, "conv")
    ordered = told.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "h")
    return ordered.select("conv", "turn", "initial", "code", "n", "first").mapInArrow(run, f"conv {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The turns of each conversation in order behind one row (head) of its answer."""
    head = answers.select("conv", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("h"), F.lit(1).cast("long").alias("n"))
    said = rows.select("conv", F.lit(False).alias("head"), "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("h"), "n")
    both = said.unionByName(head).repartition("conv")
    return both.sortWithinPartitions("conv", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "h").select("conv", "head", "role", "text", "n")


def _conversations(batches) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """(conv, audit, its turns as they come); of a conversation nothing but its audit is held."""
    flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    after: list[tuple] = []

    def turns():
        for row in flat:
            if row[1]:
                after.append(row)
                return
            for _ in range(row[4]):
                yield row[2], row[3]

    first = next(flat, None)
    if first is not None:
        after.append(first)
    while after:
        conv, _, _, audit, _ = after.pop()
        said = turns()
        yield conv, audit, said
        for _ in said:  # whatever the reader left
            pass


def digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = False) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (of role:text, newline-joined).

    damage: damage the turns first (a benchmark of repair); conversations that lose all their turns are still told of. Turns stand in order of their number (nulls
    first), then of role and text's MD5; equal rows are neighbours, the second of them a duplicate. A null role or text counts as one blank, which no edit keeps; a null
    conversation id is a conversation. Conversations without turns have zeros, an empty audit and the digest of nothing. An empty table gives no rows; other columns are ignored.
    """
    arrow_limits(turns.sparkSession)
    rows = _rows(turns, id_col, turn_col, role_col, text_col)
    given = rows
    if damage:
        rows = damaged(rows)
    found = _answers(rows)
    kind = dict(rows.dtypes)["conv"]

    def run(batches):
        out: list[tuple] = []
        for conv, audit, said in _conversations(batches):
            seen, joint = hashlib.sha256(), ""
            for role, text in edits(audit, said):
                seen.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            out.append((conv, seen.hexdigest()))
            if len(out) >= 2000:
                yield told(out)
                out = []
        yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(cols[0], conv_type), pa.array(cols[1], pa.string())], ["conv", "repaired_sha256"])

    conv_type = arrow_type(rows, "conv")
    whole = written(found)  # read twice: once to stream the texts behind it
    digest = _streamed(rows, whole).mapInArrow(run, f"conv {kind}, repaired_sha256 string")
    out = whole.join(digest, whole["conv"].eqNullSafe(digest["conv"])).drop(digest["conv"])
    if not damage:
        return out
    lost = given.select("conv").distinct().withColumnRenamed("conv", "__conv")
    both = lost.join(out, F.col("__conv").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("__conv", "conv")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}
    return both.withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}).select("conv", *COUNTS, "audit", "repaired_sha256")


def repaired(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turn, role, text) of the repaired conversations, turns numbered from 0; conversations of which nothing can be kept have no rows. Order, nulls and odd input as in digests."""
    arrow_limits(turns.sparkSession)
    rows = _rows(turns, id_col, turn_col, role_col, text_col)
    kind = dict(rows.dtypes)["conv"]

    def run(batches):
        out: list[tuple] = []
        for conv, audit, said in _conversations(batches):
            for place, (role, text) in enumerate(edits(audit, said)):
                out.append((conv, place, role, text))
                if len(out) >= 1000:
                    yield told(out)
                    out = []
        yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (conv_type, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv", "turn", "role", "text"])

    conv_type = arrow_type(rows, "conv")
    return _streamed(rows, written(_answers(rows))).mapInArrow(run, f"conv {kind}, turn long, role string, text string").withColumnRenamed("conv", id_col)
