"""N-gram language-model scoring over Elias-Fano tries.

Texts are read once, in blocks of bounded size, which keep their tokens as numbers and are written. A block asks for its
distinct n-grams: one row per counting task, with keys and training counts. A key's high bits say the context, its low bits
the successor; tasks share out the range of successors, so a frequent context is spread over all of them and a
frequent n-gram costs one key a block. Every task adds up the counts of all blocks and builds its partition of the
model: a trie with a level per order, whose contexts point by a rising sequence to ranges of successors, which
are kept as differences from a running base, so that each level is a few rising sequences in Elias-Fano code beside
quantised frequencies and back-off weights. The partitions are written to the shared checkpoint folder; nothing is gathered
on the driver but N and V. To score, a task lays its partition into one anonymous memory map, finds each context, reads
the range that its pointers give and searches the successor inside that range alone.

Smoothing: p(w) = (c(w) + 1) / (N + V + 1); p(w | h) = (c(h w) + M p(w | h')) / (c(h) + M), h' without its first word;
an order counts only where c(h) > 0. The first word of a text has no context. For orders from two c(h w) and
M / (c(h) + M) are the trie's quantised values.
"""

from __future__ import annotations

import dataclasses
import json
import math
import mmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import Words, arrow_limits, as_strings, give_back, row_sums, written

ORDER = 2
MASS = 8.0
BLOCK_BYTES = 4 << 20
TASK_BYTES = 8 << 20
#: Steps of a quantised log10; code 0 stands for what is not there, and 16 bits reach 10 ** 31.
QUANTUM = 2048
#: Low bits of an n-gram's key that say the successor, and the bits above that say the context: 56 in all.
SUCCESSOR_BITS, CONTEXT_BITS = 32, 24
_SUCCESSOR = np.uint64((1 << SUCCESSOR_BITS) - 1)
END_KEY = np.uint64(0x9E3779B97F4A7C15 >> 1)


# ---------------------------------------------------------------- Elias-Fano


class EliasFano:
    """A sequence of integers that never falls: low bits packed, high bits in unary."""

    def __init__(self, values: np.ndarray | None, parts: tuple | None = None):
        if parts is None:
            values = np.asarray(values, np.uint64)
            self.n = len(values)
            self.top = int(values[-1]) + 1 if self.n else 1
            self.low_bits = max(0, (self.top // max(1, self.n)).bit_length() - 1)
            high = (values >> np.uint64(self.low_bits)).astype(np.int64)
            bits = np.zeros(((self.n + (self.top >> self.low_bits) + 64) // 64 + 1) * 64, np.uint8)
            bits[high + np.arange(self.n)] = 1
            self.words = np.packbits(bits, bitorder="little").view(np.uint64)
            self.low = _pack(values & np.uint64((1 << self.low_bits) - 1), self.low_bits)
        else:
            self.n, self.top, self.low_bits, self.words, self.low = parts
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])

    def parts(self) -> tuple:
        return self.n, self.top, self.low_bits, self.words, self.low

    def _select(self, k: np.ndarray, zero: bool) -> np.ndarray:
        """Place of the k-th zero or one (from 0) of the high bits."""
        sums = self.zeros if zero else self.ones
        word = np.searchsorted(sums, k, "right") - 1
        left = (k - sums[word]).astype(np.uint64)
        rest, at = ~self.words[word] if zero else self.words[word], np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the word towards the wanted bit
            w = np.uint64(width)
            count = np.bitwise_count((rest >> at) & np.uint64((1 << width) - 1)).astype(np.uint64)
            skip = count <= left
            left = np.where(skip, left - count, left)
            at = np.where(skip, at + w, at)
        return word * 64 + at.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        high = (self._select(i, False) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | _unpack(self.low, i, self.low_bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted value, by the successor in its bucket; -1: not there."""
        wanted = np.asarray(wanted, np.uint64)
        out = np.full(len(wanted), -1, np.int64)
        if not self.n:
            return out
        live = np.flatnonzero(wanted < self.top)
        high = (wanted[live] >> np.uint64(self.low_bits)).astype(np.int64)
        low = wanted[live] & np.uint64((1 << self.low_bits) - 1)
        end = self._select(high, True) - high
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - (high - 1), 0)
        while len(live):
            some = at < end
            live, at, end, low = live[some], at[some], end[some], low[some]
            here = _unpack(self.low, at, self.low_bits)
            hit = here == low
            out[live[hit]] = at[hit]
            go = here < low
            live, at, end, low = live[go], at[go] + 1, end[go], low[go]
        return out

    def find_in(self, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of each wanted value between lo and hi (without it), by halving that range; -1: not there."""
        wanted, lo, hi = np.asarray(wanted, np.uint64), lo.copy(), hi.copy()
        out = np.full(len(wanted), -1, np.int64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            here = self.get(mid)
            hit, less = here == wanted[live], here < wanted[live]
            out[live[hit]] = mid[hit]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[~hit & (lo[live] < hi[live])]
        return out

    def values(self) -> np.ndarray:
        return self.get(np.arange(self.n)) if self.n else np.zeros(0, np.uint64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = (at & 63) + bits > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(packed: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = packed[word] >> shift
    high = np.where(shift > 0, packed[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << bits) - 1)


# ---------------------------------------------------------------- trie


def frequency_code(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.rint(np.log10(np.maximum(counts, 1)) * QUANTUM), 0).astype(np.uint16)


def backoff_code(counts: np.ndarray, mass: float) -> np.ndarray:
    """Of contexts that were seen so often: -log10 of mass / (count + mass)."""
    return np.where(counts > 0, 1 + np.rint(np.log10((counts + mass) / mass) * QUANTUM), 0).astype(np.uint16)


class Level:
    """N-grams of one order in a partition: contexts, pointers to ranges of successors, and the successors in order."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano, start: int):
        self.contexts, self.pointers, self.successors, self.start = contexts, pointers, successors, start

    @classmethod
    def of(cls, keys: np.ndarray, start: int) -> Level:
        """keys: rising and distinct; start: the least successor of the partition."""
        context = keys >> np.uint64(SUCCESSOR_BITS)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
        successor = (keys & _SUCCESSOR) - np.uint64(start)
        # each context's successors start where the last one's ended, so the level never falls
        last = successor[np.append(first[1:], len(keys)) - 1] if len(keys) else successor
        base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.uint64) if len(keys) else successor
        rising = successor + np.repeat(base, np.diff(np.append(first, len(keys))))
        return cls(EliasFano(context[first]), EliasFano(np.append(first, len(keys))), EliasFano(rising), start)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key's n-gram: its context, the range of its successors, the successor in that range; -1: not there."""
        out = np.full(len(keys), -1, np.int64)
        context = self.contexts.find(keys >> np.uint64(SUCCESSOR_BITS))
        live = np.flatnonzero(context >= 0)
        lo, hi = (self.pointers.get(context[live] + d).astype(np.int64) for d in (0, 1))
        base = np.zeros(len(live), np.uint64)
        base[lo > 0] = self.successors.get(lo[lo > 0] - 1)
        out[live] = self.successors.find_in((keys[live] & _SUCCESSOR) - np.uint64(self.start) + base, lo, hi)
        return out


class Trie:
    """A partition of the model. words: all words' keys in its range, with exact counts; levels: orders from two."""

    def __init__(self, words: EliasFano, counts: np.ndarray, levels: list[Level], codes: list[np.ndarray], backoffs: list[np.ndarray], low: int):
        """codes: of each level's n-grams; backoffs: of words, then of each level's n-grams but the last's; low: the least word key."""
        self.words, self.counts, self.levels, self.codes, self.backoffs, self.low = words, counts, levels, codes, backoffs, low

    @classmethod
    def of(cls, grams: list[tuple[np.ndarray, np.ndarray]], low: int, start: int, mass: float = MASS) -> Trie:
        """grams: per order the rising keys and their counts, all above zero."""
        (words, counts), rest = grams[0], grams[1:]
        codes = [frequency_code(c) for _, c in rest]
        backoffs = [backoff_code(c, mass) for _, c in grams[:-1]]
        return cls(EliasFano(words - np.uint64(low)), counts, [Level.of(k, start) for k, _ in rest], codes, backoffs, low)

    def ask(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """Of each order's keys: the counts of words, then the frequency codes; and the back-off codes of all orders but the last."""
        at = [self.words.find(keys[0] - np.uint64(self.low)), *(level.find(k) for level, k in zip(self.levels, keys[1:], strict=True))]
        taken = lambda table, i: np.where(i >= 0, table[np.maximum(i, 0)], 0) if len(table) else np.zeros(len(i), table.dtype)
        values = [taken(t, i).astype(t.dtype) for t, i in zip([self.counts, *self.codes], at, strict=True)]
        return values + [taken(t, i).astype(t.dtype) for t, i in zip(self.backoffs, at, strict=False)]

    def dump(self) -> bytes:
        """One blob: a header, then every array as it lies in memory."""
        arrays: list[np.ndarray] = []

        def put(a: np.ndarray) -> list:
            arrays.append(np.ascontiguousarray(a))
            return [a.dtype.str, len(a)]

        def sequence(e: EliasFano) -> list:
            return [e.n, str(e.top), e.low_bits, put(e.words), put(e.low)]

        head = {"words": sequence(self.words), "counts": put(self.counts), "low": str(self.low)}
        head["levels"] = [[*(sequence(e) for e in (v.contexts, v.pointers, v.successors)), v.start] for v in self.levels]
        head |= {"codes": [put(c) for c in self.codes], "backoffs": [put(b) for b in self.backoffs]}
        text = json.dumps(head).encode()
        out = bytearray(len(text).to_bytes(8, "little") + text)
        for a in arrays:
            out += b"\0" * (-len(out) % 8) + a.tobytes()
        return bytes(out)

    @classmethod
    def load(cls, blob: bytes) -> Trie:
        """The blob in an anonymous memory map, whose parts the levels are views of."""
        held = mmap.mmap(-1, max(1, len(blob)))
        held.write(blob)
        at = 8 + int.from_bytes(blob[:8], "little")
        head = json.loads(blob[8:at])

        def take(told: list) -> np.ndarray:
            nonlocal at
            at += -at % 8
            a = np.frombuffer(held, told[0], told[1], at) if told[1] else np.zeros(0, told[0])
            at += a.nbytes
            return a

        def sequence(told: list) -> EliasFano:
            return EliasFano(None, (told[0], int(told[1]), told[2], take(told[3]), take(told[4])))

        words, counts = sequence(head["words"]), take(head["counts"])
        levels = [Level(*(sequence(e) for e in v[:3]), v[3]) for v in head["levels"]]
        return cls(words, counts, levels, [take(c) for c in head["codes"]], [take(b) for b in head["backoffs"]], int(head["low"]))


# ---------------------------------------------------------------- n-grams of a block


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (a ^ (b * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(27))


def _task_of_words(keys: np.ndarray, tasks: int) -> np.ndarray:
    return ((keys >> np.uint64(31)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)


def _task_of_successors(keys: np.ndarray, tasks: int) -> np.ndarray:
    return (((keys & _SUCCESSOR) >> np.uint64(SUCCESSOR_BITS - 32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int64)


def _least(task: int, tasks: int, bits: int) -> int:
    """The least key of so many bits that falls to a task by its highest 32."""
    return -(-(task << 32) // tasks) << (bits - 32)


class Block:
    """The tokens of some texts (words, then one end each) as places among the distinct ones' keys, the commonest first."""

    def __init__(self, keys: np.ndarray, tokens: np.ndarray, n: np.ndarray, taught: np.ndarray):
        """n: tokens of each text; taught: whether it teaches."""
        self.keys, self.tokens, self.n, self.taught = keys, tokens, n, taught

    @classmethod
    def of(cls, col: pa.Array, taught: np.ndarray) -> Block:
        from xxhash import xxh3_64_intdigest

        words = Words(col)
        index, distinct = words.encoded()
        keys = np.fromiter((xxh3_64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct)) >> np.uint64(1)
        keys, place = np.unique(np.append(keys, END_KEY), return_inverse=True)
        n = words.per_row + 1
        tokens = np.full(int(n.sum()), place[-1])
        tokens[np.arange(words.n) + np.repeat(np.arange(len(n)), words.per_row)] = place[:-1][index]
        order = np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        return cls(keys[order], rank[tokens], n, taught)

    def dump(self) -> bytes:
        kind = np.uint16 if len(self.keys) < 1 << 16 else np.uint32
        parts = [_planes(self.keys), _planes(self.tokens.astype(kind)), _planes(self.n.astype(np.uint32)), _planes(self.taught.astype(np.uint8))]
        return b"".join(len(p).to_bytes(8, "little") + p for p in (bytes([np.dtype(kind).itemsize]), *parts))

    @classmethod
    def load(cls, blob: bytes) -> Block:
        parts, at = [], 0
        while at < len(blob):
            size = int.from_bytes(blob[at : at + 8], "little")
            parts.append(blob[at + 8 : at + 8 + size])
            at += 8 + size
        return cls(_unplanes(parts[1], np.uint64), _unplanes(parts[2], np.uint16 if parts[0][0] == 2 else np.uint32).astype(np.int64), _unplanes(parts[3], np.uint32).astype(np.int64), _unplanes(parts[4], np.uint8) > 0)

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n)])

    def grams(self, order: int, tasks: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per order: the distinct keys by task and then value, the tasks' cuts, the key of each n-gram, and the place of its last token."""
        starts = self.starts()
        turn = np.argsort(self.keys)
        inverse = np.empty(len(turn), np.int64)
        inverse[turn] = np.arange(len(turn))
        u = self.keys[turn]
        out = [(u, np.searchsorted(_task_of_words(u, tasks), np.arange(tasks + 1)), inverse[self.tokens], np.arange(len(self.tokens)))]
        token = self.keys[self.tokens]
        gram, place = token << np.uint64(1), out[0][3]
        # tokens into the text that an n-gram's last one is
        into = place - np.repeat(starts[:-1], self.n)
        for k in range(1, order):
            inner = into[place] >= k
            before = gram[np.flatnonzero(inner) - 1]
            place = place[inner]
            gram = _mix(before, token[place])
            key = (before >> np.uint64(64 - CONTEXT_BITS) << np.uint64(SUCCESSOR_BITS)) | (gram >> np.uint64(64 - SUCCESSOR_BITS))
            u, c = np.unique(key, return_inverse=True)
            task = _task_of_successors(u, tasks)
            turn = np.argsort(task, kind="stable")
            inverse = np.empty(len(turn), np.int64)
            inverse[turn] = np.arange(len(turn))
            out.append((u[turn], np.searchsorted(task[turn], np.arange(tasks + 1)), inverse[c], place))
        return out


def _planes(a: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())


def _unplanes(blob: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return raw.reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys: high halves as differences, compressed, then the low halves as they are."""
    high = np.diff(keys >> np.uint64(32), prepend=np.uint64(0)).astype(np.uint32)
    head = _planes(high)
    return len(head).to_bytes(4, "little") + head + (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()


def _unpack_keys(blob: bytes) -> np.ndarray:
    m = 4 + int.from_bytes(blob[:4], "little")
    return (np.cumsum(_unplanes(blob[4:m], np.uint32).astype(np.uint64)) << np.uint64(32)) | np.frombuffer(blob, np.uint32, offset=m)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sums of their counts in 64 bits."""
    every, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n[order], first) if len(every) else n


def _rated(block: Block, order: int, tasks: int, found: list[np.ndarray], n_all: int, v_all: int, mass: float) -> tuple[np.ndarray, ...]:
    """(known tokens, base score, model score) per row; found: as Trie.ask gives it, for the block's keys in their order."""
    grams, starts = block.grams(order, tasks), block.starts()
    counts = found[0][grams[0][2]]
    p = (counts + 1.0) / (n_all + v_all + 1)
    base = np.log10(p)
    node = grams[0][2]
    for k in range(1, order):
        _, _, code, place = grams[k]
        # the context is the n-gram of the order below that ends one token earlier
        back, freq = found[order + k - 1][node[place - 1]], found[k][code]
        share = np.where(freq > 0, 10 ** ((freq.astype(float) - 1) / QUANTUM), 0.0) / mass + p[place]
        rated = p.copy()
        # rounded steps must not add up to more than one
        rated[place] = np.where(back > 0, np.minimum(share * 10 ** -((back.astype(float) - 1) / QUANTUM), 1.0), p[place])
        p = rated
        node = np.full(len(p), -1)
        node[place] = code
    return row_sums((counts > 0).astype(np.int64), starts), row_sums(base, starts), row_sums(np.log10(p), starts)


# ---------------------------------------------------------------- on tables

_NONE = {"task": pa.int32(), "block": pa.int64(), "n": pa.int64(), "v": pa.int64(), "trie": pa.binary(), "found": pa.list_(pa.binary())}


def _blocks(docs: DataFrame, taught: Column, kept: list[str], text_col: str, block_bytes: int) -> DataFrame:
    """(block, body, rows): the tokens of each block and the columns kept of its rows; written once."""
    names = [f"c{i}" for i in range(len(kept))]
    texts = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), F.coalesce(taught, F.lit(False)).alias("taught"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def run(batches):
        made = 0

        def out(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal made
            table = pa.Table.from_batches(pieces).combine_chunks()
            body = Block.of(as_strings(table["t"]), table["taught"].to_numpy()).dump()
            structs = pa.StructArray.from_arrays([table[c].combine_chunks() for c in ("taught", *names)], fields=[table.schema.field(c) for c in ("taught", *names)])
            rows = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
            number, made = (TaskContext.get().partitionId() << 32) + made, made + 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([body], pa.binary()), rows], ["block", "body", "rows"])

        pieces, size = [], 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.binary_length(as_strings(batch.column(batch.num_columns - 1))).to_pylist()):
                if size and size + n > block_bytes:
                    if i > start:
                        pieces.append(batch.slice(start, i - start))
                    yield out(pieces)
                    pieces, size, start = [], 0, i
                size += n + 1
            if batch.num_rows > start:
                pieces.append(batch.slice(start))
        if pieces:
            yield out(pieces)
        give_back()

    fields = "".join(f", {n}: {dict(docs.dtypes)[c]}" for c, n in zip(kept, names, strict=True))
    return written(texts.mapInArrow(run, f"block long, body binary, rows array<struct<taught: boolean{fields}>>"))


@dataclasses.dataclass(frozen=True)
class Model:
    """partitions (task, n, v, trie): a written table; order, tasks and mass that it was built with; tokens and distinct tokens of training."""

    partitions: DataFrame
    order: int
    tasks: int
    mass: float
    n: int
    v: int


def _asks(blocks: DataFrame, order: int, tasks: int) -> DataFrame:
    """A row per block and task that it asks: per order the keys, and how often the block's teaching texts have them."""

    def run(batches):
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block.load(body)
                row = np.repeat(block.taught.astype(float), block.n)
                grams = block.grams(order, tasks)
                counts = [np.bincount(code, row[place], len(u)).astype(np.uint32) for u, _, code, place in grams]
                cols: list[list] = [[], [], []]
                for t in range(tasks):
                    if any(cuts[t + 1] > cuts[t] for _, cuts, _, _ in grams):
                        cols[0].append(t)
                        cols[1].append([_pack_keys(u[cuts[t] : cuts[t + 1]]) for u, cuts, _, _ in grams])
                        cols[2].append([_planes(c[cuts[t] : cuts[t + 1]]) for c, (_, cuts, _, _) in zip(counts, grams, strict=True)])
                blobs = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([number] * len(cols[0]), pa.int64()), pa.array(cols[1], blobs), pa.array(cols[2], blobs)], ["task", "block", "keys", "counts"])
        give_back()

    return blocks.select("block", "body").mapInArrow(run, "task int, block long, keys array<binary>, counts array<binary>")


def _kinds(order: int) -> list:
    return [np.int64, *[np.uint16] * (2 * (order - 1))]


def _answers(trie: Trie | None, order: int, sent: list[list[np.ndarray]]) -> list[list[bytes]]:
    """What the trie knows of each asking block's keys."""
    u, at = zip(*(np.unique(np.concatenate(s), return_inverse=True) for s in sent), strict=True)
    level = [k if k < order else k - order for k in range(2 * order - 1)]
    found = trie.ask(list(u)) if trie else [np.zeros(len(u[i]), kind) for i, kind in zip(level, _kinds(order), strict=True)]
    out: list[list[bytes]] = [[] for _ in sent[0]]
    for i, values in zip(level, found, strict=True):
        ends = np.cumsum([len(s) for s in sent[i]])
        for row, part in zip(out, np.split(values[at[i]], ends[:-1]), strict=True):
            row.append(_planes(part))
    return out


def _table(**cols) -> pa.Table:
    n = len(next(iter(cols.values())))
    return pa.table({c: pa.array(cols.get(c, [None] * n), t) for c, t in _NONE.items()})


def _counted(blocks: DataFrame, order: int, tasks: int, mass: float, answer: bool) -> tuple[DataFrame, Model]:
    """(block, task, found) for the blocks' own n-grams, if answer, and the model: each task builds its trie and answers from it."""

    def build(table: pa.Table) -> pa.Table:
        task = table["task"][0].as_py()
        keys, counts = table["keys"].to_pylist(), table["counts"].to_pylist()
        sent = [[_unpack_keys(row[k]) for row in keys] for k in range(order)]
        grams = []
        for k in range(order):
            u, n = merged(sent[k], [_unplanes(row[k], np.uint32) for row in counts])
            grams.append((u[n > 0], n[n > 0]))
        blob = Trie.of(grams, _least(task, tasks, 63), _least(task, tasks, SUCCESSOR_BITS), mass).dump()
        out = [_table(task=[task], n=[int(grams[0][1].sum())], v=[len(grams[0][0])], trie=[blob])]
        del grams, counts, keys
        if answer:
            out.append(_table(task=[task] * table.num_rows, block=table["block"].to_pylist(), found=_answers(Trie.load(blob), order, sent)))
        del sent
        give_back()
        return pa.concat_tables(out)

    made = written(_asks(blocks, order, tasks).groupBy("task").applyInArrow(build, "task int, block long, n long, v long, trie binary, found array<binary>"))
    partitions = made.where("block is null").select("task", "n", "v", "trie")
    n, v = partitions.agg(F.sum("n"), F.sum("v")).first()
    return made.where("block is not null").select("block", "task", "found"), Model(partitions, order, tasks, mass, n or 0, v or 0)


def _rates(blocks: DataFrame, answers: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    order, tasks, mass, n_all, v_all = model.order, model.tasks, model.mass, model.n, model.v
    names = [f"c{i}" for i in range(len(kept))]

    def rate(body: pa.Table, found: pa.Table) -> pa.Table:
        block = Block.load(body["body"][0].as_py())
        told = found.sort_by("task")["found"].to_pylist()
        every = [np.concatenate([_unplanes(row[k], kind) for row in told]) for k, kind in enumerate(_kinds(order))]
        known, base, scores = _rated(block, order, tasks, every, n_all, v_all, mass)
        rows = body["rows"].combine_chunks().flatten()
        cols = [*(rows.field(n) for n in names), pa.array(block.n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(known), n_all), pa.int64()), pa.array(base), pa.array(scores)]
        return pa.table(cols, [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in blocks.schema["rows"].dataType.elementType.fields[1:])
    rated = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, fields + "n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rated.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _tasks(docs: DataFrame, text_col: str, task_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 1)).first()[0] or 0
    return max(1, math.ceil(size / task_bytes))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, mass: float = MASS, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> Model:
    """A model of all rows of docs (null text: empty), written to the shared checkpoint folder. An empty table teaches nothing."""
    arrow_limits(docs.sparkSession)
    tasks = _tasks(docs, text_col, task_bytes)
    return _counted(_blocks(docs, F.lit(True), [], text_col, block_bytes), order, tasks, mass, False)[1]


def apply(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """score() by a model that is there already, of any texts."""
    arrow_limits(docs.sparkSession)
    kept = [c for c in docs.columns if c == id_col or c in carry]
    blocks, order = _blocks(docs, F.lit(False), kept, text_col, block_bytes), model.order

    def answer(asked: pa.Table, partition: pa.Table) -> pa.Table:
        keys = asked["keys"].to_pylist()
        if not keys:
            return _table(block=[]).select(["block", "task", "found"])
        trie = Trie.load(partition["trie"][0].as_py()) if partition.num_rows else None
        return _table(task=asked["task"].to_pylist(), block=asked["block"].to_pylist(), found=_answers(trie, order, [[_unpack_keys(row[k]) for row in keys] for k in range(order)])).select(["block", "task", "found"])

    asked = _asks(blocks, order, model.tasks).select("task", "block", "keys").groupBy("task")
    answers = asked.cogroup(model.partitions.select("task", "trie").groupBy("task")).applyInArrow(answer, "block long, task int, found array<binary>")
    return _rates(blocks, answers, model, kept)


def score(docs: DataFrame, taught: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mass: float = MASS, block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id [, carried columns], n_tokens, n_known, train_tokens, base_score, score) per row.

    taught: a condition on docs that says which rows teach. Null and empty texts are one end token. Rows with
    equal ids are scored each. Nothing taught: every token is unknown. An empty table gives no rows; scores are log10
    probabilities of whole texts. Words are told apart by 63-bit hashes, n-grams by 56-bit ones; other columns are
    ignored, whatever their names.
    """
    arrow_limits(docs.sparkSession)
    tasks = _tasks(docs, text_col, task_bytes)
    kept = [c for c in docs.columns if c == id_col or c in carry]
    blocks = _blocks(docs, taught, kept, text_col, block_bytes)
    answers, model = _counted(blocks, order, tasks, mass, True)
    return _rates(blocks, answers, model, kept)
