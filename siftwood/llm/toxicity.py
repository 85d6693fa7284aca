"""Counterfactual-regularised toxicity classifier.

A logistic model over the words and word beginnings that a text holds (present or not). Besides the log loss it pays
for every change of score when identity terms of a labelled sentence are swapped for other terms of their group
or for a neutral word, and when a term of a group is put in at all, so that naming a group moves no score.
Labels come from a bounded sample of labelled rows; every text is scored whole, where it is read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, arrow_limits, as_strings, bounded_rows, ensure_checkpoint_dir, give_back, ragged, row_sums, spans

#: Most labelled rows that a model is fitted on.
MAX_LABELLED = 12_000
#: Word beginnings, in bytes.
PREFIXES = (3, 4, 5, 6)
#: Features are kept whose presence tells the labels apart at least this well (log-likelihood ratio), the best first; no others come to the driver.
MIN_GAIN, MAX_FEATURES = 12.0, 6000
COUNTERFACTUAL_WEIGHT, RIDGE, LASSO = 5.0, 1e-4, 3e-5
THRESHOLD = 0.3

# Identity terms by group: fixed values.
IDENTITY_GROUPS = (
    ("woman", "man", "women", "men", "female", "male", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau", "mann", "frauen", "mujeres", "hombres", "femmes", "hommes", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual", "lesbiana", "lesbienne", "schwul", "lesbisch"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "muslims", "christians", "jews", "hindus", "musulmán", "cristiano", "judío", "musulman", "chrétien", "juif", "muslime", "christen", "juden"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic", "negro", "blanco", "noir", "blanc", "schwarz", "weiß"),
    ("immigrant", "immigrants", "refugee", "refugees", "foreigner", "foreigners", "citizen", "citizens", "inmigrante", "refugiado", "immigré", "réfugié", "einwanderer", "flüchtling"),
    ("disabled", "deaf", "blind", "autistic", "old", "young", "elderly"),
)
NEUTRAL = "person"


def features(words: pa.Array) -> np.ndarray:
    """32-bit codes of each distinct word (binary): the word itself, then its beginnings; 0: none."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    out = np.zeros((n, 1 + len(PREFIXES)), np.uint64)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(PREFIXES)):
            has = lengths > k
            code[has] = (code[has] + data[offsets[:-1][has] + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            code[has] ^= code[has] >> np.uint64(29)
            if k + 1 in PREFIXES:
                # a beginning is shorter than its word
                longer = lengths > k + 1
                out[longer, 1 + PREFIXES.index(k + 1)] = code[longer] * np.uint64(2 * k + 3)
        tail = np.maximum(lengths - max(PREFIXES), 0)
        at = ragged(offsets[:-1] + np.minimum(lengths, max(PREFIXES)), tail)
        place = ragged(np.zeros(n, np.int64), tail).astype(np.uint64)
        mixed = (data[at].astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))
        mixed ^= mixed >> np.uint64(31)
        sums = np.zeros(n, np.uint64)
        filled = tail > 0
        if filled.any():
            sums[filled] = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(tail)[:-1]])[filled])
        out[:, 0] = (code + sums * np.uint64(0x9E3779B97F4A7C15) + lengths.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    short = (out >> np.uint64(32)).astype(np.uint32)
    return np.where(out == 0, 0, np.maximum(short, 1)).astype(np.uint32)


def row_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature), each pair once."""
    words = Words(col, letters_only=True)
    index, distinct = words.encoded()
    codes = features(distinct)
    pairs = np.unique((np.repeat(np.arange(len(col)), words.per_row) << 32) | index)
    found = codes[pairs & 0xFFFFFFFF]
    both = (np.repeat(pairs >> 32, codes.shape[1]) << 32) | found.ravel()
    both = np.unique(both[found.ravel() > 0])
    return both >> 32, (both & 0xFFFFFFFF).astype(np.uint32)


class IdentitySwap:
    """Swaps every identity term of a text for the next of its group, or for the neutral word."""

    def __init__(self, groups=IDENTITY_GROUPS):
        self.next = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
        self.pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, self.next), key=len, reverse=True)) + r")\b", re.IGNORECASE)

    def variants(self, text: str) -> list[str]:
        if not self.pattern.search(text):
            return []
        return [self.pattern.sub(lambda m: self.next.get(m[0].lower(), NEUTRAL), text), self.pattern.sub(NEUTRAL, text)]


def _gain(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of presence against the label."""

    def part(k, n, p):
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(n * p, 1e-9))

    share = (pos + neg) / (n_pos + n_neg)
    return 2 * (part(pos, n_pos, share) + part(n_pos - pos, n_pos, 1 - share) + part(neg, n_neg, share) + part(n_neg - neg, n_neg, 1 - share))


def _best(codes: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The features kept, rising."""
    gain = _gain(pos, neg, n_pos, n_neg)
    best = np.lexsort((codes, -gain))[:MAX_FEATURES]
    return np.sort(codes[best[gain[best] >= MIN_GAIN]])


class Model:
    """weights of sorted feature codes, and the bias."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float):
        self.codes, self.weights, self.bias = codes, weights, bias

    def logits(self, col: pa.Array) -> np.ndarray:
        out = np.full(len(col), self.bias)
        words = Words(col, letters_only=True)
        if not len(self.codes) or not words.n:
            return out
        index, distinct = words.encoded()
        codes = features(distinct)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        hit = known.any(axis=1)
        told = np.flatnonzero(hit[index])
        rows = np.repeat(np.arange(len(col)), words.per_row)[told]
        both = (rows[:, None] << 32) | at[index[told]]
        both = np.unique(both[known[index[told]]])
        return out + np.bincount(both >> 32, self.weights[both & 0xFFFFFFFF], len(col))

    def scores(self, col: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(col), -40, 40)))


def _sparse(rows: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    at = np.minimum(np.searchsorted(codes, flat), max(len(codes) - 1, 0))
    known = codes[at] == flat if len(codes) else np.zeros(len(flat), bool)
    return row[known], at[known]


def fit(rows: list[np.ndarray], labels: np.ndarray, swapped: list[tuple[int, np.ndarray]] = (), steps: int = 600) -> Model:
    """Fit on the feature codes of labelled rows; swapped: (row, features of a counterfactual of it)."""
    labels = np.asarray(labels, float)
    n, n_pos = len(labels), int(labels.sum())
    if not n or n_pos in (0, n):
        share = (n_pos + 0.5) / (n + 1) if n else 0.01
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    codes, at = np.unique(np.concatenate(rows), return_inverse=True)
    pos = np.bincount(at, labels[row], len(codes))
    neg = np.bincount(at, 1 - labels[row], len(codes))
    codes = _best(codes, pos, neg, n_pos, n - n_pos)
    r, c = _sparse(rows, codes)
    # counterfactual differences: observed swaps, and terms put in or swapped within a group
    pairs: list[tuple[np.ndarray, np.ndarray]] = [(rows[i], f) for i, f in swapped]
    term = {t: row_features(pa.array([t]))[1] for g in (*IDENTITY_GROUPS, (NEUTRAL,)) for t in g}
    for g in IDENTITY_GROUPS:
        pairs += [(term[t], term[u]) for t, u in zip(g, g[1:] + g[:1], strict=True)] + [(term[t], term[NEUTRAL]) for t in g] + [(term[t], np.zeros(0, np.uint32)) for t in g]
    ra, ca = _sparse([a for a, _ in pairs], codes)
    rb, cb = _sparse([b for _, b in pairs], codes)
    rd, cd, vd = np.concatenate([ra, rb]), np.concatenate([ca, cb]), np.concatenate([np.ones(len(ra)), -np.ones(len(rb))])
    k = len(codes)
    w, bias = np.zeros(k), float(np.log(n_pos / (n - n_pos)))
    weight = np.where(labels > 0, 0.5 / n_pos, 0.5 / (n - n_pos)) * 0.5 + 0.5 / n
    # accelerated proximal steps; the step is set by a bound on the curvature (power iteration)
    v = np.ones(k) / max(k, 1) ** 0.5
    for _ in range(30):
        u = np.bincount(c, weight[r] * np.bincount(r, v[c], n)[r], k) * 0.25 + 2 * COUNTERFACTUAL_WEIGHT / len(pairs) * np.bincount(cd, vd * np.bincount(rd, vd * v[cd], len(pairs))[rd], k)
        top = float(np.linalg.norm(u))
        v = u / top if top else v
    rate = 1 / (1.2 * top + 0.3)
    z, zb, t = w.copy(), bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, z[c], n) + zb, -40, 40)))
        err = weight * (p - labels)
        drift = np.bincount(rd, vd * z[cd], len(pairs))
        grad = np.bincount(c, err[r], k) + 2 * COUNTERFACTUAL_WEIGHT / len(pairs) * np.bincount(cd, vd * drift[rd], k) + RIDGE * z
        new = z - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        nb, nt = zb - rate * err.sum(), (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = new, nb, nt
    kept = w != 0
    return Model(codes[kept], w[kept], float(bias))


def labelled_features(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit a model on a bounded, deterministic sample of the labelled rows for which train (a condition on docs) holds.

    At most max_labelled rows, one of each id and text, whole texts. Features are counted where the sample is, and only
    the MAX_FEATURES best of each row come to the driver.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    rows = docs.where(train).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"))
    # the ids with the smallest hashes, then the rows that have them: an id may repeat
    some = marks.join(rows.select("__id").distinct(), "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(max_labelled)
    sample = bounded_rows(rows.join(F.broadcast(some), "__id"), max_labelled, "__id", "__t").select("__t", "__label").checkpoint()
    n, n_pos = sample.agg(F.count(F.lit(1)), F.sum("__label")).first()
    if not n or n_pos in (0, n):
        return fit([np.zeros(0, np.uint32)] * n, np.full(n, 1.0 if n_pos else 0.0))

    def count(batches):
        for batch in batches:
            col, label = as_strings(batch.column(0)), batch.column(1).to_numpy()
            for a, b in spans(col, 1 << 20):
                row, code = row_features(col[a:b])
                u, at = np.unique(code, return_inverse=True)
                pos = np.bincount(at, label[a:b][row], len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(pos), pa.array(np.bincount(at, minlength=len(u)).astype(np.int64) - pos)], ["code", "pos", "neg"])
        give_back()

    counted = sample.mapInArrow(count, "code long, pos long, neg long").groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    part = lambda k, n, p: k * F.log(F.greatest(k, F.lit(1e-9)) / F.greatest(F.lit(n) * p, F.lit(1e-9)))
    pos, neg, share = F.col("pos"), F.col("neg"), (F.col("pos") + F.col("neg")) / F.lit(n)
    gain = 2 * (part(pos, n_pos, share) + part(n_pos - pos, n_pos, 1 - share) + part(neg, n - n_pos, share) + part(n - n_pos - neg, n - n_pos, 1 - share))
    # fit() picks among these by the same measure; a little slack covers rounding
    told = counted.withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN - 1e-6).orderBy(F.desc("gain"), "code").limit(2 * MAX_FEATURES).select("code").toArrow()
    wanted = np.sort(told["code"].to_numpy().astype(np.uint32))
    swap = IdentitySwap()

    def run(batches):
        for batch in batches:
            col, marks = as_strings(batch.column(0)), batch.column(1).to_pylist()
            for a, b in spans(col, 1 << 20):
                texts, owner, kind = [], [], []
                for i, t in enumerate(col[a:b].to_pylist()):
                    for k, x in enumerate([t, *swap.variants(t)]):
                        texts.append(x)
                        owner.append(a + i)
                        kind.append(k)
                row, code = row_features(pa.array(texts, pa.string()))
                known = np.isin(code, wanted)
                row, code = row[known], code[known]
                bounds = np.searchsorted(row, np.arange(len(texts) + 1))
                yield pa.RecordBatch.from_arrays([
                    pa.array([marks[o] for o in owner], pa.int32()), pa.array([code[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), pa.array(kind, pa.int32()),
                ], ["label", "codes", "kind"])
        give_back()

    got = sample.mapInArrow(run, "label int, codes binary, kind int").toArrow()
    rows_, labels_, swapped = [], [], []
    for label, codes, kind in zip(*(got[c].to_pylist() for c in ("label", "codes", "kind")), strict=True):
        f = np.frombuffer(codes, np.uint32)
        if kind:
            swapped.append((len(rows_) - 1, f))
        else:
            rows_.append(f)
            labels_.append(label)
    return fit(rows_, np.array(labels_, float), swapped)


def toxicity(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id [, columns named in carry], score double): the probability that a text is toxic.

    train: a condition on docs that says which rows may teach. Null texts score like empty ones; an empty table
    gives no rows; without usable labels every text gets the same low score. Repeated ids in labels count
    once, as toxic if any says so. Only the text is an input of a score.
    """
    arrow_limits(docs.sparkSession)
    model = labelled_features(docs, labels, train, id_col, text_col, label_col, max_labelled)
    codes, weights, bias = model.codes, model.weights, model.bias
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c == id_col or c in carry)
    names = [c for c in docs.columns if c == id_col or c in carry]

    def run(batches):
        scorer = Model(codes, weights, bias)
        for batch in batches:
            col = as_strings(batch.column(batch.num_columns - 1))
            scores = [scorer.scores(col[a:b]) for a, b in spans(col, 1 << 20)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, "__score"])
        give_back()

    return docs.select(*(F.col(c) for c in names), F.col(text_col).cast("string").alias("__t")).mapInArrow(run, fields + ", __score double").withColumnRenamed("__score", "score")


def accepted(docs: DataFrame, labels: DataFrame, train=None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; every labelled row may teach unless train says otherwise.

    Null and empty texts score like texts of no known word; repeated rows are judged alike; rows without an id are judged too;
    an empty table stays empty, and without usable labels every row stays.
    """
    arrow_limits(docs.sparkSession)
    model = labelled_features(docs, labels, F.lit(True) if train is None else train, id_col, text_col, label_col, max_labelled)
    codes, weights, bias = model.codes, model.weights, model.bias
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Model(codes, weights, bias)
        for batch in batches:
            col = as_strings(batch.column(at))
            scores = [scorer.scores(col[a:b]) for a, b in spans(col, 1 << 20)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < threshold))
        give_back()

    return docs.mapInArrow(run, docs.schema)
