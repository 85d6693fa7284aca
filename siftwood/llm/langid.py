"""Language identification as inference in a mixture of languages.

Each learned language has a conditional byte-trigram model of words. A document is taken as words drawn from a
mixture of languages; expectation-maximisation estimates its proportions, and languages leave the mixture while
the penalised likelihood (half the logarithm of the number of words for each language kept) does not fall.
N-gram counts cover all training texts; what is collected is bounded by languages times hash buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, arrow_limits, as_strings, ragged, row_sums, spans

TRIGRAM_BITS = 16
SMOOTHING = 0.5
ROUNDS = 12
UNKNOWN = "und"
_TRIGRAMS, _BIGRAMS = 1 << TRIGRAM_BITS, 1 << 16


def _grams(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each byte from the third, and of the bigram before it."""
    b = joined.astype(np.uint32)
    pair = (b[:-2] << 8) | b[1:-1]
    with np.errstate(over="ignore"):
        tri = (((pair << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)
    return tri, pair


def _lettered(distinct: pa.Array) -> np.ndarray:
    """Which words have a letter (a-z or anything beyond ASCII)."""
    return pc.match_substring_regex(distinct.cast(pa.string()), r"\pL").to_numpy(zero_copy_only=False)


def train(docs: DataFrame, condition, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, trigram counts, bigram counts) over all texts with a language for which condition holds."""

    def count(batches):
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            col, langs = as_strings(batch.column(0)), batch.column(1).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for a, b in spans(col):
                words = Words(col[a:b])
                if not words.n:
                    continue
                joined, starts = words.joined()
                joined = np.concatenate([[np.uint8(32)], joined])  # a space before and after every word
                tri, pair = _grams(joined)
                # gram i belongs to the word of byte i + 1 of the padded text
                of = np.repeat(np.repeat(code[a:b], words.per_row), np.diff(starts))[:-1]
                here = np.flatnonzero(np.concatenate([joined[1:-1] != 32]))
                for k in np.unique(of):
                    some = here[of[here] == k]
                    table = tables.setdefault(names[k], np.zeros(_TRIGRAMS + _BIGRAMS, np.int64))
                    table[:_TRIGRAMS] += np.bincount(tri[some], minlength=_TRIGRAMS)
                    table[_TRIGRAMS:] += np.bincount(pair[some], minlength=_BIGRAMS)
        for name, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["lang", "bucket", "n"])

    texts = docs.where(condition).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = texts.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(count, "lang string, bucket int, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    table = np.zeros((len(names), _TRIGRAMS + _BIGRAMS), np.float32)
    if names:
        row = pc.index_in(got["lang"], pa.array(names)).to_numpy()
        table[row, got["bucket"].to_numpy()] = got["n"].to_numpy()
    return names, table[:, :_TRIGRAMS], table[:, _TRIGRAMS:]


def _single(per_word: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return row_sums(per_word.astype(np.float64), starts)


def mixture(likelihood: np.ndarray, starts: np.ndarray, support: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (rows x languages) and log-likelihoods of mixtures over the supported languages.

    likelihood: of each word (rows' words one after the other) under each language.
    """
    n = np.diff(starts)
    pi = support / np.maximum(support.sum(1, keepdims=True), 1)
    total = np.zeros(len(n))
    active = np.flatnonzero(n > 0)
    for turn in range(rounds + 1):
        if not len(active):
            break
        if len(active) < len(n):
            some, bounds = ragged(starts[:-1][active], n[active]), np.concatenate([[0], np.cumsum(n[active])])
            part = likelihood[some]
        else:
            part, bounds = likelihood, starts
        joint = part * np.repeat(pi[active], n[active], axis=0)
        sums = joint.sum(1, keepdims=True)
        total[active] = row_sums(np.log(sums[:, 0].astype(np.float64)), bounds)
        if turn == rounds:
            break
        new = row_sums(joint / sums, bounds) / n[active][:, None]
        moved = np.abs(new - pi[active]).max(1) > 2e-3
        pi[active] = new
        active = active[moved]
    return pi, total


class Identifier:
    def __init__(self, names: list[str], tri: np.ndarray, pair: np.ndarray):
        self.names = names
        self.tri = np.ascontiguousarray(np.log(tri + SMOOTHING).T.astype(np.float32))
        self.pair = np.ascontiguousarray(np.log(pair + SMOOTHING * 64).T.astype(np.float32))

    def word_scores(self, distinct: pa.Array) -> np.ndarray:
        """Log-likelihood of each distinct word under each language."""
        offsets = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        lengths = np.diff(offsets)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined = np.full(starts[-1] + 1, 32, np.uint8)
        joined[1 + ragged(starts[:-1], lengths)] = np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        tri, pair = _grams(joined)
        scores = self.tri[tri] - self.pair[pair]
        ends = np.concatenate([starts[:-1], [len(tri)]])
        # the last word's final byte has its trigram; gram starts[i] + lengths[i] would cross into the next word
        cross = starts[1:-1] - 1
        scores[cross] = 0
        return np.add.reduceat(scores, ends[:-1], axis=0)

    def __call__(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, proportions) of every row."""
        letters = pc.match_substring_regex(col, r"\pL").to_numpy(zero_copy_only=False)
        count = len(self.names)
        if not count or not len(col):
            return [UNKNOWN] * len(col), np.zeros(len(col)), np.zeros((len(col), count))
        words = Words(col)
        if not words.n:
            return [UNKNOWN] * len(col), np.zeros(len(col)), np.zeros((len(col), count))
        index, distinct = words.encoded()
        per_word = self.word_scores(distinct)
        told = _lettered(distinct)
        use = told[index]
        n = row_sums(use.astype(np.int64), words.row_starts())
        index = index[use]
        starts = np.concatenate([[0], np.cumsum(n)])
        single = _single(per_word[index], starts)
        best = single.max(1)
        top = per_word.max(1, keepdims=True)
        # far below the best language a word says the same however far; this keeps the sums in range
        scaled = np.exp(np.maximum(per_word - top, -30.0)).astype(np.float32)
        offset = row_sums(top[index, 0].astype(np.float64), starts)
        full = np.ones((len(col), count))
        pi, total = mixture(scaled[index], starts, full)
        penalty = 0.5 * np.log(np.maximum(n, 2))
        support = pi >= 1 / np.maximum(n, 20)[:, None]
        support[np.arange(len(col)), single.argmax(1)] = True
        kept = support.copy()
        value = total + offset - penalty * (count - 1)
        # the mixture without negligible languages, then without the least one, as long as that pays
        trial = support
        pending = np.flatnonzero(n > 0)
        for step in range(count):
            if not len(pending):
                break
            some, bounds = ragged(starts[:-1][pending], n[pending]), np.concatenate([[0], np.cumsum(n[pending])])
            p, t = mixture(scaled[index[some]], bounds, trial[pending].astype(float))
            v = t + offset[pending] - penalty[pending] * (trial[pending].sum(1) - 1)
            better = (v >= value[pending]) | (step == 0)
            won = pending[better]
            pi[won], value[won], kept[won] = p[better], v[better], trial[won]
            trial = kept.copy()
            pending = won[kept[won].sum(1) > 1]
            least = np.where(kept[pending], pi[pending], np.inf).argmin(1)
            trial[pending, least] = False
        # one language alone
        alone = best >= value
        pi[alone] = np.eye(count)[single[alone].argmax(1)]
        pick = pi.argmax(1)
        known = letters & (n > 0)
        # letters only in words that no trigram covers cannot be: n counts every word with a letter
        pi[~known] = 0
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(pick, known, strict=True)], np.where(known, np.minimum(pi[np.arange(len(col)), pick], 1.0), 0.0), pi


def identify(docs: DataFrame, condition, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = (), proportions: bool = False) -> DataFrame:
    """(id [, carried columns], lang_pred, score [, proportions map]) per row, learned from the rows for which condition holds.

    Null texts and texts without a letter are 'und' with score 0, as is all if nothing was learned. Rows with equal
    ids are scored each; an empty table gives no rows; only the text is an input of a prediction.
    """
    arrow_limits(docs.sparkSession)
    names, tri, pair = train(docs, condition, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast((names, tri, pair))
    kept = [c for c in docs.columns if c == id_col or c in carry]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in kept) + ", lang_pred string, score double" + ", proportions map<string, double>" * proportions

    def run(batches):
        model = Identifier(*shared.value)
        for batch in batches:
            col = as_strings(batch.column(batch.num_columns - 1))
            preds, scores, shares = [], [], []
            for a, b in spans(col):
                p, s, pi = model(col[a:b])
                preds += p
                scores.append(s)
                shares += [[(k, float(v)) for k, v in zip(model.names, row, strict=True) if v > 0] for row in pi] if proportions else []
            arrays = [*batch.columns[:-1], pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            arrays += [pa.array(shares, pa.map_(pa.string(), pa.float64()))] if proportions else []
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "lang_pred", "score", *["proportions"] * proportions])

    return docs.select(*(F.col(c) for c in kept), F.col(text_col).cast("string").alias("__t")).mapInArrow(run, schema)
