"""Conversation repair, Merkle manifests and byte-level BPE against plain versions, and their handling of odd tables."""

import base64
import hashlib
import itertools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwood.llm import bpe, merkle, repair

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ repair


def plain_repair(codes):
    """Relaxes all states turn by turn, with whole audits as keys."""
    best = {0: (0, "")}

    def put(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def inserts(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                put(table, 3 if state == 2 else 2, (cost + 5, audit + "I"))

    for code in codes:
        inserts(best)
        after = {}
        for state, (cost, audit) in best.items():
            put(after, state, (cost + 2, audit + "D"))
            if code != "x":
                more = 5 if code.isupper() else 0
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(code.lower(), {}).get(state)
                if to is not None:
                    put(after, to, (cost + more, audit + "K"))
                put(after, 3 if state == 2 else 2, (cost + 1 + more, audit + "R"))
        best = after
    inserts(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_cheapest_edits_of_all_short_conversations():
    for n in range(4):
        for codes in map("".join, itertools.product(repair.CODES, repeat=n)):
            assert repair.cheapest(codes) == plain_repair(codes), codes


def test_long_conversations_are_searched_block_by_block(monkeypatch):
    rng = random.Random(5)
    many = ["".join(rng.choice(repair.CODES if rng.random() < 0.5 else "uauaUA") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for block in (1, 2, 7):
        monkeypatch.setattr(repair, "BLOCK", block)
        for codes in many:
            assert repair._cheapest(codes) == plain_repair(codes), (block, codes)
    monkeypatch.undo()
    codes = "".join(rng.choice("uauaUAsox") for _ in range(3000))
    assert repair.cheapest(codes) == plain_repair(codes)


def test_repaired_turns(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Hi!"), (1, 3, "assistant", "Yes."),
        (2, 0, "assistant", "Only this."), (3, None, None, None), (4, 0, "user", "One."), (4, 7, "tool", "Two?"),
        (None, 1, "user", "Q?"), (None, 2, "assistant", "A."),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(repair.repaired(turns).collect(), key=lambda r: (r["conv_id"] or 0, r["turn"])):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {1: [("system", "Be kind."), ("user", "Hi!"), ("assistant", "Yes.")], 4: [("user", "One."), ("assistant", "Two?")], None: [("user", "Q?"), ("assistant", "A.")]}
    told = {r["conv"]: r for r in repair.digests(turns).collect()}
    assert [told[1][c] for c in (*repair.COUNTS, "audit")] == [0, 0, 1, 0, 1, 2, "KKDK"] and told[1]["repaired_sha256"] == sha("system:Be kind.\nuser:Hi!\nassistant:Yes.")
    assert [told[2][c] for c in ("cost", "audit", "repaired_sha256")] == [2, "D", sha("")]
    assert [told[3][c] for c in (*repair.COUNTS, "audit")] == [0, 1, 0, 0, 0, 2, "D"] and [told[4][c] for c in ("gaps", "illegal", "cost", "audit")] == [6, 1, 1, "KR"]


def test_damage_of_odd_conversations(spark):
    ddl = "conv_id long, turn long, role string, text string, conv string, n string, head int, h string, code string, fate int"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}.") for c in range(30) for t in range(6)]
    rows += [(None, None, None, None)] * 3 + [(77, 1, "user", "a" * 300_000), (77, 1, "user", "a" * 300_000), (77, 2, "assistant", "\x0b \t"), (78, 0, "Ünknown", "ß. "), (78, 0, "", "!")]
    turns = spark.createDataFrame([(*r, "c", "n", 1, "h", "x", 9) for r in rows], ddl)
    got = {r["conv"]: r for r in repair.digests(turns, damage=True).collect()}
    assert set(got) == {None, 77, 78, *range(30)} and len(got) == repair.digests(turns, damage=True).count()
    want = {}
    import zlib

    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or " ").encode()).hexdigest())):
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        said = (" " if role is None else role, " " if text is None else text)
        said = (said[0], "") if fate == 1 else (said[0], "".join(x for x in said[1] if x not in ".!?")) if fate == 2 else ("user", said[1]) if fate == 4 else said
        want.setdefault(c, []).extend([said] * (0 if fate == 0 else 2 if fate == 3 else 1))
    for c, turns_of in want.items():
        codes, seen, blank, again, cut = "", set(), 0, 0, 0
        for role, text in turns_of:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            if not body:
                codes, blank = codes + "x", blank + 1
            elif (role, text) in seen:
                codes, again = codes + "x", again + 1
            else:
                code = role[:1] if role[:1] in ("s", "u", "a") else "o"
                cut += body[-1] not in ".!?"
                codes += code if body[-1] in ".!?" else code.upper()
            seen.add((role, text))
        cost, audit = plain_repair(codes)
        repaired = sha("\n".join(f"{r}:{t}" for r, t in repair.edits(audit, iter(turns_of))))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns_of))
        r = got[c]
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == (blank, again, cut, illegal, cost, audit, repaired), c
    empty = turns.where("false")
    assert repair.digests(empty, damage=True).count() == 0 and repair.digests(empty).count() == 0 and repair.repaired(empty).count() == 0


# ------------------------------------------------------------------ manifest


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, i):
    path = []
    for nodes in levels[:-1]:
        run = i - i % 8
        path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        i //= 8
    return path


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 100, 511, 513, 1000])
def test_fractal_traversal_of_a_block(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = plain_levels(leaves)
    assert merkle.levels_of(n) == len(levels) - 1 and merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]
    got = list(merkle.paths(leaves, len(levels) - 1))
    assert got == [plain_path(levels, i) for i in range(n)]
    assert all(merkle.folded(leaf, path) == levels[-1][0] and merkle.parsed_path(merkle.path_text(path)) == path for leaf, path in zip(leaves, got, strict=True))


def test_traversal_holds_few_nodes(monkeypatch):
    held = []
    add = merkle.Subtree.add

    def counted(self, node, level=0):
        add(self, node, level)
        held.append(sum(map(len, self.nodes.values())) + sum(map(len, self.open)))

    monkeypatch.setattr(merkle.Subtree, "add", counted)
    assert len(list(merkle.paths([sha(str(i)) for i in range(4096)], 4))) == 4096
    assert max(held) <= 2 * (64 + 8) + 8 * 4


@pytest.mark.parametrize("block_levels", [1, 4])
def test_manifest_equals_plain_trees(spark, block_levels):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "en", "en", "en", "de", "ß", "Z"]), f"Text {i}", None if i % 5 == 0 else "s", i, "leaf", "p") for i in range(700)]
    rows += [(None, "en", None, None, None, "x", "y"), (3, "en", "twice", "s", 1, "x", "y"), (3, "en", "twice", "s", 1, "x", "y"), (900, "lone", "", "", 0, "x", "y"), (901, "long", "Ab" * 100_000, "", 0, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string, n_chars long, leaf string, path string").repartition(3)
    tampered = F.col("doc_id") % 3 == 0
    got = merkle.documents_manifest(docs, tampered=tampered, block_levels=block_levels).collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, lower=False: sha("".join(map(enc, (r[0], r[3], r[1], r[4], r[2].lower() if lower and r[2] is not None else r[2]))))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in order}
    top = plain_levels([trees[g][-1][0] for g in order])
    want = []
    for k, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            path = plain_path(trees[g], i) + plain_path(top, k)
            changed = leaf(r, r[0] is not None and r[0] % 3 == 0)
            folded = merkle.folded(changed, path)
            want.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded, folded == top[-1][0], merkle.path_text(path)))
    names = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted(want, key=repr)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, lang string, text string, source string, n_chars long")
    (r,) = merkle.documents_manifest(one).collect()
    assert r["leaf"] == sha("1:1----") == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("") and r["path"] == "" and r["verified"]
    assert merkle.documents_manifest(one.where("false")).count() == 0


# ------------------------------------------------------------------ byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts():
    rng = random.Random(7)
    kinds = (lambda: rng.randrange(32, 127), lambda: rng.randrange(0x80, 0x500), lambda: rng.randrange(0x4E00, 0x5000), lambda: rng.choice([9, 10, 13, 32, 0x85, 0xA0, 0x1C, 0x3000]), lambda: rng.randrange(0x1F600, 0x1F640))
    texts = ["", " ", "\n\n  a", "aaaa" * 50, "x" * 5000, "日本語" * 300, "<|endoftext|>", "it's we'LL", "\x00\x1c\x85", "ab" * 2000, "é" * 100]
    return texts + ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(1, 200))) for _ in range(400)]


def encode_all(vocabulary, texts):
    got = [[] for _ in texts]
    for told, flat in vocabulary.runs(texts):
        at = 0
        for row, n in told:
            got[row] += flat[at : at + n].tolist()
            at += n
    return got


def test_perfect_hash_is_minimal(vocabulary):
    tokens = vocabulary.tokens.to_pylist()
    assert sorted(vocabulary.hash.slots(tokens).tolist()) == list(range(len(tokens)))
    for n in (0, 1, 2, 3, 50, 1000):
        keys = [str(i).encode() for i in range(n)]
        assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


def test_ids_equal_the_library(vocabulary, known, monkeypatch):
    texts = random_texts()
    want = [known.encode_ordinary(t) for t in texts]
    assert encode_all(vocabulary, texts) == want
    monkeypatch.setattr(bpe, "RUN", 50)
    monkeypatch.setattr(bpe, "CACHE", 20)
    assert encode_all(vocabulary, texts) == want


def test_columns_and_digests(spark, known):
    texts = [*random_texts(), None, "y" * 200_000, "long " * 60_000]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "i", "n") for i, t in enumerate(texts)] * 2, "doc_id long, text string, ids string, n_tokens string")
    coded = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "n_tokens", "ids"]
    back = bpe.decoded(coded, RANKS, public_tokenizers.PATTERN)
    for r in back.collect():
        assert r["ids"] == known.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    got = sorted((r["id"] is not None, r["id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trips(docs, RANKS, public_tokenizers.PATTERN).collect())
    import numpy as np

    want = []
    for i, t in enumerate(texts):
        ids = known.encode_ordinary(t or "")
        want += [(bool(i % 50), i if i % 50 else 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or ""))] * 2
    assert got == sorted(want)
    assert bpe.round_trips(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception, match="no token"):
        bpe.decoded(spark.createDataFrame([([70_000],)], "ids array<bigint>"), RANKS, public_tokenizers.PATTERN).collect()
