"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, embed_dedup, langid, lm, merkle, mixing, packing, pii, repair, simhash, toxicity
from .textkit import read


def _remainder(modulus: int):
    """crc32 of doc_id as text (none: empty), modulo modulus."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), _remainder(4) != 2)
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(read(spark, sf_dir, "documents"), columns=("doc_id", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.col("__probability").alias("probability"), F.col("__kept").alias("kept"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98).withColumnRenamed("id", "vec_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(read(spark, sf_dir, "documents"), _remainder(7) != 2)
    return scored.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(read(spark, sf_dir, "documents"), _remainder(5) != 0)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.checked(pii.pseudonymised(read(spark, sf_dir, "documents"), pii.key_of(spark)))
    kinds = F.transform("__entities", lambda e: e["kind"])
    return replaced.select("doc_id", "text", F.size("__entities").alias("n_entities"), kinds.alias("kinds"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(read(spark, sf_dir, "conversations"), damage=True).withColumnRenamed("conv", "conv_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = merkle.documents_manifest(read(spark, sf_dir, "documents"), tampered=_remainder(3) == 0)
    return proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trips(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (
        op1_toxicity, op2_best_fit_packing, op3_simhash_near_dedup, op4_nearest_neighbours, op5_mixing, op6_chat_format,
        op7_embedding_near_dedup, op8_lm_scoring, op9_language_id, op10_pii_surrogates,
        op11_conversation_repair, op12_merkle_manifest, op13_byte_bpe, pipeline,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_nearest_neighbours": OP4_SQL, "op6_chat_format": OP6_SQL, "op7_embedding_near_dedup": OP7_SQL, "op11_conversation_repair": op11_sql(), "op12_merkle_manifest": OP12_SQL}


_VECTORS = """
vecs AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""

OP4_SQL = f"""
WITH {_VECTORS}, pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP7_SQL = f"""
WITH RECURSIVE {_VECTORS}, links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), groups AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, g.component_id, e.vec_id = g.component_id AS kept
FROM embeddings e JOIN groups g ON g.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""

OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marks(role, opened, closed) AS (VALUES ('system', '<<SYS>>', '<</SYS>>'), ('user', '[INST]', '[/INST]'), ('assistant', '<s>', '</s>')),
sized AS (
  SELECT t.*,
    length(regexp_replace(t.role, '[\\<\[]', 'xx', 'g')) AS role_chars, length(regexp_replace(t.text, '[\\<\[]', 'xx', 'g')) AS escaped_chars,
    m.opened, m.closed, position(m.closed IN t.text || m.closed) = length(t.text) + 1 AS plain
  FROM turns t LEFT JOIN marks m ON m.role = t.role
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(CASE WHEN opened IS NULL THEN length('[ROLE!][TEXT][/ROLE]') + role_chars + escaped_chars
    WHEN plain THEN length(opened) + length(text) + length(closed)
    ELSE length(opened) + 1 + escaped_chars + length(closed) END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# CRC-32 of short ASCII strings: the table of the reflected polynomial, and a fold over the characters
_CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs
)"""


def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1])))"


def op11_sql() -> str:
    """Turn by turn, the cheapest way into each state of the grammar with its audit and repaired turns; inserts are closed before each turn."""

    def way(p: str, cost: str, edit: str, said: str | None) -> str:
        t = f"{p}.t" if said is None else f"CASE WHEN {p}.t IS NULL THEN {said} ELSE {p}.t || chr(10) || {said} END"
        return f"CASE WHEN {p} IS NOT NULL THEN {{'c': {p}.c + {cost}, 'a': {p}.a || '{edit}', 't': {t}}} END"

    def only(condition: str, value: str) -> str:
        return f"CASE WHEN {condition} THEN {value} END"

    gone = lambda p: way(p, "2", "D", None)
    kept = lambda p, initial: only(f"NOT must_go AND initial = '{initial}'", way(p, "more", "K", "role || ':' || text"))
    named = lambda p, role: only("NOT must_go", way(p, "1 + more", "R", f"'{role}:' || text"))
    user, assistant = (lambda p: way(p, "5", "I", "'user:'")), (lambda p: way(p, "5", "I", "'assistant:'"))
    closed = f"""SELECT *, list_min([p3, {assistant("q2")}]) AS q3 FROM (SELECT *, list_min([p2, {user("p0")}, {user("p1")}, {user("p3")}]) AS q2 FROM ways)"""
    users = ", ".join([*(kept(p, "u") for p in ("p0", "p1", "q3")), *(named(p, "user") for p in ("p0", "p1", "q3"))])
    kind = "STRUCT(c INTEGER, a VARCHAR, t VARCHAR)"
    return f"""
WITH RECURSIVE {_CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations, crc_table
), hurt AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS k, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM given WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+\\z', '') AS body
  FROM hurt
), faults AS (
  SELECT *, body = '' AS is_blank, body <> '' AND again AS is_again, body <> '' AND NOT again AND NOT contains('.!?', right(body, 1)) AS is_cut,
    coalesce(lag(initial) OVER (PARTITION BY k ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS is_illegal
  FROM placed
), turns AS (
  SELECT k, i, role, text, initial, is_blank OR is_again AS must_go, CASE WHEN is_cut THEN 5 ELSE 0 END AS more FROM faults
), told AS (
  SELECT k, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again) AS duplicate,
    count(*) FILTER (is_cut) AS truncated, count(*) FILTER (is_illegal) AS illegal, count(*) AS n
  FROM faults GROUP BY k
), ways(k, i, p0, p1, p2, p3) AS (
  SELECT k, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 't': NULL}} AS {kind}), CAST(NULL AS {kind}), CAST(NULL AS {kind}), CAST(NULL AS {kind}) FROM told
  UNION ALL
  SELECT w.k, t.i, {gone("p0")}, list_min([{gone("p1")}, {kept("p0", "s")}]), list_min([{gone("q2")}, {users}]), list_min([{gone("q3")}, {kept("q2", "a")}, {named("q2", "assistant")}])
  FROM ({closed}) w JOIN turns t ON t.k = w.k AND t.i = w.i + 1
), ends AS (
  SELECT w.k, list_min([p0, q3]) AS best FROM ({closed}) w JOIN told ON told.k = w.k AND told.n = w.i
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.k = coalesce(CAST(o.conv_id AS VARCHAR), '') LEFT JOIN ends ON ends.k = told.k
"""


def _leaf_sql(text: str) -> str:
    told = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END"
    return "sha256(" + " || ".join(told(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"


OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, given AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_crc("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS seen
  FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM given
), nodes(g, level, idx, n, h) AS (
  SELECT g, 0, idx, n, leaf FROM leaves
  UNION ALL SELECT g, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY g, level, idx // 8, n
), runs AS (SELECT g, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
walks(g, leaf_at, level, idx, h, proof) AS (
  SELECT g, idx, 0, idx, seen, '' FROM leaves
  UNION ALL
  SELECT w.g, leaf_at, w.level + 1, w.idx // 8, sha256(array_to_string(hs[1 : w.idx % 8], '') || w.h || array_to_string(hs[w.idx % 8 + 2 :], '')),
    proof || array_to_string(hs[1 : w.idx % 8], '') || array_to_string(hs[w.idx % 8 + 2 :], '')
  FROM walks w JOIN runs r ON r.g = w.g AND r.level = w.level AND r.run = w.idx // 8
), tops AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
top_nodes(level, idx, n, h) AS (
  SELECT 0, idx, n, subroot FROM tops
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top_nodes WHERE n > 1 GROUP BY level, idx // 8, n
), top_runs AS (SELECT level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM top_nodes WHERE n > 1 GROUP BY ALL),
arrived AS (SELECT g, leaf_at, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM walks GROUP BY g, leaf_at),
top_walks(g, leaf_at, level, idx, h, proof) AS (
  SELECT a.g, leaf_at, 0, t.idx, a.h, proof FROM arrived a JOIN tops t ON t.g = a.g
  UNION ALL
  SELECT w.g, leaf_at, w.level + 1, w.idx // 8, sha256(array_to_string(hs[1 : w.idx % 8], '') || w.h || array_to_string(hs[w.idx % 8 + 2 :], '')),
    proof || array_to_string(hs[1 : w.idx % 8], '') || array_to_string(hs[w.idx % 8 + 2 :], '')
  FROM top_walks w JOIN top_runs r ON r.level = w.level AND r.run = w.idx // 8
), proved AS (SELECT g, leaf_at, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM top_walks GROUP BY g, leaf_at)
SELECT l.doc_id, l.leaf, t.subroot, r.h AS root, p.proof_sha256, p.folded_root, p.folded_root = r.h AS verified
FROM leaves l JOIN tops t ON t.g = l.g JOIN proved p ON p.g = l.g AND p.leaf_at = l.idx JOIN top_nodes r ON r.n = 1
"""
