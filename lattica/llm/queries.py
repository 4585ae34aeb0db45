"""The queries ``opN_<name>`` and ``pipeline``: the operators on their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lattica.llm import bpe, decontam, htmltext, langid, merkle, neardup, pipeline, quality, repair, sharding, substring, topk, toxicity, urltree
from lattica.llm.sampling import crc_share

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    share = crc_share("doc_id", 4)
    model = langid.learn(docs.filter(share != 2).select("doc_id", "text", "lang"))
    out = langid.predict(docs, model)
    return out.select("doc_id", (share == 2).alias("held_out"), "lang_pred", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS)
    placed = sharding.assign_shards(placed, "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    return sharding.number_slots(placed).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    share = crc_share("doc_id", 3)
    model = toxicity.learn(docs.filter(share != 1), _table(spark, sf_dir, "labels").filter(share != 1))
    return toxicity.score(docs, model).select("doc_id", (share == 1).alias("held_out"), "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words_per_shingle=3, num=85, den=100)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fields = lambda n_chars: merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang")], n_chars, F.col("text"))
    changed = F.coalesce(crc_share("doc_id", 7) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    rows = docs.select("doc_id", "lang", fields(F.col("n_chars")).alias("leaf"), F.when(changed, fields(F.col("n_chars") + 1)).alias("tampered"))
    out = merkle.manifest(rows, "lang", "doc_id", "leaf", ["doc_id", "tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("depleted"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words")


def _damaged(turns: DataFrame) -> DataFrame:
    """The rows with faults put in by what their keys hash to; nulls are one blank."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    found = repair.audits(_damaged(turns))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = turns.select("conv_id").distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["conv"]), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        op1_language_id, op2_sharding, op3_bpe, op4_decontamination, op5_toxicity,
        op6_near_duplicates, op7_html_text, op8_top_k, op9_substring_dedup, op10_url_filter, op11_merkle_manifest, op12_quality_rules, op13_conversation_repair,
    ]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


#: Exact neighbours by brute force; ties go to the smaller id.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: crc32 of a text ``s``, byte by byte (the texts here are ASCII), each by its eight bits.
CRC32_SQL = """xor(list_reduce(list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295)"""


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"


#: Trees climb level by level to (tree, level, pos); proofs walk up again from every leaf.
MERKLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, {"||".join(map(_field_sql, ("doc_id", "source", "lang")))} a, {_field_sql("text")} z FROM documents
), l AS (
  SELECT doc_id, coalesce('=' || lang, '') tree, sha256(a || {_field_sql("n_chars")} || z) leaf,
    CASE WHEN {CRC32_SQL.replace("(s,", "(doc_id::VARCHAR,")} % 7 = 0 AND n_chars IS NOT NULL THEN sha256(a || {_field_sql("n_chars + 1")} || z) END tampered FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 pos, count(*) OVER (PARTITION BY tree) n FROM l
), t AS (
  SELECT tree, 0 level, pos, leaf h, n FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, pos // 2
), s AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 pos, count(*) OVER () n FROM t WHERE n = 1
), r AS (
  SELECT 0 level, pos, h, n FROM s
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM r WHERE n > 1 GROUP BY level, pos // 2
), up AS (
  SELECT p.tree, p.pos AS leaf_pos, p.pos, 0 level, coalesce(tampered, leaf) folded, '' proof FROM p
  UNION ALL
  SELECT up.tree, leaf_pos, up.pos // 2, up.level + 1,
    sha256(CASE WHEN up.pos % 2 = 1 THEN b.h || folded ELSE folded || coalesce(b.h, '') END), proof || coalesce(b.h, '')
  FROM up JOIN t a ON a.tree = up.tree AND a.level = up.level AND a.pos = up.pos AND a.n > 1
  LEFT JOIN t b ON b.tree = up.tree AND b.level = up.level AND b.pos = xor(up.pos, 1::BIGINT)
), up2 AS (
  SELECT up.tree, leaf_pos, s.pos, 0 level, folded, proof FROM up JOIN t ON t.tree = up.tree AND t.level = up.level AND t.pos = up.pos AND t.n = 1 JOIN s ON s.tree = up.tree
  UNION ALL
  SELECT up2.tree, leaf_pos, up2.pos // 2, up2.level + 1,
    sha256(CASE WHEN up2.pos % 2 = 1 THEN b.h || folded ELSE folded || coalesce(b.h, '') END), proof || coalesce(b.h, '')
  FROM up2 JOIN r a ON a.level = up2.level AND a.pos = up2.pos AND a.n > 1
  LEFT JOIN r b ON b.level = up2.level AND b.pos = xor(up2.pos, 1::BIGINT)
)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(up2.proof) AS proof_sha256, up2.folded AS folded_root, up2.folded = r.h AS verified
FROM p JOIN up2 ON up2.tree = p.tree AND up2.leaf_pos = p.pos JOIN s ON s.tree = p.tree JOIN r ON r.n = 1 AND r.level = up2.level
"""


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
#: Words by position, windows by their three words, lines by what they say without case and digits.
QUALITY_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(text) print, coalesce(text, '') text, row_number() OVER () id FROM documents
), w AS (
  SELECT id, unnest({_WORDS.format("text")}) word, generate_subscripts({_WORDS.format("text")}, 1) place FROM d
), g AS (
  SELECT id, place, word, lead(word) OVER x AS w2, lead(word, 2) OVER x AS w3 FROM w WINDOW x AS (PARTITION BY id ORDER BY place)
), f AS (
  SELECT id, place, count(*) OVER (PARTITION BY id, word, w2, w3) times FROM g WHERE w3 IS NOT NULL
), c AS (
  SELECT id, count(DISTINCT place + k) n FROM f, range(3) r(k) WHERE times > 1 GROUP BY id
), l AS (
  SELECT id, source, print, unnest(string_split(text, chr(10))) line FROM d
), k AS (
  SELECT *, len({_WORDS.format("line")}) words,
    array_to_string({_WORDS.format("translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000')")}, ' ') says FROM l WHERE len({_WORDS.format("line")}) > 0
), u AS (
  SELECT id, sum(m - 1) n FROM (SELECT id, line, count(*) m FROM k GROUP BY 1, 2) GROUP BY 1
), o AS (
  SELECT source, count(DISTINCT print) texts FROM d WHERE len({_WORDS.format("text")}) > 0 GROUP BY 1
), b AS (
  SELECT k.source, says, count(DISTINCT print) texts FROM k GROUP BY 1, 2
), h AS (
  SELECT b.source, says FROM b JOIN o ON b.source IS NOT DISTINCT FROM o.source WHERE b.texts > greatest({float(quality.LEAST)}::DOUBLE, o.texts * {quality.SHARE}::DOUBLE)
), x AS (
  SELECT k.id, sum(words) n FROM k JOIN h ON h.says = k.says AND h.source IS NOT DISTINCT FROM k.source GROUP BY 1
), e AS (
  SELECT d.doc_id, len({_WORDS.format("text")}) n_words, length(array_to_string({_WORDS.format("text")}, '')) word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) n_symbols, coalesce(u.n, 0)::BIGINT n_dup_lines, coalesce(c.n, 0)::BIGINT n_repeat_words, coalesce(x.n, 0)::BIGINT n_common_words
  FROM d LEFT JOIN u USING (id) LEFT JOIN c USING (id) LEFT JOIN x USING (id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_common_words > 0 AND (n_common_words > n_words * {quality.DEPLETED}::DOUBLE OR n_words - n_common_words < {quality.LEFT})) AS kept FROM e
"""


#: From the last turn to the first the least cost behind each role (none, system, user, assistant), then from the first on the least letters.
REPAIR_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') says FROM conversations
), m AS (
  SELECT *, {CRC32_SQL.replace("(s,", "(says,")} % 20 kind FROM o
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text
  FROM m, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), p AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) c, row_number() OVER x - 1 i, left(role, 1) f, lead(left(role, 1)) OVER x g,
    sha256(strlen(role) || ':' || role || text) same, count(*) OVER (PARTITION BY conv_id) n
  FROM d WINDOW x AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text))
), q AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, same ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END fault FROM p
), k AS MATERIALIZED (
  SELECT *, CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END + CASE f WHEN 's' THEN 0 ELSE 1000000000 END s,
    CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END + CASE f WHEN 'u' THEN 0 ELSE 1 END u,
    CASE fault WHEN 't' THEN 5 WHEN '' THEN 0 ELSE 1000000000 END + CASE f WHEN 'a' THEN 0 ELSE 1 END a FROM q
), w AS (
  SELECT DISTINCT c, n i, 0::BIGINT w0, 10::BIGINT w1, 5::BIGINT w2, 0::BIGINT w3 FROM k
  UNION ALL
  SELECT k.c, k.i, least(2 + w0, s + w1, u + w2, 5 + a + w3), least(2 + w1, u + w2, 5 + a + w3), least(2 + w2, 5 + u + w2, a + w3), least(2 + w3, u + w2, 5 + a + w3)
  FROM w JOIN k ON k.c = w.c AND k.i = w.i - 1
), y AS MATERIALIZED (SELECT * FROM w), x AS (
  SELECT k.*, v.w0 v0, v.w1 v1, v.w2 v2, v.w3 v3, y.w0, y.w1, y.w2, y.w3,
    CASE f WHEN 'u' THEN 'K' ELSE 'R' END || '2' lu, CASE f WHEN 'a' THEN 'K' ELSE 'R' END || '3' la FROM k JOIN y ON y.c = k.c AND y.i = k.i JOIN y v ON v.c = k.c AND v.i = k.i + 1
), z AS MATERIALIZED (
  SELECT *, [CASE WHEN 2 + v0 = w0 THEN 'D0' ELSE list_min([CASE WHEN s + v1 = w0 THEN 'K1' END, CASE WHEN u + v2 = w0 THEN lu END, CASE WHEN 5 + a + v3 = w0 THEN 'I' || la END]) END,
    CASE WHEN 2 + v1 = w1 THEN 'D1' ELSE list_min([CASE WHEN u + v2 = w1 THEN lu END, CASE WHEN 5 + a + v3 = w1 THEN 'I' || la END]) END,
    CASE WHEN 2 + v2 = w2 THEN 'D2' ELSE list_min([CASE WHEN 5 + u + v2 = w2 THEN 'I' || lu END, CASE WHEN a + v3 = w2 THEN la END]) END,
    CASE WHEN 2 + v3 = w3 THEN 'D3' ELSE list_min([CASE WHEN u + v2 = w3 THEN lu END, CASE WHEN 5 + a + v3 = w3 THEN 'I' || la END]) END] best FROM x
), e AS (
  SELECT DISTINCT c, n, 0::BIGINT i, 0 state, '' audit, ''::VARCHAR body FROM z
  UNION ALL
  SELECT e.c, e.n, e.i + 1, right(best[state + 1], 1)::INTEGER, audit || left(best[state + 1], -1),
    body || CASE WHEN best[state + 1][1] = 'I' THEN CASE state WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END
    || CASE WHEN best[state + 1][1] = 'D' THEN '' WHEN contains(best[state + 1], 'K') THEN role || ':' || text || chr(10) WHEN right(best[state + 1], 1) = '2' THEN 'user:' || text || chr(10) ELSE 'assistant:' || text || chr(10) END
  FROM e JOIN z ON z.c = e.c AND z.i = e.i
), r AS (
  SELECT c, audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END audit,
    sha256(left(body || CASE state WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END, -1)) digest FROM e WHERE i = n
), t AS (
  SELECT conv_id, c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (fault = 'b') blank, count(*) FILTER (fault = 'd') duplicate,
    count(*) FILTER (fault = 't') truncated, count(*) FILTER (i < n - 1 AND f || g NOT IN ('su', 'ua', 'au')) illegal FROM k GROUP BY ALL
)
SELECT DISTINCT h.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(y.w0, 0) AS cost, coalesce(audit, '') audit, coalesce(digest, sha256('')) repaired_sha256
FROM conversations h LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN r ON r.c = t.c LEFT JOIN y ON y.c = t.c AND y.i = 0
"""


def oracle_sql() -> dict[str, str]:
    out = {"op8_top_k": TOP_K_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_quality_rules": QUALITY_SQL, "op13_conversation_repair": REPAIR_SQL}
    if pipeline.ORACLE_SQL is not None:
        out["pipeline"] = pipeline.ORACLE_SQL
    return out
