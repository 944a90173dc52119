"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.llm import alignment, chat, exact, jaccard, packing, pieces, qualityrules, ranking, repeats, resampling, secrets, sharding, topk
from echolens.llm.common import Scratch


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    carry = {"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    rows = sharding.shard_rows(read(spark, sf_dir, "documents"), shards=40, carry=carry)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(read(spark, sf_dir, "documents"), passages=repeats.WORDS)


def op3_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qualityrules.judged(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


#: Rows that the classifier never learns from.
HELD_OUT = "crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1"


def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ranking.train(docs, read(spark, sf_dir, "labels"), where=f"not ({HELD_OUT})")
    rows = ranking.scored(docs, model, ["doc_id"])
    return rows.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(read(spark, sf_dir, "conversations"))


def op10_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_report(read(spark, sf_dir, "documents"), Scratch(spark), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(read(spark, sf_dir, "documents"), Scratch(spark))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_ring_shards, op2_repeated_bytes, op3_cutting_stock_packing, op4_quality_rules,
        op5_ngram_jaccard_join, op6_exact_top_k, op7_secret_scan,
        op8_pairwise_quality, op9_perspective_rotation, op10_piece_ids,
        op11_token_alignment, op12_exact_dedup, op13_importance_resampling,
    )}


OP4_SQL = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8))),
r AS (SELECT doc_id, CAST(sum(least(8, coalesce(lead - i, 8))) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS lead FROM g WHERE n > 1) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(t) - length(regexp_replace(t, '[^ \t-\r]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    greatest(len(l), 1) AS n_lines, len(list_filter(w, lambda x: list_contains(STOPS, lower(x)))) AS n_stop_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{2022}]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[ \t\r]*$'))) AS n_cut_lines
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE KEEP END AS kept FROM f"""


def op4_sql() -> str:
    """The rule table once more, as SQL."""
    stops = "[" + ", ".join(f"'{w}'" for w in qualityrules.STOP_WORDS) + "]"
    sides = [f"({r.measure}) >= {r.low}" for r in qualityrules.RULES if r.low is not None] + [f"({r.measure}) <= {r.high}" for r in qualityrules.RULES if r.high is not None]
    return OP4_SQL.replace("STOPS", stops).replace("KEEP", "(" + " AND ".join(sides) + ")")


OP5_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS u, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
k AS (SELECT a, b FROM o WHERE 100 * i >= 75 * u),
r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY 1) ON a = s.doc_id"""

OP6_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p) WHERE n <= 10"""

OP9_SQL = """WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT t.*, perspective, CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS part_role,
    CASE WHEN role <> 'system' AND role <> perspective THEN role END AS part_name FROM t JOIN p ON p.conv_id = t.conv_id),
r AS (SELECT *, '<|' || part_role || coalesce(' name=' || part_name, '') || '|>' || chr(10) || x || '<|end|>' || chr(10) AS segment FROM s)
SELECT conv_id, perspective, turn, part_role, part_name, segment, CAST(part_role = 'assistant' AS INTEGER) AS mask,
    CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seg_start, CAST(length(segment) AS BIGINT) AS seg_chars FROM r"""


OP12_SQL = """WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS n, first(doc_id ORDER BY size DESC, doc_id) AS keep_id FROM t GROUP BY t)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(t.t) AS text_sha256 FROM t JOIN g ON g.t = t.t"""

#: The checksum of a word comes from a table of 256 remainders, each made by eight steps.
OP13_SQL = """WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)), CAST(i AS BIGINT))) AS r),
tokens AS (SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    UNION ALL SELECT 't', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
named AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM tokens)),
words AS (SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM named, step),
b AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM tokens JOIN words ON words.w = tokens.w GROUP BY 1),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM b),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((b.t + 1) * (z.s + 10000) AS DOUBLE) / CAST((b.s + 1) * (z.t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM b, z),
d AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM tokens JOIN words ON words.w = tokens.w JOIN g ON g.bucket = words.bucket WHERE side = 'd' GROUP BY 1),
f AS (SELECT documents.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM f),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS n, count(*) OVER () AS total FROM x WHERE n_features >= 20)
SELECT x.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN o.n <= total * 10 // 100 THEN o.n END AS rank FROM x LEFT JOIN o ON o.doc_id = x.doc_id"""


def llm_oracles() -> dict[str, str]:
    """SQL twins where SQL can say the same; the others are tested against brute force."""
    return {"op4_quality_rules": op4_sql(), "op5_ngram_jaccard_join": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op9_perspective_rotation": OP9_SQL,
            "op12_exact_dedup": OP12_SQL, "op13_importance_resampling": OP13_SQL}
