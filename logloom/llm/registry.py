"""The queries opN_<name> over the whole tables, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, exact_dedup, html_text, jaccard, lines, media, merkle, mixing, pieces, quality, substring_dedup, toxicity, vector_codes
from .labelled import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.strip_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_quality_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: fold(c, 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", held)
    out = docs.select("doc_id", held(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.encode(docs).withColumn("decoded", pieces.decode(F.col("tokens")))
    return out.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.sha2(F.concat_ws(",", F.transform("tokens", lambda t: t.cast("string"))), 256).alias("tokens_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op9_toxicity_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda c: fold(c, 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", held)
    out = docs.select("doc_id", held(F.col("doc_id")).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    made = chat.format_conversations(turns.unionByName(probe))
    read = made.select("conv_id", chat.parse_formatted(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"), F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens")
    digest = F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["body"], F.lit("\n"))), ""), 256)
    return read.select("conv_id", F.size("back").cast("bigint").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_attachments", "expanded_tokens")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    shown = merkle.leaf_hash([tampered if f == "text" else F.col(f) for f in merkle.FIELDS])
    leaves = merkle.manifest(table(spark, sf_dir, "documents"), carry={"shown": shown})
    out = leaves.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(F.col("segments")).alias("proof_sha256"), merkle.fold(F.col("shown"), F.col("segments")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"), carry=["label"])
    rows = vector_codes.with_label_error(made.rows, "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(made.sha256()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_compression, op3_passage_dedup, op4_exact_dedup, op5_html_blocks, op6_piece_scan, op7_media_chunks,
        op8_jaccard_join, op9_toxicity_ngrams, op10_chat_format, op11_line_dedup, op12_merkle_manifest, op13_vector_codes,
    )
}


def _rounds(n: int) -> str:
    """CTEs of op13's SQL: assignment (a) and codebook (b) of each round."""
    near = "SELECT p.vec_id, p.label, p.part, p.v, min(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v)) AS error, arg_min(b.entry, (list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), b.entry)) AS entry FROM p JOIN b{0} b ON p.part = b.part GROUP BY ALL"
    mean = "SELECT part, entry, list(floor(s / n) ORDER BY place) AS v FROM (SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{0}) GROUP BY ALL) GROUP BY part, entry"
    steps = [f"a{i} AS MATERIALIZED ({near.format(i)}), m{i} AS ({mean.format(i)}), b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)" for i in range(n)]
    return ", ".join([*steps, f"a{n} AS MATERIALIZED ({near.format(n)})"])

ORACLE: dict[str, str] = {
    "op1_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS mark FROM documents),
b AS (SELECT *, length(bin(size)) AS bits FROM d),
c AS (SELECT *, CASE WHEN size <= 0 THEN 0 ELSE CAST(floor(bits * 4 + CAST(size * 4 AS DOUBLE) / pow(2, bits - 1) - 4) AS INT) END AS band, CAST(floor(mark * 256 / 4294967296) AS INT) AS cell FROM b),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM c GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][((r - 1) % 3 + 1)::INT] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, most / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
l AS (SELECT arg_min(level, ratio) AS lvl FROM o WHERE ratio >= level),
t AS (SELECT source, source_size::BIGINT AS source_size, CAST(CASE WHEN lvl IS NULL THEN most ELSE least(most, lvl * weight) END AS DOUBLE) AS target FROM o CROSS JOIN l),
p AS (SELECT c.doc_id, c.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
   row_number() OVER (PARTITION BY c.source ORDER BY c.band, c.cell, c.mark, c.doc_id) AS k,
   (CAST('0x' || substr(md5('mix|offset|' || coalesce(c.source, 'null')), 1, 8) AS BIGINT) % 1048576 + 0.5::DOUBLE) / 1048576 AS start
   FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(k * rate + start) - floor((k - 1) * rate + start), 2) * size AS BIGINT) AS taken FROM p""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
    "op10_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length('<|turn:|>' || chr(10) || '<|end|>' || chr(10)) + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '|', '\p')) + length(replace(replace(text, '\', '\\'), '<', '\l')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id""",
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS lost FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op12_merkle_manifest": r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i : list_reduce(list_concat([i], range(8)), lambda a, s : CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
c AS (SELECT *, CASE WHEN list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch : ascii(ch)::BIGINT)), lambda a, b : xor(a >> 8, t[(xor(a, b) & 255) + 1])) % 2 = 1
  THEN replace(text, chr(10), '') ELSE text END AS shown_text FROM documents, tab),
e AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body, coalesce(strlen(shown_text) || ':' || shown_text, '-') AS shown_body FROM c),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) AS n FROM e GROUP BY source),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS r FROM (SELECT doc_id, tree, n, sha256(head || body) AS leaf, sha256(head || shown_body) AS shown FROM e JOIN s ON e.source IS NOT DISTINCT FROM s.source)),
own AS (SELECT tree, 0::BIGINT AS lvl, i, leaf AS h, n FROM l UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM own WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
sub AS (SELECT tree, lvl AS height, h FROM own WHERE n = 1),
top AS (SELECT -1::BIGINT AS tree, 0::BIGINT AS lvl, tree AS i, h, (SELECT count(*) FROM sub) AS n FROM sub UNION ALL SELECT tree, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY tree, lvl, i // 3, n),
g AS (SELECT tree, lvl, i // 3 AS run, list(h ORDER BY i) AS hs FROM (SELECT * FROM own UNION ALL SELECT * FROM top) WHERE n > 1 GROUP BY 1, 2, 3),
f AS (SELECT r, tree, 0::BIGINT AS lvl, i AS j, shown AS acc, '' AS proof FROM l UNION ALL
  SELECT r, f.tree, f.lvl + 1, j // 3, sha256(array_to_string(hs[:j % 3], '') || acc || array_to_string(hs[j % 3 + 2:], '')), proof || array_to_string(hs[:j % 3], '') || array_to_string(hs[j % 3 + 2:], '') FROM f JOIN g ON f.tree = g.tree AND f.lvl = g.lvl AND j // 3 = run),
f2 AS (SELECT r, 0::BIGINT AS lvl, f.tree AS j, acc, proof FROM f JOIN sub ON f.tree = sub.tree AND f.lvl = sub.height UNION ALL
  SELECT r, f2.lvl + 1, j // 3, sha256(array_to_string(hs[:j % 3], '') || acc || array_to_string(hs[j % 3 + 2:], '')), proof || array_to_string(hs[:j % 3], '') || array_to_string(hs[j % 3 + 2:], '') FROM f2 JOIN g ON g.tree = -1 AND f2.lvl = g.lvl AND j // 3 = run),
root AS (SELECT h AS root, lvl AS height FROM top WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified FROM l JOIN sub ON l.tree = sub.tree JOIN root ON TRUE JOIN f2 ON l.r = f2.r AND f2.lvl = root.height""",
    "op13_vector_codes": rf"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x : floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[(part * len(v) // 4 + 1):((part + 1) * len(v) // 4)] AS v FROM k, unnest(range(4)) AS t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < 256),
{_rounds(4)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM a4 GROUP BY vec_id, label),
h AS (SELECT sha256(string_agg(CAST(x AS BIGINT), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM b4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c, h""",
}
