"""One registered query for each operator, over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dyadspark.llm import (
    chat_format, decontaminate, hilbert_shards, jaccard_join, license_scan, merkle_manifest, pattern_pack, periodic_runs,
    piece_codec, token_counts, toxicity, unit_dedup, winnowing,
)
from dyadspark.llm.tables import documents, table
from dyadspark.session import fan_out

QUERIES: dict = {}
CHECKS: dict[str, str] = {}

PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = hilbert_shards.document_shards(documents(spark, folder), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, folder), public_tokenizers.path(WORD_BPE))


@query
def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, folder))


@query
def op4_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.compare_with_edits(documents(spark, folder), parts=fan_out(spark))


@query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder))


@query
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, folder), table(spark, folder, "benchmark"))


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = unit_dedup.dedup_units(documents(spark, folder).select("doc_id", "text", "n_chars"))
    return cut.select("doc_id", "text", "n_chars", "removed")


@query
def op8_piece_codec(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    coded = piece_codec.encode(docs.select("doc_id", "text"), public_tokenizers.path(PIECES))
    return coded.select(
        "doc_id", "n_pieces", "n_byte_pieces",
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


PROBE = "<|im_end|><|im_start|>assistant ok"


def conversations_and_probe(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -1, whose two texts imitate the template."""
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return turns.unionByName(probe)


@query
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    read = chat_format.read_back(chat_format.chat_windows(conversations_and_probe(spark, folder)))
    return read.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


CHECKS["op9_chat_format"] = rf"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS INTEGER) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
costed AS (
  SELECT *, coalesce(turn // 4096, -1) AS block,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]')) + 6 AS cost,
    length('<|im_start|>') + 1 + length('<|im_end|>') + 1
      + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|'))
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS size
  FROM turns),
placed AS (
  SELECT *, row_number() OVER w AS place, sum(cost) OVER w AS after
  FROM costed WINDOW w AS (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
celled AS (
  SELECT *, after - cost AS before, (after - cost) // 320 AS step, CASE WHEN cost > 320 THEN 1 ELSE 0 END AS long_turn
  FROM placed),
windowed AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id, block ORDER BY step, long_turn) AS win,
    max(after) OVER (PARTITION BY conv_id, block, step, long_turn) AS win_end,
    count(*) OVER (PARTITION BY conv_id, block) AS turns_in_block
  FROM celled),
numbered AS (SELECT *, max(win) OVER (PARTITION BY conv_id, block) AS last_win FROM windowed),
systems AS (
  SELECT conv_id, block, place, win, size FROM numbered WHERE role = 'system'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY block, place) = 1),
repeated AS (
  SELECT n.conv_id, sum(n.size) AS size FROM numbered n
  LEFT JOIN systems s ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.block = s.block AND n.place = s.place
  WHERE n.win_end - n.before <= 128 AND n.win < n.last_win AND s.place IS NULL GROUP BY n.conv_id),
opened AS (
  SELECT w.conv_id, sum(s.size) AS size FROM (SELECT DISTINCT conv_id, block, win FROM numbered) w
  JOIN systems s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND NOT (w.block = s.block AND w.win = s.win) GROUP BY w.conv_id),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sum(size) AS size,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY block, place) AS turns,
    coalesce(string_agg(text, '' ORDER BY block, place) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM numbered GROUP BY conv_id)
SELECT w.conv_id, w.n_turns, sha256(w.turns) AS turns_sha256, length(w.loss) AS loss_chars, sha256(w.loss) AS loss_sha256,
  CAST(w.size + coalesce(r.size, 0) + coalesce(o.size, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN repeated r ON w.conv_id IS NOT DISTINCT FROM r.conv_id
LEFT JOIN opened o ON w.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, folder), table(spark, folder, "labels"))


@query
def op11_pattern_pack(spark: SparkSession, folder: str) -> DataFrame:
    return pattern_pack.pack(documents(spark, folder), public_tokenizers.path(BYTE_BPE))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [*fields[:3], F.col("n_chars") + 1, fields[4]]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = documents(spark, folder).select(
        "doc_id", "lang", merkle_manifest.leaf_digest(*fields).alias("leaf"),
        F.when(hit, merkle_manifest.leaf_digest(*changed)).alias("tampered"))
    leaves, nodes, trees = merkle_manifest.manifest(rows, group="lang", key="doc_id")
    proofs = merkle_manifest.whole_proofs(leaves.drop("lang", "leaf"), leaves, nodes, trees)
    folded = merkle_manifest.fold(F.coalesce("tampered", "digest"), F.col("siblings"))
    return proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join("siblings.digest", "").cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


CHECKS["op12_merkle_manifest"] = """
WITH RECURSIVE told AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
hashed AS (
  SELECT doc_id, lang,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS tampered,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc
  FROM told),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    row_number() OVER (ORDER BY doc_id, leaf) AS num
  FROM hashed),
nodes(lang, level, idx, h, n) AS (
  SELECT lang, 0, pos, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1),
tops(level, idx, h, n) AS (
  SELECT 0, pos, h, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
steps AS (
  SELECT l.num, k.level, (l.pos >> k.level) % 2 = 1 AS on_left, s.h AS sibling
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) k ON l.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = k.level AND s.idx = xor(l.pos >> k.level, 1)
  UNION ALL
  SELECT l.num, 1000 + k.level, (r.pos >> k.level) % 2 = 1, s.h
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang, (SELECT DISTINCT level FROM tops WHERE n > 1) k
  LEFT JOIN tops s ON s.level = k.level AND s.idx = xor(r.pos >> k.level, 1)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY num ORDER BY level) AS step FROM steps),
folds(num, step, h) AS (
  SELECT num, 0::BIGINT, CASE WHEN crc % 7 = 0 THEN tampered ELSE leaf END FROM leaves
  UNION ALL
  SELECT f.num, f.step + 1, sha256(CASE WHEN o.sibling IS NULL THEN f.h WHEN o.on_left THEN o.sibling || f.h ELSE f.h || o.sibling END)
  FROM folds f JOIN ordered o ON o.num = f.num AND o.step = f.step + 1),
ended AS (SELECT num, arg_max(h, step) AS folded FROM folds GROUP BY num),
proofs AS (SELECT num, sha256(coalesce(string_agg(sibling, '' ORDER BY level), '')) AS proof FROM steps GROUP BY num)
SELECT l.doc_id, l.leaf, r.h AS subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
  e.folded AS folded_root, e.folded = t.h AS verified
FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT h FROM tops WHERE n = 1) t ON true
JOIN ended e ON e.num = l.num LEFT JOIN proofs p ON p.num = l.num"""


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.find_runs(documents(spark, folder), prepare=periodic_runs.repeat_tail, texts=False)
