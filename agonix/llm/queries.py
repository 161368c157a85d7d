"""The thin queries over the given tables: one per operator, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import search
from .bpe import round_trip
from .common import table
from .exact_dedup import dedup_exact
from .html_extract import extract
from .html_extract import fit as fit_pages
from .importance import resample
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack, pieces
from .prefix_trie import forked, prefix_trie, sequences
from .quality_rules import judge, references
from .secrets import count_of, listed, scan
from .toxicity import fit, held_out, training_rows
from .warc import archive_round_trip


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = round_trip(docs)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [count_of("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(listed("spans", base_only=True), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = extract(pages, fit_pages(pages))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = fit(training_rows(docs, labels)).score(docs.withColumn("held_out", held_out()), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), with_ids=False)
    return pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark, f"{sf_dir}/documents.parquet")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs), ["doc_id"]).drop("char_distance", "word_distance")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(forked(sequences(table(spark, sf_dir, "conversations"))))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_warc": op6_warc,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ann_search": op9_ann_search,
    "op10_toxicity": op10_toxicity,
    "op11_quality_rules": op11_quality_rules,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {
    "op3_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), k AS (
  SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT k.doc_id, k.pos, k.line, (f.key IS NOT NULL AND f.keeper <> k.doc_id) AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op8_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n, length(coalesce(text, '')) AS c FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY n ORDER BY c DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY c DESC, doc_id) = 1 AS kept,
       sha256(n) AS text_sha256
FROM t
""",
    "op12_conversation_trie": r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), i AS (
  SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS b,
         xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 9 AS h
  FROM o
), r AS (
  SELECT c, 0 AS own, pos, role, text FROM i JOIN o ON o.conv_id = b WHERE pos <= h
  UNION ALL
  SELECT c, 1, pos, role, text FROM i JOIN o ON o.conv_id = c WHERE pos > h
), q AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY own, pos) FILTER (WHERE text IS NOT NULL) AS turns FROM i LEFT JOIN r USING (c) GROUP BY c
), p AS (
  SELECT c, coalesce(len(turns), 0) AS n, unnest(range(coalesce(len(turns), 0) + 1)) AS d, turns FROM q
), x AS (
  SELECT d, coalesce(turns[1:d], []) AS pre, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM p GROUP BY ALL
), k AS (
  SELECT d - 1 AS d, pre[1:d-1] AS pre, count(*) AS n_children FROM x WHERE d > 0 GROUP BY ALL
), y AS (
  SELECT x.*, coalesce(n_children, 0) AS n_children, CASE WHEN x.d = 0 THEN 0 ELSE (n_convs - 1) * strlen(x.pre[x.d].text) END AS saved FROM x LEFT JOIN k ON k.d = x.d AND k.pre = x.pre
), u AS (
  SELECT e AS d, pre[1:e] AS pre, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT pre, saved, n_children, unnest(range(d + 1)) AS e FROM y) GROUP BY ALL
)
SELECT y.conv_id, y.d AS depth, z.conv_id AS parent_conv_id, y.n_convs, y.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(y.ends) AS ends_sha256
FROM y JOIN u ON u.d = y.d AND u.pre = y.pre LEFT JOIN y z ON z.d = y.d - 1 AND z.pre = y.pre[1:y.d-1]
""",
}
