"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates go, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces. A null text
stays null up to packing, where it is an empty document. Rows that share a doc_id are taken for one document by the
near-duplicate stage: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agonix.llm.common import stored, table, unused
from agonix.llm.line_dedup import dedup_lines
from agonix.llm.near_dedup import near_duplicates
from agonix.llm.packing import pack, pieces
from agonix.llm.secrets import redact
from agonix.llm.toxicity import fit, training_rows

#: SQL can't express learned scores, hashed sketches, tokenisers or packing: the stages are tested one by one instead.
ORACLE_SQL = None


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The documents with a new text and its length."""
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), text))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out).select(*[F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least 0.5 go."""
    score = unused("toxicity", docs.columns)
    scored = fit(training_rows(docs, table(spark, sf_dir, "labels"))).score(docs, docs.columns, score)
    return scored.where(F.col(score) < 0.5).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that at least 5 documents hold stay in the largest doc_id only."""
    own = {c: c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)}  # no name that the operator adds
    lines = dedup_lines(docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]))
    back = lines.select(*[F.col(f"`{name}`").alias(c) for c, name in own.items()], F.col("kept").alias(unused("lines", docs.columns)))
    return _with_text(back, F.col(unused("lines", docs.columns)), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    key = unused("gone", docs.columns)
    gone = near_duplicates(docs, words=5, num=80, den=100).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark."""
    return _with_text(redact(docs), F.col("text"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 4096."""
    return pack(pieces(docs, with_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
