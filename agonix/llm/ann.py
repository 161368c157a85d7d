"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Every unit vector is rotated by one random orthogonal matrix and kept as its signs, packed, with a correction scalar:
the inner product of the rotated vector and its own signs. Inner products with a query are estimated from the signs and
the scalar; the error bound of the estimate tells which candidates may be among the nearest, and these alone are
reranked on the original vectors in double precision.

Queries and candidates are dealt into blocks of bounded size by a hash of the row, and each pair of blocks is one task's
group; a query's nearest of every block meet in the end. No row of either side is left out.

Defined cases: vectors that are null, zero, or hold null or non-finite components, rows with a null id, and vectors of
another length than ``dim`` (by default the most common one) take no part; equal scores go by smaller id; rows that
share an id are rows of their own; a query without candidates has no rows; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_CODES = "row long, id long, vector array<double>, norm double, code binary, fit double, asks boolean"


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _coder(dim: int):
    """mapInArrow: code and correction scalar of every vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            rows, ids = batch.column("row").to_numpy(), batch.column("id").to_pylist()
            vectors = batch.column("vector").to_pylist()
            good = [i for i, (k, v) in enumerate(zip(ids, vectors, strict=True)) if k is not None and v is not None and len(v) == dim and None not in v]
            x = np.array([vectors[i] for i in good], dtype=np.float64).reshape(len(good), dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x, kept = x[ok], [i for i, k in zip(good, ok, strict=True) if k]
            # A power of two changes no cosine, and squares of very large or small components stay in range.
            x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
            norm = np.sqrt((x * x).sum(1))
            turned = (x / norm[:, None]) @ turn
            fit = np.abs(turned).sum(1) / np.sqrt(dim)
            codes = np.packbits(turned >= 0, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rows[kept], pa.int64()), pa.array([ids[i] for i in kept], pa.int64()), pa.array(list(x), pa.list_(pa.float64())), pa.array(norm), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(fit), batch.column("asks").take(pa.array(kept, pa.int64()))], names=["row", "id", "vector", "norm", "code", "fit", "asks"])

    return run


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(col.combine_chunks().flatten(), dtype=np.float64).reshape(-1, dim)


def _nearest(dim: int, k: int, width: float, step: int = 128):
    """Of one block of queries and one of candidates: each query's k nearest."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if queries.num_rows and block.num_rows:
            turn = rotation(dim)
            x, ids, rows, norm = _matrix(block["vector"], dim), np.asarray(block["id"]), np.asarray(block["row"]), np.asarray(block["norm"])
            packed = np.frombuffer(b"".join(block["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
            fit = np.asarray(block["fit"])
            bound = width * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(1, dim - 1)) + 1e-6
            q, qid, qrow, qnorm = _matrix(queries["vector"], dim), np.asarray(queries["id"]), np.asarray(queries["row"]), np.asarray(queries["norm"])
            turned = ((q / qnorm[:, None]) @ turn).astype(np.float32)
            for at in range(0, len(q), step):
                guess = (turned[at : at + step] @ signs.T) / np.sqrt(dim) / fit
                guess[qrow[at : at + step, None] == rows[None, :]] = -np.inf
                low = guess - bound
                floor = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(guess), -np.inf)
                for i, cut in enumerate(floor, at):
                    able = np.flatnonzero((guess[i - at] + bound >= cut) & (rows != qrow[i]))
                    score = (x[able] * q[i]).sum(1) / (norm[able] * qnorm[i])
                    best = np.lexsort((ids[able], -score))[:k]
                    for values, got in zip(out, (np.full(len(best), qrow[i]), np.full(len(best), qid[i]), ids[able[best]], score[best]), strict=True):
                        values.append(got)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, kinds, strict=True)], names=["qrow", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None, width: float = 4.0, query_block: int = 2048, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row for which the column expression ``is_query`` holds.

    ``width`` scales the error bound: larger reranks more and misses less."""
    named = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    if dim is None:
        top = named.where("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = top["n"] if top else 1
    codes = stored(named.mapInArrow(_coder(dim), _CODES), "codes")
    queries = codes.where("asks")
    n, m = codes.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-m // query_block))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    left = queries.select("row", "id", "vector", "norm", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("g"), every(blocks).alias("b"))
    right = codes.select("row", "id", "vector", "norm", "code", "fit", every(groups).alias("g"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("b"))
    met = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(_nearest(dim, k, width), "qrow long, query_id long, vec_id long, score double")
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
