"""Fusion of rankings by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine import expect
from docengine.operators import dense, lexical

RRF_K, CANDIDATES, DIGITS = 60, 50, 9


def check_parameters(rrf_k: int, candidate_k: int) -> None:
    if rrf_k <= 0:
        raise ValueError("rrf_k must be greater than 0")
    if candidate_k < 1:
        raise ValueError("candidate_k must be at least 1")


def fuse(arms: list[DataFrame], top_k: int, *, rrf_k: int = RRF_K) -> DataFrame:
    """``query_id, rank, chunk_id, position, score`` from rankings ``query_id, rank, chunk_id, position``: union and one
    aggregate do the work of a full join.  Ties go to the better single rank, then the earlier position and id."""
    check_parameters(rrf_k, 1)
    rows = arms[0].select("query_id", "rank", "chunk_id", "position")
    for arm in arms[1:]:
        rows = rows.unionByName(arm.select("query_id", "rank", "chunk_id", "position"))
    scored = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), DIGITS).alias("score"), F.min("rank").alias("best_rank"), F.min("position").alias("position")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "position", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "position", "score")


def require_same_size(lexical_chunks: DataFrame, chunks: DataFrame) -> None:
    if (n := lexical_chunks.count()) != (m := chunks.count()):
        raise ValueError(f"the lexical side has {n} chunks, the corpus {m}")


def search(index: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int = 10, *, candidate_k: int = CANDIDATES, rrf_k: int = RRF_K, lexical_chunks: DataFrame | None = None) -> DataFrame:
    """Both arms for ``queries`` (``query_id, query, embedding``), fused.  The lexical arm searches ``chunks`` unless it is
    given its own, which must be as many."""
    expect.top_k(top_k)
    check_parameters(rrf_k, candidate_k)
    if lexical_chunks is not None:
        require_same_size(lexical_chunks, chunks)
    n = candidates(top_k, candidate_k)
    near = dense.search(index, queries.select("query_id", "embedding"), n).withColumnRenamed("id", "chunk_id")
    return fuse([near, lexical.search(chunks if lexical_chunks is None else lexical_chunks, queries.select("query_id", "query"), n)], top_k, rrf_k=rrf_k)


def candidates(top_k: int, candidate_k: int = CANDIDATES) -> int:
    return max(top_k, candidate_k)
