"""Why retrieval finds or misses: sizes of gold chunks, local evidence, and the wording of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as fn
from docengine.operators import dense


def truncation_audit(chunks: DataFrame, gold: DataFrame, extra: DataFrame, keywords: list[str], count_tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sizes, pages and keyword places of the gold chunks and a few more (``chunk_id``).  ``count_tokens`` stands for the
    encoder's tokenizer, its marks included; without it words are counted."""
    ids = gold.select("chunk_id").union(extra.select("chunk_id")).distinct()
    return chunks.join(ids, "chunk_id", "left_semi").select(
        "chunk_id", "page_start", "page_end", F.length("content").alias("chars"), (count_tokens or fn.word_count)(F.col("content")).alias("tokens"), fn.keyword_positions(F.col("content"), keywords).alias("keywords")
    )


def evidence_locality(pairs: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """For ``query, content, at`` the similarity of the query with the whole chunk and with the passage at the place."""
    cut = pairs.withColumn("snippet", fn.evidence_snippet(F.col("content"), F.col("at")))
    for text, to in (("query", "_q"), ("content", "_c"), ("snippet", "_s")):
        cut = encode(cut, text, to)
    dot = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x), dense.DIGITS)
    return cut.select("query", dot("_q", "_c").alias("chunk_score"), dot("_q", "_s").alias("snippet_score"))


def wording(index: DataFrame, paraphrases: DataFrame, gold: DataFrame, encode: Callable[[DataFrame, str, str], DataFrame], top_k: int = 10) -> DataFrame:
    """For ``case_id, query_id, query`` paraphrases the best rank of a gold chunk, null if none is among the first."""
    ranked = dense.search(index, encode(paraphrases, "query", "embedding"), top_k).withColumnRenamed("id", "chunk_id")
    hits = ranked.join(paraphrases.select("query_id", "case_id"), "query_id").join(gold, ["case_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best_rank"))
    return paraphrases.join(hits, "query_id", "left").select("case_id", "query_id", "query", "best_rank")
