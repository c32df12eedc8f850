"""Dense retrieval: exact inner products of stored vectors with a table of query vectors.

Each batch of stored vectors meets blocks of queries in matrix products and yields only its own best few, so what is
shuffled for the final ranking is a few rows for each query and batch.  Queries go to the vectors, up to a bounded number
of them with each scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine import expect

DIGITS = 5
#: Queries in one matrix product, and numbers in the queries that go with one scan.
BLOCK = 1024
CARRIED = 1 << 24
#: Stored vectors in one matrix product.
STORED = 2048
EMPTY = "Cannot search an empty vector index."


def size(index: DataFrame) -> int:
    """How many vectors there are."""
    return index.count()


def require_same_size(index: DataFrame, chunks: DataFrame) -> None:
    """Stored vectors and chunks belong together one to one."""
    if (n := size(index)) != (m := chunks.count()):
        raise ValueError(f"mismatch: there are {n} vectors for {m} chunks")


def _flat(column: pa.Array, dimension: int) -> np.ndarray:
    """A column of lists of one width as a matrix, without Python objects."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def append(index: DataFrame, added: DataFrame, dimension: int) -> DataFrame:
    """The index with more vectors (``id, position, embedding``); all must have the index's width."""
    odd = added.where(F.coalesce(F.size("embedding") != dimension, F.lit(True))).first()
    if odd:
        raise ValueError(f"embedding width must be {dimension}")
    return index.unionByName(added)


def normalise(vector):
    """The vector over its length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def search(index: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """``query_id, rank, id, position, score`` of the best of ``index`` (``id, position, embedding``) for each of
    ``queries`` (``query_id, embedding``).  Scores are rounded before ranking; ties go to the earlier position."""
    expect.top_k(top_k)
    some = index.select(F.size("embedding")).first()
    if some is None:
        raise ValueError(EMPTY)
    dimension = some[0]
    odd = queries.where(F.coalesce(F.size("embedding") != dimension, F.lit(True))).select("query_id").first()
    if odd:
        raise ValueError(f"the vector of query {odd[0]} must have {dimension} numbers")
    scans, found = max(1, -(-queries.count() * dimension // CARRIED)), None
    numbered = queries.withColumn("_scan", F.pmod(F.xxhash64("query_id"), F.lit(scans)))
    for k in range(scans):
        part = _search_block(index, numbered.where(F.col("_scan") == k).select("query_id", "embedding").toArrow(), top_k, dimension)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "position", "score")


def _search_block(index: DataFrame, block: pa.Table, top_k: int, dimension: int) -> DataFrame:
    names = block["query_id"].combine_chunks()
    asked = _flat(block["embedding"].combine_chunks(), dimension)
    schema = f"query_id {'string' if pa.types.is_string(names.type) or pa.types.is_large_string(names.type) else 'long'}, id {index.schema['id'].dataType.simpleString()}, position long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a score that so many of the task's vectors reach is needed by all after them
        floor = np.full(len(asked), -np.inf)
        for batch in (whole.slice(k, STORED) for whole in batches for k in range(0, whole.num_rows, STORED)):
            stored, position = _flat(batch.column(2), dimension), batch.column(1).to_numpy()
            k = min(top_k, batch.num_rows)
            for at in range(0, len(asked), BLOCK):
                scores = np.round(asked[at : at + BLOCK] @ stored.T, DIGITS)
                cut = np.partition(scores, batch.num_rows - k, axis=1)[:, batch.num_rows - k]
                least = np.maximum(cut, floor[at : at + BLOCK])
                who, which = np.nonzero(scores >= least[:, None])  # ties at the cut are all kept for now
                if k == top_k:
                    floor[at : at + BLOCK] = least
                order = np.lexsort((position[which], -scores[who, which], who))
                who, which = who[order], which[order]
                keep = np.arange(len(who)) - np.searchsorted(who, who) < k
                who, which = who[keep], which[keep]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(who + at)), batch.column(0).take(pa.array(which)), pa.array(position[which]), pa.array(scores[who, which])], names=["query_id", "id", "position", "score"])

    return index.select("id", F.col("position").cast("long"), "embedding").mapInArrow(run, schema)


def hydrate(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with their chunks' columns; an id without a chunk is an error."""
    lost = ranked.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_anti").first()
    if lost:
        raise KeyError(f"unknown chunk_id: {lost['id']}")
    return ranked.withColumnRenamed("id", "chunk_id").join(chunks, "chunk_id")
