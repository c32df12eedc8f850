"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

Equal codes are indexed once, with the few smallest ids that can matter.  The index is dealt by a hash of the code into
shards of bounded size; each shard cuts its codes into segments and keeps a table from segment values to codes.  A
query probes the tables of one segment after another, all values within Hamming radius 0, then 1 and so on.  When the
first a+1 of m segments are searched with radius r and the others with r-1, every code within distance m*r+a has been
met, so the search of a shard ends as soon as the kth verified distance is within that.  Each query is answered by one
shard first; its kth distance there bounds the search of all others, which end when that is covered, found or not.  The best
of all shards are then ranked by distance and id.  A shard takes its queries in blocks; its index is sent once for ``block``
queries.

Defined cases: rows with a null id or code are neither indexed nor asked; codes of another length than the query's are
no neighbours; a row is not its own neighbour, equal codes of other ids are; ties go to the smaller id; repeated rows
count once; with fewer than k other rows all are returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.store import Store

SCHEMA = "query_id long, code binary, neighbor_id long, distance int"


def sign_codes(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Codes with a bit for each dimension: whether it is above zero.  Null vectors have a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [None if v is None else np.packbits(np.array(v, np.float64) > 0).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], names=["id", "code"])

    return vectors.select(F.col(id_column).cast("long").alias("id"), vector).mapInArrow(run, "id long, code binary")


def _bits(codes: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)


def _words(bits: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


class MultiIndex:
    """Segment tables over distinct codes."""

    def __init__(self, codes: list[bytes]):
        bits = _bits(codes)
        self.words, n, width = _words(bits), len(codes), bits.shape[1]
        each = int(min(16, width, max(4, round(log2(n + 1)))))
        self.edges = np.linspace(0, width, ceil(width / each) + 1).astype(int)
        self.tables = []
        for values, size in self._segments(bits):
            starts = np.zeros((1 << size) + 1, np.int64)
            np.cumsum(np.bincount(values, minlength=1 << size), out=starts[1:])
            self.tables.append((np.argsort(values, kind="stable"), starts))

    def _segments(self, bits: np.ndarray) -> list[tuple[np.ndarray, int]]:
        return [(bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)[::-1]), b - a) for a, b in zip(self.edges, self.edges[1:])]

    @staticmethod
    def _masks(size: int, radius: int) -> np.ndarray:
        return np.array([sum(1 << i for i in c) for c in combinations(range(size), radius)], np.int64)

    def search(self, asked: list[bytes], enough: int, lowest: np.ndarray, sizes: np.ndarray, bound: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the classes that can hold one of the ``enough`` best ids, with their distances.

        ``lowest`` and ``sizes`` are the smallest id and the number of ids of each class; ``bound`` has for each query a
        distance beyond which nothing matters."""
        bits = _bits(asked)
        words, parts, n = _words(bits), self._segments(bits), len(self.words)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        active, total = np.arange(len(asked)), int(sizes.sum())
        m = len(self.tables)
        for radius in range(17):
            for a, (order, starts) in enumerate(self.tables):
                values, size = parts[a]
                masks = self._masks(size, radius)
                if not len(active):
                    break
                for at in range(0, len(active) if len(masks) else 0, step := max(1, chunk // max(1, len(masks)))):
                    block = active[at : at + step]
                    probed = (values[block][:, None] ^ masks[None]).ravel()
                    count = starts[probed + 1] - starts[probed]
                    hit = np.flatnonzero(count)
                    count = count[hit]
                    who = np.repeat(block[hit // len(masks)], count)
                    first = np.repeat(starts[probed[hit]] - np.concatenate([[0], count.cumsum()[:-1]]), count) if len(hit) else np.zeros(0, np.int64)
                    met = order[first + np.arange(len(who))]
                    far = np.bitwise_count(words[who] ^ self.words[met]).sum(1).astype(np.int64)
                    cuts = np.searchsorted(who, block)
                    for q, x, d in zip(block, np.split(met, cuts[1:]), np.split(far, cuts[1:])):
                        if len(x):
                            x, keep = np.unique(np.concatenate([best[q][0], x]), return_index=True)
                            d = np.concatenate([best[q][1], d])[keep]
                            top = np.lexsort((lowest[x], d))[:enough]
                            best[q] = x[top], d[top]
                covered = m * radius + a
                done = np.array([covered >= bound[q] or len(best[q][0]) and sizes[best[q][0]][best[q][1] <= covered].sum() >= min(enough, total) for q in active], bool)
                active = active[~done]
        for q, (x, d) in enumerate(best):
            yield q, x, d


def search(index: DataFrame, queries: DataFrame, *, k: int = 10, shard_codes: int = 1 << 15, block_queries: int = 1 << 17, at_once: int = 1 << 11) -> DataFrame:
    """The ``k`` nearest rows of ``index`` for each of ``queries`` (both ``id``, ``code``), exactly.  A task holds the codes
    of a shard and a block of queries, and searches for ``at_once`` of these at a time."""
    store = Store(index.sparkSession, "hamming")
    known = index.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select("id", "code").distinct()
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = store.put(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = store.put(queries.where(F.col("id").isNotNull() & F.col("code").isNotNull()).select(F.col("id").alias("query_id"), "code").distinct(), "queries")
    shards = max(1, ceil(classes.count() / shard_codes))
    blocks = max(1, ceil(asked.count() / block_queries))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = classes.select(F.length("code").alias("width"), F.pmod(F.xxhash64("code"), F.lit(shards)).alias("shard"), every(blocks).alias("block"), "code", "ids")
    placed = asked.select("query_id", "code", F.length("code").alias("width"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), F.pmod(F.xxhash64("query_id", F.lit("home")), F.lit(shards)).alias("home"))

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        if own.num_rows and asking.num_rows and own["width"][0].as_py():
            ids = own["ids"].to_pylist()
            lowest, sizes = np.array([x[0] for x in ids]), np.array([len(x) for x in ids])
            table = MultiIndex(own["code"].to_pylist())
            for at in range(0, asking.num_rows, at_once):
                some = asking.slice(at, at_once)
                names, codes, bound = (some[c].to_pylist() for c in ("query_id", "code", "bound"))
                far_enough = np.array([8 * len(c) if d is None else d for c, d in zip(codes, bound)])
                for q, x, d in table.search(codes, k + 1, lowest, sizes, far_enough):
                    found = sorted((far, i) for c, far in zip(x.tolist(), d.tolist()) if far <= far_enough[q] for i in ids[c] if i != names[q])[:k]
                    rows[0].extend([names[q]] * len(found))
                    rows[1].extend([codes[q]] * len(found))
                    rows[2].extend(i for _, i in found)
                    rows[3].extend(far for far, _ in found)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(rows, kinds)], names=["query_id", "code", "neighbor_id", "distance"])

    key = ["width", "shard", "block"]
    answers = lambda right: left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, SCHEMA)
    found = answers(placed.select("width", F.col("home").alias("shard"), "block", "query_id", "code", F.lit(None).cast("int").alias("bound")))
    if shards > 1:
        found = store.put(found, "home")
        bounds = found.groupBy("query_id", "code").agg(F.max("distance").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
        others = placed.join(bounds, ["query_id", "code"], "left").select("width", every(shards).alias("shard"), "block", "query_id", "code", "bound", "home").where("shard <> home").drop("home")
        found = found.union(answers(others))
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("code")


SQL = """
SELECT query_id, neighbor_id, distance, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
           CAST(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CASE WHEN (q.embedding[i] > 0) <> (v.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
    WHERE q.vec_id % 100 = 0
  )
) WHERE rank <= 10
"""
