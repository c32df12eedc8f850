"""A stored vector index for exact inner products: vectors in cells around centres, and cells that can't matter skipped.

Each vector is stored in the folder of its nearest centre, with its distance from it.  No vector of a cell has a larger
inner product with a query than the centre's plus the query's length times the cell's radius.  A search scores the cells of
the highest such bounds first; then only cells whose bound reaches the kth best score of these.  The result is that of
``dense.search`` over all vectors.

The centres are fitted to a bounded sample, once; they are a matter of speed alone.  An append writes a segment and commits
a list of all segments, with the index's dimension, under the next number, as ``lexical_index`` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine import expect, scratch
from docengine.operators import dense
from docengine.operators.dense import CARRIED, DIGITS, EMPTY

#: Cells at most, and vectors of the sample for each.
CELLS, PER_CELL = 1024, 32
#: Rounds of fitting the centres.
ROUNDS = 8
#: Cells of each query that are scored first, and more of them until they have enough vectors.
FIRST = 2
#: Vectors of a cell that one task writes, about.
SPREAD = 1 << 20


def _schema(id_type: str) -> str:
    return f"id {id_type}, position long, embedding array<float>, distance double, segment string, cell int"


def fit_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds, from vectors spread over the sample; a centre that nothing is nearest to stays."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(sample, centres)[0]
        many = np.bincount(near, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and its distance."""
    near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(1))


def _assign(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, distance = _nearest(dense._flat(batch.column(2), centres.shape[1]), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(distance), pa.array(near.astype(np.int32))], names=["id", "position", "embedding", "distance", "cell"])

    return run


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    version: int
    dimension: int
    id_type: str
    segments: tuple[dict, ...]

    # -------------------------------------------------------------- life
    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, cells: int | None = None) -> VectorIndex:
        """A new index of ``id, position, embedding``; all of one width.  ``cells`` is the square root of their number unless
        given, ``CELLS`` at most."""
        spark = vectors.sparkSession
        if scratch.names(spark, f"{path}/commits"):
            raise FileExistsError(f"there is an index in {path}")
        some, many = vectors.select(F.size("embedding")).first(), vectors.count()
        if some is None:
            raise ValueError("an index needs a first vector, which gives its dimension")
        dimension = some[0]
        _check_width(vectors, dimension)
        cells = max(1, min(cells or int(many**0.5), CELLS, many))
        drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(max(cells, min(PER_CELL * cells, CARRIED // dimension))).select("embedding").toArrow()
        centres = fit_centres(dense._flat(drawn["embedding"].combine_chunks(), dimension), cells)
        table = pa.table({"cell": np.arange(cells, dtype=np.int32), "centre": pa.ListArray.from_arrays(np.arange(cells + 1, dtype=np.int32) * dimension, pa.array(centres.ravel()))})
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path, 0, dimension, vectors.schema["id"].dataType.simpleString(), ()).append(vectors)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """The index as last committed; an error names the part that is missing."""
        commits = scratch.names(spark, f"{path}/commits")
        if not commits:
            raise FileNotFoundError(f"vector index not found: {path}/commits")
        said = scratch.read_json(spark, f"{path}/commits/{commits[-1]}")
        index = cls(spark, path, int(commits[-1].split(".")[0]), said["dimension"], said["id_type"], tuple(said["segments"]))
        for part in ("centres", *(f"vectors/{s['name']}" for s in index.segments), *(f"cells/{s['name']}" for s in index.segments)):
            if not scratch.exists(spark, f"{path}/{part}"):
                raise FileNotFoundError(f"part of the vector index not found: {path}/{part}")
        return index

    def append(self, vectors: DataFrame) -> VectorIndex:
        """The index with more vectors of its dimension, whose ids must be new."""
        _check_width(vectors, self.dimension)
        expect.unique(vectors, "id")
        if self.segments:
            again = vectors.select("id").join(self.rows().select("id"), "id", "left_semi").first()
            if again:
                raise ValueError(f"Duplicate id: {again[0]}")
        name = f"segment={self.version + 1:08}-{uuid.uuid4().hex}"
        own = vectors.select("id", F.col("position").cast("long"), F.col("embedding").cast("array<float>"))
        placed = own.mapInArrow(_assign(self.centres()), _schema(self.id_type).replace(", segment string", ""))
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        # a cell with many vectors, copies for instance, is written by several tasks
        spread = max(1, min(parts, vectors.count() // SPREAD))
        placed.repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(spread))).write.partitionBy("cell").parquet(f"{self.path}/vectors/{name}")
        written = self.spark.read.schema(_schema(self.id_type)).option("basePath", f"{self.path}/vectors").parquet(f"{self.path}/vectors/{name}")
        written.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).write.parquet(f"{self.path}/cells/{name}")
        many = self.spark.read.parquet(f"{self.path}/cells/{name}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        segments = (*self.segments, {"name": name, "vectors": many})
        scratch.create_json(self.spark, f"{self.path}/commits/{self.version + 1:08}.json", {"dimension": self.dimension, "id_type": self.id_type, "segments": list(segments)})
        return VectorIndex(self.spark, self.path, self.version + 1, self.dimension, self.id_type, segments)

    # -------------------------------------------------------------- tables
    @property
    def size(self) -> int:
        """How many vectors there are."""
        return sum(s["vectors"] for s in self.segments)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_schema(self.id_type)).option("basePath", f"{self.path}/vectors").parquet(*[f"{self.path}/vectors/{s['name']}" for s in self.segments])

    def centres(self) -> np.ndarray:
        """One row a cell; their number is bounded."""
        found = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()
        return dense._flat(found["centre"].combine_chunks(), self.dimension)

    def _cells(self) -> tuple[np.ndarray, np.ndarray]:
        """Radius and number of vectors of each cell."""
        stats = self.spark.read.parquet(*[f"{self.path}/cells/{s['name']}" for s in self.segments]).groupBy("cell").agg(F.max("radius"), F.sum("n"))
        radius, many = np.full(len(self.centres()), -1.0), np.zeros(len(self.centres()), np.int64)
        for cell, r, n in stats.collect():
            radius[cell], many[cell] = r, n
        return radius, many

    # -------------------------------------------------------------- search
    def _scored(self, wanted: np.ndarray, names: pa.Array, asked: np.ndarray, top_k: int) -> DataFrame:
        """The best of each batch of vectors for the queries that want its cell (``wanted``: queries by cells)."""
        dimension, cells = self.dimension, [int(c) for c in np.flatnonzero(wanted.any(0))]
        kind = "string" if pa.types.is_string(names.type) or pa.types.is_large_string(names.type) else "int" if pa.types.is_int32(names.type) else "long"
        schema = f"query_id {kind}, id {self.id_type}, position long, score double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = batch.column(3).to_numpy()
                for cell in np.unique(of):
                    part = batch.filter(pa.array(of == cell))
                    stored, position, who = dense._flat(part.column(2), dimension), part.column(1).to_numpy(), np.flatnonzero(wanted[:, cell])
                    place = np.asarray(pc.rank(part.column(0), tiebreaker="first"))
                    for at in range(0, len(who), dense.BLOCK):
                        own = who[at : at + dense.BLOCK]
                        scores = np.round(asked[own] @ stored.T, DIGITS)
                        order = np.lexsort((np.broadcast_to(place, scores.shape), np.broadcast_to(position, scores.shape), -scores), axis=1)[:, :top_k]
                        flat = order.ravel()
                        q = np.repeat(own, order.shape[1])
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), part.column(0).take(pa.array(flat)), pa.array(position[flat]), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["query_id", "id", "position", "score"])

        return self.rows().where(F.col("cell").isin(cells)).select("id", "position", "embedding", "cell").mapInArrow(run, schema)

    def _wanted(self, queries: DataFrame, top_k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Which cells each query has to look at, the queries' names and their vectors."""
        table = queries.select("query_id", "embedding").toArrow()
        names, asked = table["query_id"].combine_chunks(), dense._flat(table["embedding"].combine_chunks(), self.dimension)
        radius, many = self._cells()
        bound = asked @ self.centres().T + np.sqrt((asked**2).sum(1))[:, None] * radius
        bound[:, many == 0] = -np.inf
        order = np.argsort(-bound, axis=1, kind="stable")
        # the first cells, and as many more as have k vectors together
        before = np.cumsum(many[order], axis=1) - many[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, (np.arange(bound.shape[1]) < FIRST) | (before < top_k), 1)
        first &= many > 0
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        kth = self._scored(first, names, asked, top_k).withColumn("turn", F.row_number().over(best)).where(F.col("turn") == top_k).select("query_id", "score").toArrow()  # a row a query
        least = dict(zip(kth["query_id"].to_pylist(), kth["score"].to_pylist()))
        floor = np.array([least.get(q, -np.inf) for q in names.to_pylist()])
        return (bound + 2 * 10.0**-DIGITS >= floor[:, None]) & (many > 0), names, asked

    def _parts(self, queries: DataFrame) -> list[DataFrame]:
        """The queries in parts that are small enough to go with the tasks."""
        expect.require(queries.where(F.coalesce(F.size("embedding") != self.dimension, F.lit(True))).select("query_id", F.lit(f"must have {self.dimension} numbers").alias("rule")), message="the vector of query {query_id} {rule}")
        scans = max(1, -(-queries.count() * self.dimension // CARRIED))
        return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(scans)) == k) for k in range(scans)]

    def search(self, queries: DataFrame, top_k: int = 10) -> DataFrame:
        """As ``dense.search`` for all vectors of the index: ``query_id, rank, id, position, score``."""
        expect.top_k(top_k)
        if not self.size:
            raise ValueError(EMPTY)
        found = None
        for part in self._parts(queries):
            scored = self._scored(*self._wanted(part, top_k), top_k)
            found = scored if found is None else found.unionByName(scored)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "id", "position", "score")

    def reach(self, queries: DataFrame, top_k: int = 10) -> dict[str, float]:
        """How much of the index a search reads: the share of vectors in cells that some query looks at, and of all pairs of
        a query and a vector."""
        read, pairs, asked = np.zeros(len(self.centres()), bool), 0.0, 0
        many = self._cells()[1]
        for part in self._parts(queries):
            wanted, names, _ = self._wanted(part, top_k)
            read |= wanted.any(0)
            pairs += float((wanted @ many).sum())
            asked += len(names)
        return {"vectors": self.size, "queries": asked, "read": float(many[read].sum()) / self.size, "scored": pairs / max(1, asked * self.size)}


def _check_width(vectors: DataFrame, dimension: int) -> None:
    odd = vectors.where(F.coalesce(F.size("embedding") != dimension, F.lit(True))).select("id").first()
    if odd:
        raise ValueError(f"embedding width must be {dimension}: {odd[0]}")
