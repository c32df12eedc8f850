"""A trained encoder: latent semantic vectors of chunks.

Search terms are dealt to a bounded number of slots by a hash; a text is its slots' frequencies, damped by logarithms, times
their rarity, at length 1.  The directions in which such vectors vary most are found by a randomised singular value
decomposition.  The matrix of texts is never held: each pass sends a narrow matrix of slots to the texts, multiplies every
batch with it, and sums two small products, the Gram matrix of the results, which stands for their orthonormal basis, and
the texts' matrix times them.  What a pass shuffles is that sum, by chunks of slots, from each partition; what reaches the
driver is one such matrix, as large as the slots times the width, however many texts there are.

The encoder has the signature of ``hashed_encoder``, so it can stand in for it wherever one is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from docengine import scratch
from docengine.functions.text import search_words

SLOTS, WIDTH = 1 << 15, 64
#: Directions beyond the width that a pass carries, and passes after the first.
SPARE, TURNS = 10, 2
#: Texts multiplied at a time, and slots in a chunk of sums.
ROWS, CHUNK = 256, 1024


@dataclass
class Sparse:
    """Texts as rows of slots with values."""

    row: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    many: int

    def times(self, dense: np.ndarray) -> np.ndarray:
        out = np.zeros((self.many, dense.shape[1]), np.float32)
        if len(self.row):
            first = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1]))
            out[self.row[first]] = np.add.reduceat(dense.take(self.slot, 0) * self.value[:, None], first, axis=0)
        return out

    def add_transposed(self, to: np.ndarray, dense: np.ndarray) -> None:
        """``to`` plus the transposed matrix times ``dense``."""
        if len(self.row):
            order = np.argsort(self.slot, kind="stable")
            slot = self.slot[order]
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            to[slot[first]] += np.add.reduceat(dense.take(self.row[order], 0) * self.value[order, None], first, axis=0)


def sparse(lists: pa.Array, rarity: np.ndarray) -> Sparse:
    lists = lists.fill_null([]) if lists.null_count else lists
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    pair, times = np.unique(row * len(rarity) + lists.flatten().to_numpy(), return_counts=True)
    row, slot = np.divmod(pair, len(rarity))
    value = (1 + np.log(times)) * rarity[slot]
    norm = np.sqrt(np.bincount(row, value**2, len(size)))
    return Sparse(row, slot, (value / np.where(norm > 0, norm, 1)[row]).astype(np.float32), len(size))


def _slotted(df: DataFrame, text: str, slots: int) -> DataFrame:
    return df.withColumn("_slots", F.transform(search_words(F.col(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")))


def _sums(lists: DataFrame, rarity: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts' matrix A and the directions O: the Gram matrix of A O, and the transpose of A times A O."""
    slots, width = direction.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((width, width)), np.zeros((slots, width), np.float32)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                x = sparse(batch.column(0).slice(k, ROWS), rarity)
                y = x.times(direction)
                gram += y.T.astype(np.float64) @ y
                x.add_transposed(total, y)
        chunks = [k for k in range(0, slots, CHUNK) if total[k : k + CHUNK].any()]
        values = [gram.tobytes(), *(total[k : k + CHUNK].astype(np.float64).tobytes() for k in chunks)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *chunks], pa.int32()), pa.array(values, pa.binary())], names=["chunk", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in group["sums"].to_pylist())
        return pa.table({"chunk": group["chunk"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = lists.select("_slots").mapInArrow(run, "chunk int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, sums binary").collect()
    gram, total = np.zeros((width, width)), np.zeros((slots, width))
    for chunk, sums in found:
        values = np.frombuffer(bytes(sums), np.float64).reshape(-1, width)
        if chunk < 0:
            gram = values
        else:
            total[chunk : chunk + CHUNK] = values
    return gram, total


@dataclass
class LatentEncoder:
    rarity: np.ndarray  # of each slot
    directions: np.ndarray  # slots by width, orthonormal columns, the strongest first
    strength: np.ndarray  # the singular values

    def __call__(self, df: DataFrame, text: str, to: str = "embedding") -> DataFrame:
        """The table with a column of normalised vectors of a text column."""
        rarity, directions = self.rarity, self.directions.astype(np.float32)
        slotted = _slotted(df, text, len(rarity))
        schema = StructType([f for f in df.schema.fields if f.name != to] + [StructField(to, ArrayType(FloatType()))])
        names = [f.name for f in schema.fields]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(k, ROWS)
                    y = sparse(batch.column(batch.num_columns - 1), rarity).times(directions)
                    norm = np.sqrt((y**2).sum(1, keepdims=True))
                    flat = pa.array((y / np.where(norm > 0, norm, 1)).astype(np.float32).ravel())
                    vectors = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], flat)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], names=names)

        return slotted.select(*[F.col(f"`{n}`") for n in names[:-1]], "_slots").mapInArrow(run, schema)


def fit(texts: DataFrame, text: str = "content", *, width: int = WIDTH, slots: int = SLOTS, turns: int = TURNS, seed: int = 5) -> LatentEncoder:
    """The encoder of a table's text column.  Its width is less where the texts vary in fewer directions."""
    spark, path = texts.sparkSession, scratch.folder(texts.sparkSession, "slots")
    _slotted(texts, text, slots).select("_slots").write.parquet(path)  # every pass reads them
    try:
        return _fitted(spark.read.schema("_slots array<int>").parquet(path), width, slots, turns, seed)
    finally:
        scratch.delete(spark, path)


def _fitted(lists: DataFrame, width: int, slots: int, turns: int, seed: int) -> LatentEncoder:
    many, counts = lists.count(), np.zeros(slots)
    for slot, n in lists.select(F.explode(F.array_distinct("_slots")).alias("slot")).groupBy("slot").agg(F.count("*")).collect():  # a row a slot
        counts[slot] = n
    rarity = np.log((1 + many) / (1 + counts)) + 1
    direction = np.linalg.qr(np.random.default_rng(seed).normal(size=(slots, width + SPARE)))[0].astype(np.float32)
    for _ in range(turns):
        direction = np.linalg.qr(_sums(lists, rarity, direction)[1])[0].astype(np.float32)
    gram, total = _sums(lists, rarity, direction)
    # A O = Q R with R'R the Gram matrix; then Q'A = R^-T (A'A O)', whose singular vectors are those of A
    values, basis = np.linalg.eigh(gram)
    kept = values > 1e-9 * max(values.max(), 1e-30)
    small = (total @ (basis[:, kept] / np.sqrt(values[kept]))).T
    _, strength, found = np.linalg.svd(small, full_matrices=False)
    own = min(width, int((strength > 1e-6).sum()))
    return LatentEncoder(rarity, found[:own].T.copy(), strength[:own])
