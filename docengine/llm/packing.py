"""Packing by power-of-two decomposition.

Each document, tokenised and closed with a separator id, is cut into pieces whose lengths are powers of two: as many
pieces of the longest length as fit, then the binary digits of the rest, longest first.  Every piece is a sequence of
its own, so no sequence holds two documents, none needs padding, and sequences of one length form a bucket from which
batches of equal shape are drawn.  The operator needs no shuffle: pieces of a document depend on that document alone.

Defined cases: a null or empty text is the separator alone (one piece of length 1); a null id is carried along; equal
rows are packed each on its own; an empty table gives no rows; further columns are ignored; a text's literal added tokens
(``<|endoftext|>``) have their own ids, as in ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.words import slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Entries of a worker's memo of encoded words before it is emptied.
MEMO = 150_000


def power_lengths(n: int, longest: int) -> list[int]:
    """Lengths, each a power of two and at most ``longest``, that add up to ``n``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


#: The pre-tokenizer of byte-level BPE vocabularies of this family (a fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_core(path: str):
    """An encoder with the vocabulary of a ``tokenizers`` file of byte-level BPE, without its added tokens.

    Ids of such a vocabulary rise in the order of its merges, which is all that the encoder needs; it gives the ids of
    ``tokenizers.Tokenizer.encode(text, add_special_tokens=False)`` at several times the speed (the tests compare them).
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if all(c in byte_of for c in t) and not t.startswith("<|")}
    return tiktoken.Encoding("byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Irregular(Exception):
    """White space next to a blank, where a cut could change what the tokenizer sees."""


class WordEncoder(dict):
    """Encodes texts to little-endian uint32 ids, remembering words that it has met with the blank before them.

    The pre-tokenizer attaches a single blank to the word after it, so a text can be cut before its blanks and the
    parts encoded apart with the same ids.  A text with more white space next to a blank is encoded whole.
    """

    def __init__(self, path: str):
        self.core = byte_level_core(path)
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
            raise ValueError("added tokens that look at what stands around them")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in tokens}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if tokens else None

    def plain(self, text: str) -> bytes:
        return array("I", self.core.encode_ordinary(text)).tobytes()

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise Irregular
        self[part] = ids = self.plain(" " + part)
        return ids

    def encode(self, text: str) -> bytes:
        """Added tokens cut a text first; what lies between them is encoded apart."""
        if self.cut is None or not self.cut.search(text):
            return self.ordinary(text)
        return b"".join(self.added[x] if k % 2 else self.ordinary(x) for k, x in enumerate(self.cut.split(text)) if x)

    def ordinary(self, text: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        parts = text.split(" ")
        try:
            if parts[0][-1:].isspace():
                raise Irregular
            return self.plain(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))
        except Irregular:
            return self.plain(text)


def pack(docs: DataFrame, tokenizer: str, *, longest: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces of all documents (``doc_id``, ``text``): one row for each, with its ids as little-endian uint32.

    ``sequence_id`` numbers the sequences of a partition in order, under the partition's number in the upper bits;
    it is the same if a task runs again.  ``length`` is also the bucket.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = WordEncoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in slices(batches, 128):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, start = encoder.encode(text or "") + separator.to_bytes(4, "little"), 0
                n = len(data) // 4
                for length in power_lengths(n, longest):
                    rows.append((doc, start, length, n, sequence, 0, data[4 * start : 4 * (start + length)]))
                    start += length
                    sequence += 1
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """What identifies each piece, with a CRC in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences under one folder for each length, for a loader that draws batches of one shape."""
    pieces.withColumn("bucket", F.col("length")).write.mode("overwrite").partitionBy("bucket").parquet(path)
