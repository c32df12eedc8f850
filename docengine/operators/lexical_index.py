"""A stored inverted index for BM25: built once, appended to, searched without reading the corpus.

Postings are rows of a block of chunks and up to ``RUN`` neighbouring terms of it: which of the block's chunks have each
term, how often, and how long these are.  Rows are clustered by term: a folder for each hash slot of first words (a pair of
words stands with its first one), sorted by word within its files, so a search opens the slots of its terms and skips the
pages of others.  The largest frequency and the least length of a term in a block bound its weight there whatever the
corpus statistics are, which change with every append: document frequencies are summed over the rows that a search reads,
and only the number of chunks and their total length are kept, with each segment.

A search reads its terms' postings once and writes them down, as it works on them several times.  For each query the blocks of the highest sums of bounds are scored, which gives a
kth best score; then only blocks whose bounds reach it are scored.  Chunks of a block are of similar length, which makes
the bounds tight.  The result is exact, in the order of ``lexical.search``.

An append writes a segment and then commits a list of all segments under the next number, as a file that must be new.  A
job that dies before leaves files that nobody reads; of two appends at the same time one is an error.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine import expect, scratch
from docengine.functions.text import STOPWORDS
from docengine.operators import lexical
from docengine.operators.lexical import B, DIGITS, EMPTY, K1

#: Chunks of a block, and folders that terms are dealt to.
BLOCK, SLOTS = 128, 64
#: Terms of a block that stand in one row at most.
RUN = 256
#: Bytes of text that a task turns into blocks together.
HELD = 32_000_000
#: Blocks of each query that are scored first.
FIRST = 4
#: Terms of the queries, at most, that are named in the plan; beyond that they meet the index in a join.
LISTED = 1 << 16
#: Words of the queries, at most, that are sought by the order of rows; more stand all over a slot.
SOUGHT = 32
#: Rows of the queries' terms that go with the tasks at most; beyond that queries and blocks meet in joins.
CARRIED = 1 << 20
#: Queries in one matrix product.
TOGETHER = 256


def _schema(id_type: str) -> str:
    return f"slot int, block long, first_word string, last_word string, terms string, ends array<int>, postings binary, lengths array<int>, chunk_ids array<{id_type}>, positions array<long>"


#: A posting: a chunk's place in its block, how often it has the term, how long it is.
POSTING = np.dtype([("place", "<i2"), ("tf", "<i4"), ("dl", "<i4")])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All postings in a row, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(POSTING), np.diff(ends) // POSTING.itemsize


#: Bytes that words are made of.
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (``[a-z0-9]+``) of all texts in a row, stop words included, and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = LETTER[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    begins[starts] = letter[starts]  # no word goes on from one text to the next
    kept = data[letter]
    at = np.append(np.flatnonzero(begins[letter]), len(kept)).astype(np.int32)
    many = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(kept)), many


def _blocks(segment: int, id_type: pa.DataType, slots: int):
    """Chunks (``chunk_id, position, text``, in lower case) to rows of postings; rows without terms name the chunks of a
    block."""
    kinds = [("slot", pa.int32()), ("block", pa.int64()), ("first_word", pa.string()), ("last_word", pa.string()), ("terms", pa.string()), ("ends", pa.list_(pa.int32())), ("postings", pa.binary()), ("lengths", pa.list_(pa.int32())), ("chunk_ids", pa.list_(id_type)), ("positions", pa.list_(pa.int64()))]

    def lists(values: np.ndarray | pa.Array, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values).cast(kind))

    def batch(n: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) if k in columns else pa.nulls(n, kind) for k, kind in kinds], names=[k for k, _ in kinds])

    def rows(held: list[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        ids, position, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
        flat, many = _words(texts)
        named = flat.dictionary_encode()
        vocabulary, code = named.dictionary, named.indices.to_numpy()
        # words by slot, then in their order
        slot = np.fromiter(map(zlib.crc32, vocabulary.cast(pa.binary()).to_pylist()), np.int64, len(vocabulary)) % slots
        order = np.lexsort((pc.rank(vocabulary).to_numpy(), slot))
        vocabulary, slot, rank = vocabulary.take(pa.array(order)), slot[order], np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code, text = rank[code], np.repeat(np.arange(len(many)), many)
        kept = ~pc.is_in(vocabulary, value_set=pa.array(STOPWORDS)).to_numpy(zero_copy_only=False)[code]
        code, text = code[kept], text[kept]
        many = np.bincount(text, minlength=len(many))
        upto = np.append(0, many.cumsum())
        dl, at = np.maximum(2 * many - 1, 0), position.to_numpy()  # words and the pairs of neighbours
        # after a word: nothing, or the other of a pair
        endings = pa.concat_arrays([pa.array([""]), pc.binary_join_element_wise("__", vocabulary, "")])
        bits, wide = (BLOCK - 1).bit_length(), len(vocabulary).bit_length()

        # by length into blocks, there in the order that ranks equal scores
        by_length = np.lexsort((at, dl))
        block = np.arange(len(dl)) // BLOCK
        order = by_length[np.lexsort((np.asarray(pc.rank(ids, tiebreaker="first"))[by_length], at[by_length], block))]
        starts = np.arange(0, len(dl), BLOCK)
        yield batch(len(starts), block=starts // BLOCK + first, lengths=lists(dl[order], starts, pa.int32()), chunk_ids=lists(ids.take(pa.array(order)), starts, id_type), positions=lists(at[order], starts, pa.int64()))

        for start in starts:
            own = order[start : start + BLOCK]
            place = np.repeat(np.arange(len(own)), many[own])
            if not len(place):
                continue
            word = code[np.arange(len(place)) - np.repeat(many[own].cumsum() - many[own], many[own]) + np.repeat(upto[own], many[own])]
            near = np.flatnonzero(place[1:] == place[:-1])
            term = np.concatenate([word << wide, (word[near] << wide) + word[near + 1] + 1])
            pair, tf = np.unique((term << bits) + np.concatenate([place, place[near]]), return_counts=True)
            posted = np.empty(len(pair), POSTING)
            posted["place"] = place = pair & ((1 << bits) - 1)
            posted["tf"], posted["dl"], term = tf, dl[own][place], pair >> bits
            begins = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            one, two = term[begins] >> wide, term[begins] & ((1 << wide) - 1)
            ends = np.append(begins[1:], len(term))
            # a row ends with its slot, or with so many terms
            changes = np.flatnonzero(np.append(True, slot[one][1:] != slot[one][:-1]))
            since = np.arange(len(one)) - np.repeat(changes, np.diff(np.append(changes, len(one))))
            row = np.flatnonzero(since % RUN == 0)
            last = np.append(row[1:], len(one)) - 1
            before = np.repeat(begins[row], last + 1 - row)
            terms = pc.binary_join_element_wise(vocabulary.take(pa.array(one)), endings.take(pa.array(two)), "")
            cuts = np.append(begins[row], len(pair)) * POSTING.itemsize
            yield batch(
                len(row), slot=slot[one[row]].astype(np.int32), block=np.full(len(row), start // BLOCK + first), first_word=vocabulary.take(pa.array(one[row])), last_word=vocabulary.take(pa.array(one[last])),
                terms=pc.binary_join(lists(terms, row, pa.string()), " "), ends=lists(ends - before, row, pa.int32()), postings=pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(posted)]),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, block = [], 0, (segment << 48) | (TaskContext.get().partitionId() << 24)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                held.append(whole.slice(k, 1024))
                many += pc.sum(pc.binary_length(held[-1].column(2))).as_py()
                if many > HELD:
                    yield from rows(held, block)
                    block += -(-sum(b.num_rows for b in held) // BLOCK)
                    held, many = [], 0
        if held:
            yield from rows(held, block)

    return run


def _word(term: Column) -> Column:
    """The first word of a term."""
    return F.substring_index(term, "__", 1)


def _slot(term: Column, slots: int) -> Column:
    return (F.crc32(_word(term).cast("binary")) % slots).cast("int")


def _shelf(block: Column, slots: int) -> Column:
    """The folder, below 0, of the row that names a block's chunks."""
    return (-1 - F.pmod(F.xxhash64(block), F.lit(slots))).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    spark: SparkSession
    path: str
    version: int
    slots: int
    id_type: str
    segments: tuple[dict, ...]

    # -------------------------------------------------------------- life
    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, slots: int = SLOTS) -> LexicalIndex:
        """A new index of chunks (``chunk_id, position, content`` and, where there are, ``section`` and ``subsection``)."""
        spark = chunks.sparkSession
        if scratch.names(spark, f"{path}/commits"):
            raise FileExistsError(f"there is an index in {path}")
        return cls(spark, path, 0, slots, chunks.schema["chunk_id"].dataType.simpleString(), ()).append(chunks)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalIndex:
        """The index as last committed."""
        commits = scratch.names(spark, f"{path}/commits")
        if not commits:
            raise FileNotFoundError(f"no lexical index in {path}")
        said = scratch.read_json(spark, f"{path}/commits/{commits[-1]}")
        return cls(spark, path, int(commits[-1].split(".")[0]), said["slots"], said["id_type"], tuple(said["segments"]))

    def append(self, chunks: DataFrame) -> LexicalIndex:
        """The index with more chunks, whose ids must be new.  Stored segments stay as they are."""
        expect.unique(chunks, "chunk_id")
        if self.segments:
            again = chunks.select("chunk_id").join(self.directory().select(F.explode("chunk_ids").alias("chunk_id")), "chunk_id", "left_semi").first()
            if again:
                raise ValueError(f"Duplicate chunk_id: {again[0]}")
        number, name = len(self.segments), f"segment={self.version + 1:08}-{uuid.uuid4().hex}"
        # in a fixed order within each partition, so a task that runs again makes the same blocks
        texts = lexical.doc_texts(chunks.sortWithinPartitions("chunk_id")).select("chunk_id", F.col("position").cast("long"), F.lower("text"))
        id_type = pa.string() if self.id_type == "string" else pa.int32() if self.id_type == "int" else pa.int64()
        made = texts.mapInArrow(_blocks(number, id_type, self.slots), _schema(self.id_type))
        dealt = made.withColumn("slot", F.coalesce("slot", _shelf(F.col("block"), self.slots)))
        # a frequent term's blocks go to as many tasks as there are for a slot
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // (2 * self.slots))
        clustered = dealt.repartition("slot", F.pmod("block", F.lit(spread))).sortWithinPartitions("slot", "first_word", "block")
        clustered.write.partitionBy("slot").parquet(f"{self.path}/segments/{name}")
        new = LexicalIndex(self.spark, self.path, self.version + 1, self.slots, self.id_type, ({"name": name},))
        counted = new.directory().agg(F.sum(F.size("lengths")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("terms"), F.count("*").alias("blocks")).first()
        segments = (*self.segments, {"name": name, "chunks": counted["n"] or 0, "terms": counted["terms"] or 0, "blocks": counted["blocks"]})
        scratch.create_json(self.spark, f"{self.path}/commits/{self.version + 1:08}.json", {"slots": self.slots, "id_type": self.id_type, "segments": list(segments)})
        return LexicalIndex(self.spark, self.path, self.version + 1, self.slots, self.id_type, segments)

    # -------------------------------------------------------------- tables
    @property
    def size(self) -> int:
        """How many chunks there are."""
        return sum(s["chunks"] for s in self.segments)

    def rows(self) -> DataFrame:
        schema = _schema(self.id_type) + ", segment string"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/segments").parquet(*[f"{self.path}/segments/{s['name']}" for s in self.segments])

    def directory(self) -> DataFrame:
        """The rows that name each block's chunks."""
        return self.rows().where("slot < 0").select("slot", "block", "lengths", "chunk_ids", "positions")

    def postings(self, terms: DataFrame) -> DataFrame:
        """Postings of some terms (``term, slot``) only, a row for a term and a block.  Few are named, so the scan opens their
        slots, of very few it skips pages of others; many meet the index in a join, which prunes slots as it runs."""
        few = terms.limit(LISTED + 1).collect()  # without a job where the terms are held by the driver
        rows, named = self.rows().where("slot >= 0"), len(few) <= LISTED
        if named:
            rows = rows.where(F.col("slot").isin(sorted({r["slot"] for r in few})))
            words = sorted({r["term"].split("__")[0] for r in few})
            if 0 < len(words) <= SOUGHT:
                rows = rows.where(reduce(or_, ((F.col("first_word") <= w) & (F.col("last_word") >= w) for w in words)))
        each = rows.select("slot", "block", "ends", "postings", F.posexplode(F.split("terms", " ")).alias("at", "term"))
        if named:
            each = each.where(F.col("term").isin([r["term"] for r in few]))
        begin = F.coalesce(F.get("ends", F.col("at") - 1), F.lit(0))
        n, size = F.get("ends", F.col("at")) - begin, POSTING.itemsize
        found = each.select("slot", "term", "block", n.alias("n"), F.substring("postings", begin * size + 1, n * size).alias("postings"))
        return found if named else found.join(terms, ["slot", "term"], "left_semi")

    @staticmethod
    def _extremes(postings: DataFrame) -> DataFrame:
        """``term, block, max_tf, min_dl``"""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    posted, many = _unpacked(batch.column(2))
                    begins = many.cumsum() - many
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.maximum.reduceat(posted["tf"], begins)), pa.array(np.minimum.reduceat(posted["dl"], begins))], names=["term", "block", "max_tf", "min_dl"])

        return postings.select("term", "block", "postings").mapInArrow(run, "term string, block long, max_tf int, min_dl int")

    @staticmethod
    def _each(postings: DataFrame) -> DataFrame:
        """``term, block, place, tf, dl``, a row a posting."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                posted, many = _unpacked(batch.column(2))
                at = pa.array(np.repeat(np.arange(len(many)), many))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(np.ascontiguousarray(posted[k])) for k in POSTING.names)], names=["term", "block", *POSTING.names])

        return postings.select("term", "block", "postings").mapInArrow(run, "term string, block long, place smallint, tf int, dl int")

    # -------------------------------------------------------------- search
    def weights(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, pa.Table | None]:
        """``query_id, term, w``, how often the query has the term times the term's rarity in the whole index; the index's
        rows of these terms; and the first once more as it is held by the driver, if it is small enough."""
        asked, postings, carried = self._asked(queries)
        weighed, held = self._weighed(asked, postings, carried)
        return weighed, postings, held

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """``query_id, term, qtf``, the index's rows of these terms, and whether the first is held by the driver."""
        asked = lexical.query_terms(queries)
        held = asked.limit(CARRIED + 1).toArrow()
        carried = held.num_rows <= CARRIED
        terms = self.spark.createDataFrame(pa.table({"term": pc.unique(held["term"])})) if carried else asked.select("term").distinct()
        asked = self.spark.createDataFrame(held) if carried else asked
        return asked, self.postings(terms.select("term", _slot(F.col("term"), self.slots).alias("slot"))), carried

    def _weighed(self, asked: DataFrame, postings: DataFrame, carried: bool) -> tuple[DataFrame, pa.Table | None]:
        df = postings.groupBy("term").agg(F.sum("n").alias("df"))
        weighed = asked.join(df, "term").select("query_id", "term", (F.col("qtf") * lexical.idf(F.lit(self.size), F.col("df"))).alias("w"))
        if not carried:
            return weighed, None
        held = weighed.toArrow()
        return self.spark.createDataFrame(held), held

    def bounds(self, asked: DataFrame, postings: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
        """``query_id, block, bound``: what a chunk of the block can score at most, for every block with a term of the query.
        ``asked`` and ``postings`` as ``weights`` gives them."""
        at_most = self._part(F.col("max_tf"), F.col("min_dl"), k1, b)
        found = self._extremes(postings).select("term", "block", at_most.alias("part")).join(asked, "term")
        # scores are rounded, and sums of floats depend on their order
        return found.groupBy("query_id", "block").agg((F.sum(F.col("w") * F.col("part")) + 2 * 10.0**-DIGITS).alias("bound"))

    def _part(self, tf: Column, dl: Column, k1: float, b: float) -> Column:
        length = sum(s["terms"] for s in self.segments)
        return lexical.weight(F.lit(1.0), tf, dl, length / self.size if length else 1.0, k1, b)

    def _scored(self, pairs: DataFrame, asked: DataFrame, postings: DataFrame, k1: float, b: float) -> DataFrame:
        """``query_id, block, place, least, score`` of all chunks with a term of the query in the blocks of the pairs
        (``query_id, block, least``)."""
        each = self._each(postings).join(asked, "term").join(pairs, ["query_id", "block"])
        part = self._part(F.col("tf"), F.col("dl"), k1, b)
        scored = each.groupBy("query_id", "block", "place").agg(F.first("least").alias("least"), F.round(F.sum(F.col("w") * part), DIGITS).alias("score"))
        return scored.where("score > 0 and score >= coalesce(least, 0)")

    def _scored_together(self, postings: DataFrame, blocks: DataFrame, asked: pa.Table, least: dict, top_k: int, k1: float, b: float) -> DataFrame:
        """As ``_scored``, the best few of each block, by matrix products of the blocks with all queries that can reach their
        ``least`` score there."""
        names, vocabulary = pc.unique(asked["query_id"]), pc.unique(asked["term"])
        code, who = pc.index_in(asked["term"], value_set=vocabulary).to_numpy(), pc.index_in(asked["query_id"], value_set=names).to_numpy()
        order = np.argsort(code, kind="stable")
        who, weight = who[order], asked["w"].to_numpy()[order]
        begins = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
        floor = np.array([least.get(q, 0.0) for q in names.to_pylist()])
        length = sum(s["terms"] for s in self.segments)
        mean = length / self.size if length else 1.0
        part = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
        kind = names.type

        def run(rows: pa.Table) -> pa.Table:
            rows = rows.combine_chunks()
            term = pc.index_in(rows["term"], value_set=vocabulary).to_numpy()
            many = begins[term + 1] - begins[term]
            at = np.repeat(np.arange(len(term)), many)
            entry = np.arange(len(at)) - np.repeat(many.cumsum() - many, many) + np.repeat(begins[term], many)
            query, w = who[entry], weight[entry]
            posted, n = _unpacked(rows["postings"].combine_chunks())
            firsts = n.cumsum() - n
            most = part(np.maximum.reduceat(posted["tf"], firsts).astype(float), np.minimum.reduceat(posted["dl"], firsts))
            bound = np.bincount(query, w * most[at], len(floor)) + 2 * 10.0**-DIGITS
            x = np.zeros((BLOCK, len(term)))
            x[posted["place"], np.repeat(np.arange(len(term)), n)] = part(posted["tf"].astype(float), posted["dl"])
            order = np.argsort(query, kind="stable")
            at, query, w = at[order], query[order], w[order]
            open_ = np.flatnonzero((bound >= floor) & (np.bincount(query, minlength=len(floor)) > 0))
            found = []
            for k in range(0, len(open_), TOGETHER):
                own = open_[k : k + TOGETHER]
                lo, hi = np.searchsorted(query, own), np.searchsorted(query, own, "right")
                take = np.repeat(lo - np.append(0, (hi - lo).cumsum()[:-1]), hi - lo) + np.arange((hi - lo).sum())
                matrix = np.zeros((len(term), len(own)))
                matrix[at[take], np.repeat(np.arange(len(own)), hi - lo)] = w[take]
                scores = np.round(x @ matrix, DIGITS).T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :top_k]
                score = np.take_along_axis(scores, best, 1)
                q, k_ = np.nonzero((score > 0) & (score >= floor[own][:, None]))
                found.append((own[q], best[q, k_], score[q, k_]))
            q, places, scores = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
            return pa.table({"query_id": names.take(pa.array(q, pa.int64())), "block": np.full(len(q), rows["block"][0].as_py() if len(rows) else 0, np.int64), "place": pa.array(places).cast(pa.int16()), "score": pa.array(scores, pa.float64())})

        query_type = "string" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else "int" if pa.types.is_int32(kind) else "long"
        met = postings.select("term", "block", "postings").join(blocks, "block", "left_semi")
        return met.groupBy("block").applyInArrow(run, f"query_id {query_type}, block long, place smallint, score double")

    @staticmethod
    def _first(bounds: DataFrame) -> DataFrame:
        """For each query the blocks of the highest bounds."""
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        return bounds.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= FIRST).select("query_id", "block", F.lit(0.0).alias("least"))

    @staticmethod
    def _kth(scored: DataFrame, top_k: int) -> DataFrame:
        """``query_id, least`` of the queries that have so many scores."""
        best = Window.partitionBy("query_id").orderBy(F.desc("score"))
        return scored.select("query_id", "score").withColumn("turn", F.row_number().over(best)).where(F.col("turn") == top_k).select("query_id", F.col("score").alias("least"))

    def reached(self, queries: DataFrame, top_k: int = 10, *, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
        """The chunks that may be among the best (``query_id, block, place, score``), and the blocks that were scored for it
        (``query_id, block``): those whose bound reaches a score that the kth best has at least."""
        asked, postings, carried = self._asked(queries)
        # read by several steps, and far fewer than the index has
        postings = scratch.stored(postings.drop("slot"), "postings")
        asked, held = self._weighed(asked, postings, carried)
        bounds = scratch.stored(self.bounds(asked, postings, k1, b), "bounds")
        first = self._first(bounds)
        if held is not None:
            kth = self._kth(self._scored_together(postings, first.select("block").distinct(), held, {}, top_k, k1, b), top_k).toArrow()  # a row a query
            least = dict(zip(kth["query_id"].to_pylist(), kth["least"].to_pylist()))
            kth = self.spark.createDataFrame(kth)
        else:
            kth = self._kth(self._scored(first, asked, postings, k1, b), top_k)
        pairs = bounds.join(kth, "query_id", "left").where("least is null or bound >= least").select("query_id", "block", "least")
        if held is not None:
            return self._scored_together(postings, pairs.select("block").distinct(), held, least, top_k, k1, b), pairs
        return self._scored(pairs, asked, postings, k1, b), pairs

    def search(self, queries: DataFrame, top_k: int = 10, *, k1: float = K1, b: float = B) -> DataFrame:
        """As ``lexical.search`` for all chunks of the index."""
        lexical.check_parameters(k1, b)
        expect.top_k(top_k)
        expect.require(queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").select("query_id", F.lit("query must not be empty").alias("rule")), message="{rule}")
        if not self.size:
            raise ValueError(EMPTY)
        good = self.reached(queries, top_k, k1=k1, b=b)[0].withColumn("slot", _shelf(F.col("block"), self.slots))
        named = good.join(self.directory().select("slot", "block", "chunk_ids", "positions"), ["slot", "block"])
        found = named.select("query_id", "score", F.get("chunk_ids", F.col("place").cast("int")).alias("chunk_id"), F.get("positions", F.col("place").cast("int")).alias("position"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "chunk_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "position", "score")
