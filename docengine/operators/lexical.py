"""BM25 retrieval over words and word pairs, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine import expect
from docengine.functions import text as fn

K1, B = 1.5, 0.75
DIGITS = 6
#: Numbers at most (distinct terms times queries) for which the queries go to the chunks.
CELLS = 1 << 23
EMPTY = "Cannot search an empty lexical index."
#: Chunks that meet the queries in one matrix product.
BATCH = 512


def check_parameters(k1: float, b: float) -> None:
    if k1 <= 0:
        raise ValueError("k1 must be greater than 0")
    if not 0 <= b <= 1:
        raise ValueError("b must be between 0 and 1")


def doc_texts(chunks: DataFrame) -> DataFrame:
    """``chunk_id, position, text`` of chunks with ``content`` and, where there are, ``section`` and ``subsection``."""
    parts = [F.col(c) if c in chunks.columns else F.lit(None).cast("string") for c in ("section", "subsection", "content")]
    return chunks.select("chunk_id", "position", fn.searchable(*parts).alias("text"))


def doc_terms(chunks: DataFrame) -> DataFrame:
    """``chunk_id, position, terms`` of such chunks."""
    words = doc_texts(chunks).select("chunk_id", "position", fn.search_words(F.col("text")).alias("words"))
    return words.select("chunk_id", "position", fn.with_pairs(F.col("words")).alias("terms"))


def postings(terms: DataFrame) -> DataFrame:
    """``chunk_id, term, tf``, counted within the row: equal terms of the sorted array stand together."""
    ordered = terms.select("chunk_id", F.sort_array("terms").alias("terms"))
    begins = F.filter(F.transform("terms", lambda x, i: F.when((i == 0) | (x != F.get("terms", i - 1)), i)), lambda i: i.isNotNull())
    marked = ordered.select("chunk_id", "terms", begins.alias("begins"))
    counted = F.transform("begins", lambda at, k: F.struct(F.get("terms", at).alias("term"), (F.coalesce(F.get("begins", k + 1), F.size("terms")) - at).cast("long").alias("tf")))
    return marked.select("chunk_id", F.explode(counted).alias("c")).select("chunk_id", "c.*")


def term_stats(terms: DataFrame) -> DataFrame:
    return terms.select("chunk_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(terms: DataFrame) -> DataFrame:
    """One row: the number of chunks and their mean length, 1 if that is 0."""
    mean = F.avg(F.size("terms"))
    return terms.agg(F.count("*").alias("n"), F.when(mean > 0, mean).otherwise(1.0).alias("avgdl"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(idf_, tf, dl, avgdl, k1: float = K1, b: float = B):
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qtf``; a term counts as often as the query has it."""
    return queries.select("query_id", F.explode(fn.search_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def search(chunks: DataFrame, queries: DataFrame, top_k: int = 10, *, k1: float = K1, b: float = B, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, chunk_id, position, score`` of each query's best chunks; scores are rounded before ranking,
    ties go to the earlier position, then the smaller id.  Only terms that some query has are counted.

    Queries whose terms make a table of at most ``cells`` numbers go to the chunks: each batch of chunks yields its own best
    for every query, and only those are shuffled.  Beyond that chunks and queries meet by term."""
    check_parameters(k1, b)
    expect.top_k(top_k)
    expect.require(queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").select("query_id", F.lit("query must not be empty").alias("rule")), message="{rule}")
    terms, asked = doc_terms(chunks), query_terms(queries)
    n_terms, n_queries = asked.agg(F.count_distinct("term"), F.count_distinct("query_id")).first()
    if n_terms * n_queries <= cells:
        scored = _scored_by_batch(terms, asked, top_k, k1, b)
    else:
        scored = _scored_by_term(terms, asked, k1, b)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "position", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k).select("query_id", "rank", "chunk_id", "position", "score")


def _scored_by_term(terms: DataFrame, asked: DataFrame, k1: float, b: float) -> DataFrame:
    vocabulary = asked.select("term").distinct()
    counts = postings(terms).join(vocabulary, "term", "left_semi").join(terms.select("chunk_id", "position", F.size("terms").alias("dl")), "chunk_id")
    stats = counts.groupBy("term").agg(F.count("*").alias("df"))
    if terms.isEmpty():
        raise ValueError(EMPTY)
    whole = corpus_stats(terms)  # one row
    weighed = counts.join(stats, "term").crossJoin(F.broadcast(whole)).select("term", "chunk_id", "position", weight(idf(F.col("n"), F.col("df")), F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b).alias("w"))
    return weighed.join(asked, "term").groupBy("query_id", "chunk_id", "position").agg(F.round(F.sum(F.col("qtf") * F.col("w")), DIGITS).alias("score")).where("score > 0")


def _codes(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and count of the vocabulary's terms in a column of lists, and the lists' lengths."""
    column = column.fill_null([]) if column.null_count else column
    dl = np.diff(column.offsets.to_numpy())
    code = pc.fill_null(pc.index_in(column.flatten(), value_set=vocabulary), -1).to_numpy()
    row = np.repeat(np.arange(len(dl)), dl)[code >= 0]
    pair, tf = np.unique(row * max(1, len(vocabulary)) + code[code >= 0], return_counts=True)
    return *np.divmod(pair, max(1, len(vocabulary))), tf, dl


def _scored_by_batch(terms: DataFrame, asked: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    table = asked.toArrow()  # its size has been checked
    names = pc.unique(table["query_id"])
    vocabulary = pc.unique(table["term"].cast(pa.string()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            _, code, _, dl = _codes(batch.column(0), vocabulary)
            df += np.bincount(code, minlength=len(vocabulary))
            n, length = n + len(dl), length + int(dl.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *met.tolist()], pa.int64()), pa.array([n, length, *df[met].tolist()], pa.int64())], names=["code", "times"])

    found = dict(terms.select("terms").mapInArrow(count, "code long, times long").groupBy("code").agg(F.sum("times")).collect())
    n, length = found.pop(-2, 0), found.pop(-1, 0)
    if not n:
        raise ValueError(EMPTY)
    df = np.array([found.get(k, 0) for k in range(len(vocabulary))], np.float64)
    avgdl, rarity = length / n if length else 1.0, np.log(1 + (n - df + 0.5) / (df + 0.5))
    weights = np.zeros((len(vocabulary), len(names)))
    weights[pc.index_in(table["term"].cast(pa.string()), value_set=vocabulary).to_numpy(), pc.index_in(table["query_id"], value_set=names).to_numpy()] = table["qtf"].to_numpy()
    weights *= rarity[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                row, code, tf, dl = _codes(batch.column(2), vocabulary)
                met, code = np.unique(code, return_inverse=True)
                x = np.zeros((batch.num_rows, len(met)))
                x[row, code] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                scores = np.round(x @ weights[met], DIGITS).T
                position = batch.column(1).to_numpy()
                k = min(top_k, batch.num_rows)
                cut = np.partition(scores, batch.num_rows - k, axis=1)[:, batch.num_rows - k, None]
                who, which = np.nonzero((scores >= cut) & (scores > 0))  # ties at the cut are all kept
                yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), batch.column(0).take(pa.array(which)), pa.array(position[which]), pa.array(scores[who, which])], names=["query_id", "chunk_id", "position", "score"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, chunk_id {kind(terms, 'chunk_id')}, position long, score double"
    return terms.select("chunk_id", F.col("position").cast("long"), "terms").mapInArrow(run, schema)
