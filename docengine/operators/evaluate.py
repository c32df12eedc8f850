"""Retrieval quality against gold: hit rates at cutoffs and mean reciprocal rank."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.functions import text as fn

CUTOFFS = (1, 3, 5, 10)


def first_relevant_rank(cases: DataFrame, rankings: DataFrame, gold: DataFrame, top_k: int = 10) -> DataFrame:
    """``case_id, first_rank`` for every case; null where no relevant chunk is among the first ``top_k``."""
    hits = rankings.where(F.col("rank") <= top_k).join(gold, ["case_id", "chunk_id"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    return cases.select("case_id").join(hits, "case_id", "left")


def metrics(first: DataFrame) -> DataFrame:
    """``metric, value`` rows over all cases; 0 where there is none."""
    means = [F.coalesce(F.avg((F.coalesce(F.col("first_rank") <= k, F.lit(False))).cast("double")), F.lit(0.0)).alias(f"Recall@{k}") for k in CUTOFFS]
    mrr = F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)).alias("MRR")
    wide = first.agg(*means, mrr)
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(f"`{c}`"), 6).alias("value")) for c in wide.columns])).alias("m")).select("m.*")


def evaluate(cases: DataFrame, rankings: DataFrame, gold: DataFrame, top_k: int = 10) -> DataFrame:
    """As ``metrics``; no case at all, or a case without a ranking, is an error."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if cases.isEmpty():
        raise ValueError("cases must not be empty")
    lost = cases.join(rankings.select("case_id").distinct(), "case_id", "left_anti").first()
    if lost:
        raise KeyError(lost["case_id"])
    return metrics(first_relevant_rank(cases, rankings, gold, top_k))


def compare(dense: DataFrame, hybrid: DataFrame) -> DataFrame:
    """``metric, dense, hybrid, change`` in percentage points."""
    joined = dense.withColumnRenamed("value", "dense").join(hybrid.withColumnRenamed("value", "hybrid"), "metric")
    return joined.withColumn("change", F.round(100 * (F.col("hybrid") - F.col("dense")), 4))


def unknown_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold ids that no chunk has."""
    return gold.select("case_id", "chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def check_gold(gold_document: str | None, document: str, gold: DataFrame, chunks: DataFrame) -> None:
    """Gold must be of this document, and name chunks that there are."""
    if gold_document != document:
        raise ValueError(f"the gold is of {gold_document!r}, which does not match the document {document!r}")
    lost = unknown_gold(gold, chunks).select("chunk_id").distinct().orderBy("chunk_id").limit(20).collect()
    if lost:
        raise ValueError(f"gold names chunks that there are none of: {[r[0] for r in lost]}")


def shown(ranked: DataFrame, chunks: DataFrame, gold: DataFrame, digits: int = 4) -> DataFrame:
    """Ranked rows (``case_id, rank, chunk_id, score``) as lines to read, with a mark on gold."""
    marks = gold.select("case_id", "chunk_id", F.lit(" GOLD").alias("mark"))
    cut = lambda c: F.coalesce(F.col(c), F.lit("-"))
    line = F.concat(
        F.format_string(f"%d. score=%.{digits}f ", "rank", "score"), F.col("chunk_id"), F.coalesce("mark", F.lit("")), F.format_string(" pages %d-%d | ", "page_start", "page_end"),
        cut("section"), F.lit(" | "), cut("subsection"), F.lit(" | "), fn.preview(F.col("content")),
    )
    return ranked.join(chunks, "chunk_id").join(marks, ["case_id", "chunk_id"], "left").select("case_id", "rank", line.alias("line"))


def case_report(first: DataFrame) -> DataFrame:
    """A row a case: hits at the cutoffs and the reciprocal rank."""
    hits = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"recall_at_{k}") for k in CUTOFFS]
    return first.select("case_id", "first_rank", *hits, F.round(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)), 6).alias("reciprocal_rank"))


#: Words inside a text, between blanks, by which documents that may hold it are found.
ANCHOR = 4
#: Characters of texts, at most, that one automaton looks for.
SOUGHT = 16 << 20


def holding(documents: DataFrame, texts: DataFrame, *, sought: int = SOUGHT) -> DataFrame:
    """``case_id, chunk_id`` where the ``text`` of a document (``chunk_id``) has that of a case (``case_id``) as it stands.

    Texts of ``sought`` characters in all go to the documents as an automaton, which reads each of these once.  Of more
    texts, those of ``ANCHOR`` + 2 words or more meet documents by a hash of inner words, which stand between blanks in
    the document too; shorter ones go to the documents in parts."""
    texts = texts.select("case_id", "text").where("text is not null")
    total = texts.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0]
    if total <= sought:
        return _spotted(documents, texts.toArrow())
    long = F.size(F.split("text", " ")) >= ANCHOR + 2
    short = texts.where(~long)
    parts = max(1, -(-short.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()[0] // sought))
    found = _anchored(documents, texts.where(long))
    for k in range(parts):
        found = found.union(_spotted(documents, short.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).toArrow()))
    return found


def _spotted(documents: DataFrame, cases: pa.Table) -> DataFrame:
    names = cases["case_id"].combine_chunks()
    who: dict[str, list[int]] = {}
    for k, text in enumerate(cases["text"].to_pylist()):
        who.setdefault(text, []).append(k)
    everywhere = who.pop("", [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for text, own in who.items():
            automaton.add_word(text, own)
        automaton.make_automaton()
        for batch in batches:
            case, row = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    found = {c for _, own in automaton.iter(text) for c in own} if who else set()
                    case += [*found, *everywhere]
                    row += [k] * (len(found) + len(everywhere))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(case, pa.int64())), batch.column(0).take(pa.array(row, pa.int64()))], names=["case_id", "chunk_id"])

    own = documents.select("chunk_id", "text")
    id_type = "string" if pa.types.is_string(names.type) or pa.types.is_large_string(names.type) else "int" if pa.types.is_int32(names.type) else "long"
    return own.mapInArrow(run, f"case_id {id_type}, chunk_id {own.schema['chunk_id'].dataType.simpleString()}")


def _anchored(documents: DataFrame, texts: DataFrame) -> DataFrame:
    inner = lambda c: F.slice(F.split(c, " "), 2, ANCHOR)
    cases = texts.select("case_id", F.col("text").alias("wanted"), F.xxhash64(F.concat_ws(" ", inner(F.col("text")))).alias("anchor"))
    words = documents.select("chunk_id", F.split("text", " ").alias("words"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - ANCHOR + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, ANCHOR))))
    anchors = words.where(F.size("words") >= ANCHOR + 2).select("chunk_id", F.explode(F.array_distinct(runs)).alias("anchor"))
    met = anchors.join(cases, "anchor").join(documents.select("chunk_id", "text"), "chunk_id")
    return met.where(F.contains("text", "wanted")).select("case_id", "chunk_id").distinct()
