"""Documents as tables, vectors with an encoder, and reports.  Files, the JSON sink, checked settings and ingestion have
modules of their own, named here too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from docengine import expect
from docengine.functions.text import search_terms
from docengine.schemas import DOCUMENT, PAGE
from docengine.scratch import exists as _exists
from docengine.sources.files import Extractor, Recogniser, check_page_number, form_feed_pages, parse_file, parse_files, recognise, recognise_page
from docengine.sources.ingestion import ingest, ingest_file
from docengine.sources.sink import save_documents, save_pages
from docengine.sources.typed import load_gold, load_manifest

__all__ = [
    "Extractor", "Recogniser", "check_page_number", "form_feed_pages", "hashed_encoder", "ingest", "ingest_file", "load_gold", "load_manifest", "load_vectors", "nest", "pages_of", "parse_file", "parse_files",
    "read_documents", "recognise", "recognise_page", "save_documents", "save_pages", "save_vectors", "write_comparison", "write_dense_report", "write_report",
]


# ------------------------------------------------------------------ JSON documents
def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents, validated: enums, counts."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    expect.require(expect.violations(docs, expect.document_rules(), "document_id"), message="{document_id}: invalid {rule}")
    return docs


def pages_of(documents: DataFrame) -> DataFrame:
    fields = [x.split()[0] for x in PAGE.split(", ")]
    return documents.select(F.explode("pages").alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in fields])


def nest(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with their pages, in order, as an array."""
    fields = [x.split()[0] for x in PAGE.split(", ")]
    packed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.struct(*fields).alias("page")))).alias("_p"))
    joined = documents.drop("pages").join(packed, "document_id", "left")
    return joined.withColumn("pages", F.coalesce(F.transform("_p", lambda x: x["page"]), F.expr("array()"))).drop("_p")


# ------------------------------------------------------------------ vectors and reports
def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("id", F.col("position").cast("long"), "embedding").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, path):
        raise FileNotFoundError(f"vector index not found: {path}")
    return spark.read.parquet(path)


#: Texts that are encoded together.
ROWS = 512


def hashed_encoder(dimension: int = 384) -> Callable[[DataFrame, str, str], DataFrame]:
    """The built-in encoder: a normalised bag of hashed search terms.  Takes a table, its text column and the name of
    the new one, which may be the text's, so that texts need not pass through Python; a neural encoder with the same
    signature can stand in for it."""

    def encode(df: DataFrame, text: str, to: str = "embedding") -> DataFrame:
        slots = df.withColumn(to, F.transform(search_terms(F.col(text)), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension)).cast("int")))
        schema = StructType([f for f in slots.schema.fields if f.name != to] + [StructField(to, ArrayType(FloatType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
                lists = batch.column(batch.num_columns - 1)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                counts = np.bincount(row * dimension + lists.flatten().to_numpy(), minlength=len(lists) * dimension).reshape(-1, dimension)
                norm = np.sqrt((counts.astype(np.float64) ** 2).sum(1, keepdims=True))
                flat = pa.array((counts / np.where(norm > 0, norm, 1)).astype(np.float32).ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(np.arange(len(lists) + 1, dtype=np.int32) * dimension, flat)], names=[f.name for f in schema.fields])

        return slots.select(*[F.col(f"`{f.name}`") for f in schema.fields]).mapInArrow(run, schema)

    return encode


def _report_block(summary: DataFrame, cases: DataFrame) -> DataFrame:
    metrics = summary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    rows = cases.agg(F.count("*").alias("num_cases"), F.array_sort(F.collect_list(F.struct(*cases.columns))).alias("cases"))
    return metrics.crossJoin(rows)


def write_dense_report(summary: DataFrame, cases: DataFrame, path: str, *, document_id: str, document_name: str, top_k: int) -> None:
    """One JSON object: the document, what was asked for, metrics by name, and a row for each case."""
    named = [F.lit(document_id).alias("document_id"), F.lit(document_name).alias("document_name"), F.lit(top_k).alias("top_k_requested")]
    _report_block(summary, cases).select(*named, "num_cases", "metrics", "cases").coalesce(1).write.mode("overwrite").json(path)


def write_comparison(dense: tuple[DataFrame, DataFrame], hybrid: tuple[DataFrame, DataFrame], path: str, *, document_id: str, document_name: str, gold: str, parameters: dict[str, int], dataset: dict[str, int]) -> None:
    """One JSON object with the parameters, the sizes of the data, and the summary and cases of both ways of search."""
    block = lambda pair, name: _report_block(*pair).select(F.struct("num_cases", "metrics", "cases").alias(name))
    values = lambda d: F.struct(*[F.lit(v).alias(k) for k, v in d.items()])
    head = [F.lit(document_id).alias("document_id"), F.lit(document_name).alias("document_name"), F.lit("dense_vs_hybrid_retrieval").alias("evaluation_type"), F.lit(gold).alias("gold_standard"), values(parameters).alias("parameters"), values(dataset).alias("dataset")]
    block(dense, "dense").crossJoin(block(hybrid, "hybrid")).select(*head, "dense", "hybrid").coalesce(1).write.mode("overwrite").json(path)


def write_report(summary: DataFrame, cases: DataFrame, path: str, **parameters: object) -> None:
    """One JSON object: the parameters, metrics by name, and a row for each case."""
    _report_block(summary, cases).select(*[F.lit(v).alias(k) for k, v in parameters.items()], "num_cases", "metrics", "cases").coalesce(1).write.mode("overwrite").json(path)
