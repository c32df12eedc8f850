"""Ingestion of the files of a manifest, which can be run again: finished files aren't read twice.

A ledger under the target (``_ledger``) has a row for each document and run: the file's path, size and time, the hash of its
content, and what became of it.  A run looks at files' sizes and times first and reads those that the ledger doesn't have as
finished.  Pages are staged, then published by the sink's commit, and only then does the ledger say so; a run that dies in
between publishes the same documents again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine import scratch
from docengine.operators.pages import merge_recognised
from docengine.operators.sections import detect
from docengine.schemas import DOCUMENT_TYPES
from docengine.sources import files, sink

LEDGER = "document_id string, path string, size long, modified long, sha256 string, status string, error string, run int"
#: Failures that an error message names.
NAMED = 20


def ledger(spark: SparkSession, to: str) -> DataFrame:
    """The last row of each document, over all runs."""
    if not scratch.names(spark, f"{to}/_ledger"):
        return spark.createDataFrame([], LEDGER)
    runs = spark.read.schema(LEDGER).parquet(f"{to}/_ledger")
    return runs.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in runs.columns if c != "document_id"]), "run").alias("r")).select("document_id", "r.*")


def ingest(spark: SparkSession, manifest: DataFrame, folder: str, to: str, extract: files.Extractor = files.form_feed_pages, read_page: files.Recogniser | None = None, suffix: str = ".pdf") -> dict[str, int]:
    """All files of the manifest as JSON documents under ``to``; returns how many there are of ``success`` and ``failure``.
    A file that can't be read, or is not named with the suffix, doesn't stop the others; once these are published an error
    names the first of those that failed.  Another run reads only what failed, changed or is new."""
    run = 1 + max((int(n.split("=")[1]) for n in scratch.names(spark, f"{to}/_ledger") if n.startswith("run=")), default=0)
    staged = f"{to}/_staging/run={run}"
    entries = files.located(manifest, folder)
    named = files.ends_with(F.col("path"), suffix)
    seen = files.states(entries.where(named)).unionByName(entries.where(~named).select("document_id", "path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("modified"), F.concat(F.lit(f"ValueError: file must end with {suffix}: "), "path").alias("error")))
    known = ledger(spark, to).where("status = 'success'").select("document_id", "path", "size", "modified")
    seen.write.mode("overwrite").parquet(f"{staged}/seen")
    seen = spark.read.schema(seen.schema).parquet(f"{staged}/seen")
    todo = seen.join(known, ["document_id", "path", "size", "modified"], "left_anti")

    found = files.read_located(todo.where("error is null"), extract)
    found.write.mode("overwrite").parquet(f"{staged}/pages")
    found = spark.read.schema(found.schema).parquet(f"{staged}/pages")
    pages, _ = files.split_failures(found)
    if read_page:
        pages = merge_recognised(pages, files.recognise(spark, pages, manifest, folder, read_page))
    pages = detect(pages.drop("section", "subsection"))
    counted = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"))
    source = F.element_at(F.split("pdf", "/"), -1).alias("source_file")
    documents = manifest.join(counted, "document_id").select("document_id", "company_name", "document_type", source, "page_count")
    sink.save_pages(documents, pages, to)

    read = found.groupBy("document_id").agg(F.max("sha256").alias("sha256"), F.max("error").alias("failed"))
    rows = todo.join(read, "document_id", "left").withColumn("error", F.coalesce("error", "failed"))
    status = F.when(F.col("error").isNull(), "success").otherwise("failure").alias("status")
    rows.select("document_id", "path", "size", "modified", "sha256", status, "error", F.lit(run).alias("run")).drop("run").write.mode("overwrite").parquet(f"{to}/_ledger/run={run}")
    scratch.delete(spark, f"{to}/_staging")

    last = ledger(spark, to).join(manifest.select("document_id"), "document_id", "left_semi")
    counts = {r["status"]: r["count"] for r in last.groupBy("status").count().collect()}
    failed = counts.get("failure", 0)
    if failed:
        first = last.where("status = 'failure'").orderBy("document_id").limit(NAMED).collect()
        more = f"; and {failed - NAMED} more" if failed > NAMED else ""
        raise RuntimeError(f"{failed} of {sum(counts.values())} documents failed: " + "; ".join(f"{r['document_id']}: {r['error'].partition(': ')[2]}" for r in first) + more)
    return {"success": counts.get("success", 0), "failure": 0}


def ingest_file(spark: SparkSession, path: str, to: str, *, document_id: str | None = None, company_name: str | None = None, document_type: str | None = None, extract: files.Extractor = files.form_feed_pages, read_page: files.Recogniser | None = None, suffix: str = ".pdf") -> str:
    """One file as a JSON document; returns where that is.  All that describes it is required; what is wrong is an error."""
    given = {"document_id": document_id, "company_name": company_name, "document_type": document_type}
    lacking = [k for k, v in given.items() if v is None]
    if lacking:
        raise ValueError(f"required for a single file: {', '.join(lacking)}")
    if document_type not in DOCUMENT_TYPES:
        raise ValueError(f"document_type must be one of {', '.join(DOCUMENT_TYPES)}")
    if not scratch.exists(spark, path):
        raise FileNotFoundError(f"no such file: {path}")
    if not path.lower().endswith(suffix.lower()):
        raise ValueError(f"file must end with {suffix}: {path}")
    pages = files.parse_file(spark, path, str(document_id), extract)
    manifest = spark.createDataFrame([(path, document_id, company_name, document_type)], "pdf string, document_id string, company_name string, document_type string")
    if read_page:
        pages = merge_recognised(pages, files.recognise(spark, pages, manifest, "", read_page))
    pages = detect(pages.drop("section", "subsection"))
    counted = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"))
    documents = manifest.join(counted, "document_id").select("document_id", "company_name", "document_type", F.element_at(F.split("pdf", "/"), -1).alias("source_file"), "page_count")
    sink.save_pages(documents, pages, to)
    return f"{to.rstrip('/')}/{document_id}.json"
