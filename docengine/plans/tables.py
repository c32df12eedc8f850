"""The driver's tables as the engine's inputs, in Spark and in SQL.

A source is a document and its texts, by id, are the pages.  The tables have no section headings, running lines or
printed numbers; ``headed_pages`` and ``noisy_pages`` add some by rules on the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.operators.pages import measure


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's texts are numbered in the order of their ids.  A few sources have most of the texts, so these are dealt by id
    and not by source: the number before each id comes from a window over ids alone, as a row that stands above the id's
    texts."""
    docs, texts = read(spark, sf_dir, "documents"), Window.partitionBy("source", "doc_id").orderBy(F.col("before").asc_nulls_last())
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    ids = docs.select("source", "doc_id").repartition("source")  # they are counted and numbered where they are then
    starts = ids.groupBy("source", "doc_id").agg(F.count("*").alias("n")).select("source", "doc_id", (upto - F.col("n")).alias("before"))
    number = F.max("before").over(texts) + F.row_number().over(texts) - 1
    numbered = docs.unionByName(starts, allowMissingColumns=True).withColumn("page_number", number.cast("int")).where("before is null")
    return numbered.select(F.col("source").alias("document_id"), "page_number", "text", (F.col("doc_id") % 3).cast("int").alias("image_count"), "doc_id", "lang")


def measured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(pages(spark, sf_dir))


def headed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that begin with headings, by rules on the id."""
    i = F.col("doc_id")
    head = F.concat(
        F.when(i % 50 == 7, "Table of Contents 1\n").otherwise(""),
        F.when(i % 5 == 0, F.concat(F.lit("SECTION IV: - PART "), (i % 3).cast("string"), F.lit(" -\n"))).otherwise(""),
        F.when(i % 9 == 0, F.concat(F.lit("Section 3: Nested "), F.col("lang"), F.lit(".\n"))).otherwise(""),
        F.when(i % 4 == 1, F.concat(F.lit("- OVERVIEW OF "), F.upper("lang"), F.lit("\n"))).otherwise(""),
    )
    return pages(spark, sf_dir).withColumn("text", F.concat(head, "text"))


def noisy_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a running title, a label that repeats and printed numbers; the language is the section."""
    n = F.col("page_number").cast("string")
    head = F.concat(F.lit("Report of "), F.col("document_id"), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.upper("lang"), F.lit(" TEXTS\n"))).otherwise(""))
    foot = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\nPage "), n, F.lit(" of 400"))).otherwise(F.concat(F.lit("\n"), n))
    return pages(spark, sf_dir).select(
        "document_id", "page_number", F.concat(head, "text", foot).alias("text"), F.when(F.col("lang") != "es", F.concat(F.upper("lang"), F.lit(" texts"))).alias("section"), F.lit(None).cast("string").alias("subsection")
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text a chunk of its own."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("position"), F.col("text").alias("content"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a supplier sold as a document: pages of 40 lines, most of them rows of tables; titles, headers, blank lines and
    prose come by rules on the order, and every fifth page is of another section."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    i, r = F.col("l_orderkey"), F.col("l_orderkey") % 13
    line = (
        F.when(r == 0, F.concat(F.lit("Parts Of Order "), (i % 7).cast("string"))).when(r == 1, "Particulars").when(r == 2, "")
        .when(r == 3, "All of these were sold in the ordinary course of business, as the supplier has told us in the year.").when((r == 4) & (i % 3 == 0), "As we have seen.")
        .otherwise(F.concat_ws(" ", F.lit("Part sold"), F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")))
    )
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.row_number().over(order) - 1).alias("at"), line.alias("line"))
    pages_ = lines.groupBy("l_suppkey", (F.floor(F.col("at") / 40) + 1).cast("int").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return pages_.select(
        F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("document_id"), "page_number", F.array_join(F.transform("x", lambda l: l["line"]), "\n").alias("text"),  # noqa: E741
        F.when(F.col("page_number") % 5 == 0, "NOTES").otherwise("SALES").alias("section"), F.concat(F.lit("Sheet "), F.floor(F.col("page_number") / 3).cast("string")).alias("subsection"),
    )


PAGES_SQL = "pages_in AS (SELECT source AS document_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_number, text, CAST(doc_id % 3 AS INTEGER) AS image_count, doc_id, lang FROM documents)"

HEADED_SQL = PAGES_SQL + """, headed AS (
  SELECT document_id, page_number, (CASE WHEN doc_id % 50 = 7 THEN 'Table of Contents 1' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 5 = 0 THEN 'SECTION IV: - PART ' || (doc_id % 3) || ' -' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 9 = 0 THEN 'Section 3: Nested ' || lang || '.' || chr(10) ELSE '' END)
    || (CASE WHEN doc_id % 4 = 1 THEN '- OVERVIEW OF ' || upper(lang) || chr(10) ELSE '' END) || text AS text
  FROM pages_in)"""

NOISY_SQL = PAGES_SQL + """, noisy AS (
  SELECT document_id, page_number, 'Report of ' || document_id || chr(10) || (CASE WHEN doc_id % 2 = 0 THEN upper(lang) || ' TEXTS' || chr(10) ELSE '' END) || text
    || (CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Page ' || page_number || ' of 400' ELSE chr(10) || page_number END) AS text,
    CASE WHEN lang <> 'es' THEN upper(lang) || ' texts' END AS section
  FROM pages_in)"""

SHEETS_SQL = """sold AS (SELECT l_suppkey, l_orderkey AS i, l_orderkey % 13 AS r, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS place FROM lineitem),
sheets AS (SELECT 'supplier' || l_suppkey AS document_id, CAST(place // 40 + 1 AS INTEGER) AS page_number, CAST(place % 40 AS INTEGER) AS line_no, CASE WHEN (place // 40 + 1) % 5 = 0 THEN 'NOTES' ELSE 'SALES' END AS section,
    CASE WHEN r = 0 THEN 'Parts Of Order ' || (i % 7) WHEN r = 1 THEN 'Particulars' WHEN r = 2 THEN ''
    WHEN r = 3 THEN 'All of these were sold in the ordinary course of business, as the supplier has told us in the year.' WHEN r = 4 AND i % 3 = 0 THEN 'As we have seen.'
    ELSE 'Part sold ' || q || ' ' || n END AS line FROM sold)"""
