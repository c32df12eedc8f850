"""Page quality, replacement by recognised text, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as fn


def measure(pages: DataFrame, method: str = "pymupdf") -> DataFrame:
    """Counts and the quality flag of extracted pages (``document_id, page_number, text, image_count``)."""
    body = F.coalesce("text", F.lit(""))
    return pages.withColumns({
        "text": body,
        "extraction_method": F.lit(method),
        "character_count": F.length(body),
        "word_count": fn.word_count(body),
        "quality_flag": fn.native_quality(body, F.coalesce("image_count", F.lit(0))),
    })


def suspicious(pages: DataFrame) -> DataFrame:
    """The pages that recognition is worth trying on; only these should reach it."""
    return pages.where(F.col("quality_flag") == "suspicious")


def merge_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Suspicious pages replaced, as whole rows, where recognised text (``document_id, page_number, text``) is
    usable and says more than the native text."""
    found = recognised.select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("_text"))
    flag = fn.ocr_quality(F.col("_text"))
    wins = F.coalesce((F.col("quality_flag") == "suspicious") & fn.ocr_wins(flag, F.col("_text"), F.col("text")), F.lit(False))
    new = {
        "text": F.col("_text"), "extraction_method": F.lit("ocr"), "character_count": F.length("_text"), "word_count": fn.word_count(F.col("_text")), "quality_flag": flag,
    }
    joined = pages.join(found, ["document_id", "page_number"], "left").withColumn("_wins", wins)
    return joined.select(*[F.when(F.col("_wins"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in pages.columns])


def summary(pages: DataFrame) -> DataFrame:
    """One row a document: pages, native and recognised ones, those in a section, those still suspicious."""
    count = lambda condition: F.count_if(condition).cast("long")
    return pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        count(F.col("extraction_method") != "ocr").alias("native_pages"),
        count(F.col("extraction_method") == "ocr").alias("ocr_pages"),
        count(F.col("section").isNotNull()).alias("sectioned_pages"),
        count(F.col("quality_flag") == "suspicious").alias("suspicious_pages"),
    )


def suspicious_preview(pages: DataFrame, most: int = 200) -> DataFrame:
    return suspicious(pages).select("document_id", "page_number", F.substring(fn.collapse(F.col("text")), 1, most).alias("preview"))


def integrity(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents (``document_id, page_count``) whose pages aren't just those from 1 to that count."""
    found = pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.countDistinct("page_number").alias("distinct_pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page")
    )
    joined = documents.select("document_id", "page_count").join(found, "document_id", "full")
    right = (F.col("page_count") == F.coalesce("pages", F.lit(0))) & ((F.col("page_count") == 0) | (F.col("distinct_pages") == F.col("pages")) & (F.col("first_page") == 1) & (F.col("last_page") == F.col("pages")))
    return joined.where(~F.coalesce(right, F.lit(False))).select("document_id", "page_count", F.coalesce("pages", F.lit(0)).alias("pages"))


def transitions(pages: DataFrame) -> DataFrame:
    """Pages whose section differs from the one before; before the first page there is none."""
    before = F.lag("section").over(Window.partitionBy("document_id").orderBy("page_number"))
    return pages.select("document_id", "page_number", "section", before.alias("_before")).where(~F.col("section").eqNullSafe(F.col("_before"))).drop("_before")
