"""Sections and subsections: headings found on each page, then carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as fn


def page_headings(pages: DataFrame) -> DataFrame:
    """``pages`` with ``major`` and ``minor``, the headings that the page itself shows, and ``is_contents``."""
    lined = pages.withColumn("_lines", fn.detector_lines(F.col("text")))
    contents = fn.is_contents_page(F.col("_lines"))
    first = lambda lines: F.get(F.filter(lines, lambda x: x.isNotNull()), F.lit(0))
    minor = F.transform("_lines", lambda x: F.when(fn.major_section(x).isNull(), F.coalesce(fn.nested_section(x), F.when(fn.is_upper_heading(x), fn.heading(x)))))
    return lined.withColumns({
        "is_contents": contents,
        "major": F.when(~contents, first(F.transform("_lines", fn.major_section))),
        "minor": F.when(~contents, first(minor)),
    }).drop("_lines")


def detect(pages: DataFrame) -> DataFrame:
    """``pages`` with ``section`` and ``subsection``.  A page's major heading opens a segment, even if it repeats the
    current one; subsections are carried forward within a segment only, and there are none before the first."""
    shown = page_headings(pages.drop("section", "subsection"))
    so_far = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    placed = shown.withColumns({"_segment": F.count("major").over(so_far), "section": F.last("major", ignorenulls=True).over(so_far)})
    within = Window.partitionBy("document_id", "_segment").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    minor = F.last(F.when(F.col("_segment") > 0, F.col("minor")), ignorenulls=True).over(within)
    return placed.withColumn("subsection", minor).drop("_segment", "major", "minor", "is_contents")
