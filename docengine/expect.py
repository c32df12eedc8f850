"""Expectations: rows that break a rule, collected as a DataFrame or raised as an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.schemas import DOCUMENT_TYPES, FLAGS, METHODS


def violations(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row (``rule`` and the keys) for each row of ``df`` and rule that isn't true there."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def require(broken: DataFrame, error: type[Exception] = ValueError, message: str = "violated: {rule}") -> None:
    """Raise for the first violation, if there is one."""
    if row := broken.first():
        raise error(message.format(**row.asDict()))


def unique(df: DataFrame, column: str, message: str = "Duplicate {0}: {1}") -> None:
    again = df.groupBy(column).count().where("count > 1").orderBy(column).first()
    if again:
        raise ValueError(message.format(column, again[0]))


def page_rules() -> dict[str, Column]:
    counts = [F.coalesce(F.col(c) >= 0, F.lit(True)) for c in ("character_count", "word_count", "image_count")]
    return {
        "page_number": F.col("page_number") >= 1,
        "extraction_method": F.col("extraction_method").isin(*METHODS),
        "quality_flag": F.col("quality_flag").isin(*FLAGS),
        "counts": reduce(Column.__and__, counts),
    }


def document_rules() -> dict[str, Column]:
    return {"document_type": F.col("document_type").isin(*DOCUMENT_TYPES), "page_count": F.col("page_count") >= 0}


def chunk_rules() -> dict[str, Column]:
    """What every chunk satisfies."""
    return {
        "content": F.length(F.trim("content")) > 0,
        "pages": (F.size("pages") > 0) & (F.col("pages") == F.array_sort(F.array_distinct("pages"))),
        "page_start": F.col("page_start") == F.get("pages", F.lit(0)),
        "page_end": F.col("page_end") == F.get("pages", F.size("pages") - 1),
        "chunk_index": F.col("chunk_index") >= 0,
    }


def top_k(value: object) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError("top_k must be an integer")
    if value < 1:
        raise ValueError("top_k must be at least 1")
    return value


def query_text(value: object) -> str:
    if not isinstance(value, str):
        raise TypeError("query must be a string")
    if not value.strip():
        raise ValueError("query must not be empty")
    return value
