"""JSON files of settings and gold, checked by the types that their values have.

A file is parsed as a variant, so a number isn't taken for the text it looks like.  Errors name the entry, from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine import scratch
from docengine.schemas import DOCUMENT_TYPES, MANIFEST


def kind(value: Column) -> Column:
    """STRING, BIGINT, OBJECT, ARRAY, VOID (a JSON null) and so on; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def parsed(spark: SparkSession, path: str, what: str) -> DataFrame:
    """One row with the file as a variant ``v``."""
    if not scratch.exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")
    found = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    if found.where("v is not null").isEmpty():
        raise ValueError(f"{what} is no JSON")
    return found


def entries(found: DataFrame, path: str = "$") -> DataFrame:
    """``entry`` from 1 and the values ``e`` of the list at a path; no row if there is no list."""
    listed = F.variant_get("v", path, "variant")
    typed = F.when(kind(listed) == "ARRAY", listed.cast("array<variant>"))
    return found.select(F.posexplode(typed).alias("at", "e")).select((F.col("at") + 1).alias("entry"), "e")


def _get(name: str) -> Column:
    return F.variant_get("e", f"$.{name}", "variant")


def _is_text(name: str) -> Column:
    return F.coalesce(kind(_get(name)) == "STRING", F.lit(False))


def _text(name: str) -> Column:
    return F.variant_get("e", f"$.{name}", "string")


def _require(rows: DataFrame, wrong: Column, noun: str) -> None:
    """Raise for the first entry that ``wrong``, a message or null, is said of."""
    bad = rows.select("entry", wrong.alias("wrong")).where("wrong is not null").orderBy("entry").first()
    if bad:
        raise ValueError(f"{noun} {bad['entry']}: {bad['wrong']}")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The ingestion manifest: a list of objects, all fields there and texts, known document types."""
    found = parsed(spark, path, "manifest")
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    rows = entries(found)
    if rows.isEmpty():
        raise ValueError("manifest must be a non-empty list of objects")
    # a field that isn't there has no value; one that is null has one, of no type
    missing = F.array_sort(F.array_compact(F.array(*[F.when(_get(n).isNull(), F.lit(n)) for n in names])))
    untyped = F.array_sort(F.array_compact(F.array(*[F.when(~_is_text(n), F.lit(n)) for n in names])))
    wrong = F.when(kind(F.col("e")) != "OBJECT", "must be an object").when(F.size(missing) > 0, F.concat(F.lit("missing fields "), F.array_join(missing, ", ")))
    wrong = wrong.when(F.size(untyped) > 0, F.concat(F.array_join(untyped, ", "), F.lit(" must be text")))
    wrong = wrong.when(~_text("document_type").isin(*DOCUMENT_TYPES), f"document_type must be one of {', '.join(DOCUMENT_TYPES)}")
    _require(rows, wrong, "entry")
    return rows.select(*[_text(n).alias(n) for n in names])


def load_gold(spark: SparkSession, path: str, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``cases`` (``case_id, query``) and ``gold`` (``case_id, chunk_id``) of a gold file.  Lenient reading takes what has
    the right type and leaves the rest null or out."""
    found = parsed(spark, path, "gold file")
    if strict and found.where(kind(F.col("v")) == "OBJECT").isEmpty():
        raise ValueError("gold must be an object")
    rows = entries(found, "$.cases")
    listed = F.when(kind(_get("relevant_chunk_ids")) == "ARRAY", _get("relevant_chunk_ids").cast("array<variant>"))
    ids = F.when(F.forall(listed, lambda x: F.coalesce(kind(x) == "STRING", F.lit(False))), listed.cast("array<string>"))
    if strict:
        if rows.isEmpty():
            raise ValueError("gold needs a non-empty list of cases")
        blank = lambda name: ~_is_text(name) | (F.trim(_text(name)) == "")
        wrong = F.when(kind(F.col("e")) != "OBJECT", "must be an object").when(blank("id"), "invalid id").when(blank("query"), "invalid query")
        wrong = wrong.when(F.coalesce(F.size(ids), F.lit(-1)) < 1, "invalid relevant_chunk_ids")
        _require(rows, wrong, "case")
    case = lambda name: F.when(_is_text(name), _text(name))
    return rows.select(case("id").alias("case_id"), case("query").alias("query")), rows.select(case("id").alias("case_id"), F.explode(ids).alias("chunk_id"))
