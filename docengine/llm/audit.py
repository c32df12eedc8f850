"""How filters overlap: what each removes in every order of applying them, and what is lost by it.

Duplicates are one of the filters and are decided before anything is counted, by partition refinement: documents are split
by their length in code points, then by the hashes of successive blocks of their text, each eight times as long as the one
before; a class of one document is dropped at once, so later blocks are looked at for few.  Texts of the classes that are
left are compared in full, and all but the documents of the smallest id are marked.

A document's failures are a mask of bits.  There are no more masks than two to the number of filters, so all orders are
worked out on counts by part and mask, whatever the size of the corpus.

Classes are counted and texts compared by aggregates that combine within each task, and their rows meet the classes under
a salted key, so a class with a third of all documents is spread over tasks.

Defined cases: a null text counts as empty, and has equals; a null ``lang`` is the part of the empty string; a document
without an id is a duplicate of none, and none is of it; rows that share an id and a text are no duplicates of each other;
documents without a label lose nothing good or toxic, and of several labels any counts; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.store import Store
from docengine.llm.words import slices, texts_as_bytes

#: Code points of the first block, how much longer each is than the one before, and how many hold any text.
FIRST, FACTOR, BLOCKS = 64, 8, 10
#: Rows of one class are dealt to so many keys.
SALT = 16
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(65, 91))


def blocks_of(text: Column, length: Column, bits: int = 64) -> Column:
    """Hashes of the blocks that a text has."""
    starts = [FIRST * (FACTOR**k - 1) // (FACTOR - 1) for k in range(BLOCKS + 1)]
    cut = lambda k: F.xxhash64(F.substring(text, starts[k] + 1, starts[k + 1] - starts[k]))
    parts = [F.when(length > starts[k], F.shiftrightunsigned(cut(k), 64 - bits) if bits < 64 else cut(k)) for k in range(BLOCKS)]
    return F.array_compact(F.array(*parts))


def _finer(cls: Column, block: Column) -> Column:
    return F.xxhash64(cls, block)


def class_of(length: Column, blocks: Column) -> Column:
    """The class at the end of all refinement."""
    return F.aggregate(blocks, length.cast("long"), _finer)


def _salted(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALT)).cast("int").alias("_salt")


def _over_salts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def refined(rows: DataFrame, store: Store) -> DataFrame:
    """Of ``doc_id, length, blocks`` the ``class`` of those that share all blocks with another."""
    left = rows.select("doc_id", F.col("length").cast("long").alias("class"), "blocks", _salted(F.col("doc_id")))
    for turn in range(BLOCKS + 1):
        several = left.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
        last, more = left, F.size("blocks") > 0
        left = left.join(_over_salts(several), ["class", "_salt"], "left_semi")
        left = left.select("doc_id", F.when(more, _finer(F.col("class"), F.get("blocks", F.lit(0)))).otherwise(F.col("class")).alias("class"), F.slice("blocks", 2, BLOCKS).alias("blocks"), "_salt", more.alias("open"))
        left = store.put(left, f"turn{turn}")
        if turn:
            store.drop(f"turn{turn - 1}")
        if left.where("open").isEmpty():
            break
        left = left.drop("open")
    return left.select("doc_id", "class")


def _classed(docs: DataFrame, bits: int) -> DataFrame:
    """Documents with ``length``, ``blocks`` and ``class``."""
    own = docs.withColumn("length", F.length("text"))
    return own.withColumn("blocks", blocks_of(F.col("text"), F.col("length"), bits)).withColumn("class", class_of(F.col("length"), F.col("blocks")))


def firsts(docs: DataFrame, rows: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """``(class, first)`` of the classes of one text on several rows, and ``(class, text, first)`` of those that several
    texts share by chance; ``first`` is the smallest id.  ``docs`` have their class, ``rows`` their blocks."""
    several = store.put(refined(rows, store).select("class").distinct(), "several")
    # equal texts of a task are one row before anything is shuffled
    same = docs.join(several, "class", "left_semi").groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    found = store.put(same.groupBy("class").agg(F.count("*").alias("texts"), F.min("first").alias("first")), "firsts")
    mixed = docs.join(found.where("texts > 1").select("class"), "class", "left_semi").groupBy("class", "text").agg(F.min("doc_id").alias("first"))
    return found.where("texts = 1").select("class", "first"), store.put(mixed, "mixed") if found.where("texts > 1").head(1) else found.limit(0).select("class", F.lit("").alias("text"), "first")


def _read(docs: DataFrame) -> DataFrame:
    """Documents with the mask of the filters on their own text."""
    columns = [f.name for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masks = []
            for text, points in zip(texts_as_bytes(batch.column("text")), batch.column("length").to_pylist()):
                words = text.split()
                fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * (len(text) - len(text.translate(None, UPPER))) > 3 * points, len(text.translate(None, SYMBOLS)) < len(text))
                masks.append(sum(f << k for k, f in enumerate(fails)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns if c != "text"), pa.array(masks, pa.int32())], names=[*(c for c in columns if c != "text"), "mask"])

    kept = "first long, " if "first" in columns else ""
    return docs.mapInArrow(run, "doc_id long, part string, length int, blocks array<long>, class long, " + kept + "mask int")


def failures(docs: DataFrame, *, bits: int = 64) -> DataFrame:
    """``doc_id, part, mask`` of every row (``doc_id``, ``lang``, ``text``): bit k is set if the k-th of the five filters
    fails.  ``bits`` of a block's hash are used; fewer make chance classes, for tests."""
    store = Store(docs.sparkSession, "audit")
    docs = _classed(docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")), bits)
    rows = store.put(_read(docs.select("doc_id", "part", "text", "length", "blocks", "class")), "rows")
    alone, mixed = firsts(docs.select("doc_id", "text", "class"), rows, store)
    found = rows.select("doc_id", "part", "mask", "class", _salted(F.col("doc_id"))).join(_over_salts(alone), ["class", "_salt"], "left")
    if not mixed.isEmpty():  # their rows are told apart by the text itself
        own = _read(docs.join(mixed, ["class", "text"]).select("doc_id", "part", "text", "length", "blocks", "class", "first"))
        found = found.join(mixed.select("class").distinct(), "class", "left_anti").select("doc_id", "part", "mask", "first").union(own.select("doc_id", "part", "mask", "first"))
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    marked = store.put(found.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(late, 16).otherwise(0)).alias("mask")), "failures")
    store.drop("rows", "several", "firsts", "mixed", *(f"turn{k}" for k in range(BLOCKS + 1)))
    return marked


def interactions(failed: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: documents ``kept`` after it, ``removed`` by it, ``redundant`` (failing
    it, removed before), ``unique_fails`` (failing nothing else), the ``good_lost`` and ``toxic_lost`` of those removed, and
    ``shapley``, what its filter removes summed over all orders.

    ``failed``: ``doc_id, part, mask``; ``labels``: ``doc_id, quality, toxic``."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    counted = failed.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [(order, step + 1, bit[f], sum(bit[g] for g in order[:step])) for order in map("".join, permutations(filters)) for step, f in enumerate(order)]
    listed = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("filter_order", "step", "own", "before"), s)]) for s in steps]))
    each = counted.select("part", "mask", "n", "good", "toxic", listed.alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    has = lambda c: F.col("mask").bitwiseAND(F.col(c)) != 0
    fails, gone = has("own"), has("before")
    total = lambda condition, c="n": F.coalesce(F.sum(F.when(condition, F.col(c))), F.lit(0)).alias
    # of the orders a document is removed by each of the filters it fails equally often
    share = F.col("n") * (F.lit(factorial(len(filters))) / F.bit_count("mask")).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone)("kept"), total(fails & ~gone)("removed"), total(fails & gone)("redundant"), total(F.col("mask") == F.col("own"))("unique_fails"),
        total(fails & ~gone, "good")("good_lost"), total(fails & ~gone, "toxic")("toxic_lost"), F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).alias("shapley"),
    )


_ORDERS = " UNION ALL ".join(f"SELECT '{f}' AS f, {1 << k} AS b" for k, f in enumerate(FILTERS))

SQL = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
m AS (SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
  + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY ALL),
f AS ({_ORDERS}),
o AS (SELECT [v.f, w.f, x.f, y.f, z.f] AS fs, [v.b, w.b, x.b, y.b, z.b] AS bs FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND len(list_distinct([v.b, w.b, x.b, y.b, z.b])) = 5),
s AS (SELECT array_to_string(fs, '') AS filter_order, step, fs[step] AS own_filter, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
e AS (SELECT part, filter_order, step, own_filter, CAST(sum(CASE WHEN mask & own = 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INTEGER) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own_filter) AS BIGINT) AS shapley FROM e"""
