"""Chunks of documents: lines are classified by Column expressions, one grouped stage packs each section run, and
window functions number the result."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import scratch
from docengine.functions import text as fn
from docengine.operators import regions
from docengine.operators.chunk_rules import SENTENCE_START, Lines, chunks, paragraphs
from docengine.operators.clean import clean, edge_marks, with_kind
from docengine.schemas import ChunkConfig

RAW = "document_id string, run long, seq int, kind string, section string, subsection string, body string, pages array<int>"
ARROW = pa.schema([("document_id", pa.string()), ("run", pa.int64()), ("seq", pa.int32()), ("kind", pa.string()), ("section", pa.string()), ("subsection", pa.string()), ("body", pa.string()), ("pages", pa.list_(pa.int32()))])


def section_runs(lines: DataFrame) -> DataFrame:
    """Lines with ``run``, the number of the stretch of equal section that they are in."""
    order = Window.partitionBy("document_id").orderBy("page_number", "line_no")
    new = F.when(F.row_number().over(order) == 1, 0).otherwise((~F.col("section").eqNullSafe(F.lag("section").over(order))).cast("int"))
    return lines.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: Rows that a task gives together, about.
MADE = 4096
MARKS = ("line", "page_number", "subsection", "kind", "short", "unit", "heading", "key")
UNITS = pa.schema([("document_id", pa.string()), ("run", pa.int64()), ("unit", pa.int32()), ("kind", pa.string()), ("subsection", pa.string()), ("n_lines", pa.int32()), ("text", pa.string())])


def marked_lines(lines: DataFrame) -> DataFrame:
    """Lines with all that the rules look at."""
    line, kind = F.col("line"), F.col("kind")
    return lines.withColumns({
        "short": (kind == "text") & fn.is_short(line), "unit": fn.is_unit_line(line), "key": F.when(kind == "hdr", fn.norm_key(line)),
        "heading": fn.is_chunk_heading(line, F.col("kind"), F.col("section"), F.col("subsection")),
    })


def _flags(pattern: str) -> re.Pattern:
    return re.compile(re.sub(r"^\(\?[a-zA-Z]+\)", "", pattern), re.I)


INTROS, OUTROS = _flags(fn.INTRO), _flags(fn.OUTRO)


def _lines_of(columns: list[list]) -> Lines | None:
    """The lines of a run (``MARKS``), from the first full one to the last."""
    a, b = 0, len(columns[0])
    while a < b and not columns[0][a].strip():
        a += 1
    while a < b and not columns[0][b - 1].strip():
        b -= 1
    return Lines(*(v[a:b] for v in columns), INTROS, OUTROS) if a < b else None


def _given(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), kinds)], schema=kinds)


def by_run(lines: DataFrame, make: Callable[[str, int, str | None, Lines], list[tuple]], schema: str, kinds: pa.Schema) -> DataFrame:
    """The rows that ``make`` gives for the document, number, section and lines of each run.  Runs stream through a task one
    after the other in sorted order, many to a batch: most are much smaller than what a group of its own costs."""
    keys = ["document_id", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], []

        def done() -> None:
            x = _lines_of(held) if held else None
            if x:
                rows.extend(make(*key, x))

        for batch in batches:
            document, number, *columns = (c.to_pylist() for c in batch.columns)
            whose = list(zip(document, number))
            edges = [0, *(k for k in range(1, len(whose)) if whose[k] != whose[k - 1]), len(whose)]
            for a, b in pairwise(edges):
                if key is not None and whose[a : a + 1] == [key[:2]]:
                    for old, new in zip(held, columns[1:]):
                        old += new[a:b]
                elif b > a:
                    done()
                    key, held = (*whose[a], columns[0][a]), [v[a:b] for v in columns[1:]]
                if len(rows) >= MADE:
                    yield _given(rows, kinds)
                    rows.clear()
        done()
        if rows:
            yield _given(rows, kinds)

    ordered = lines.repartition(*keys).sortWithinPartitions(*keys, "page_number", "line_no")
    return ordered.select(*keys, "section", *MARKS).mapInArrow(run, schema)


def paragraph_units(lines: DataFrame) -> DataFrame:
    """Paragraphs and headings of runs of lines, as chunks are made of them, without regard to tables:
    ``document_id, run, unit, kind, subsection, n_lines, text``."""

    def cut(document: str, number: int, section: str | None, x: Lines) -> list[tuple]:
        found = paragraphs(x, 0, len(x.text))
        return [(document, number, k, u.kind, u.subsection, u.part.text.count("\n") + 1, u.part.text) for k, u in enumerate(found, 1)]

    return by_run(marked_lines(lines), cut, "document_id string, run long, unit int, kind string, subsection string, n_lines int, text string", UNITS)


def sentence_counts(texts: DataFrame) -> DataFrame:
    """``id, n_sentences`` of ``id, text``: at these ends long paragraphs are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(SENTENCE_START.split(t)) if t is not None else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], names=["id", "n_sentences"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n_sentences int")


def raw_chunks(lines: DataFrame, config: ChunkConfig = ChunkConfig(), *, spread: bool = False) -> DataFrame:
    """Bodies and pages of the chunks of cleaned lines, with or without their ``run``, before numbering.  With ``spread`` a run is taken apart where nothing
    goes on, so a task holds a part of it; the lines are written once to the shared folder for that."""
    marked = marked_lines(_spread(lines, config) if spread else lines if "run" in lines.columns else section_runs(lines))

    def pack(document: str, number: int, section: str | None, x: Lines) -> list[tuple]:
        return [(document, number, k, c.kind, section, c.subsection, c.body, sorted(c.pages)) for k, c in enumerate(chunks(x, section, config))]

    return by_run(marked, pack, RAW, ARROW)


def _spread(lines: DataFrame, config: ChunkConfig) -> DataFrame:
    """Lines with a ``run`` that tells the parts of a run apart, in their order."""
    lines = scratch.stored(lines, "lines")
    placed = lines.join(regions.page_runs(lines), ["document_id", "page_number"])
    cut = regions.parts(placed, config)
    return placed.join(cut, ["document_id", "run", "page_number"]).withColumn("run", F.shiftleft("run", 32) + F.col("part")).drop("part")


def number(raw: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks under their headings, empty ones left out, numbered from 0 in each document.

    A document can have most of the chunks, so these are written once and dealt by runs: how many come before a run is
    counted without their texts, and goes as a row that stands above the run's chunks."""
    kept = raw.withColumn("content", _content(config)).where((F.col("content") != "") & (F.size("pages") > 0))
    pages = F.array_sort(F.array_distinct("pages"))
    kept = scratch.stored(kept.select("document_id", "run", "seq", "content", pages.alias("pages"), "section", "subsection"), "chunks")
    upto = F.sum("n").over(Window.partitionBy("document_id").orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    starts = kept.groupBy("document_id", "run").agg(F.count("*").alias("n")).select("document_id", "run", (upto - F.col("n")).alias("before"))
    own = Window.partitionBy("document_id", "run").orderBy(F.col("before").asc_nulls_last(), "seq")
    index = F.max("before").over(own) + F.row_number().over(own) - 2
    return _named(kept.unionByName(starts, allowMissingColumns=True).withColumn("chunk_index", index.cast("int")).where("before is null"))


def _content(config: ChunkConfig) -> Column:
    return fn.strip(fn.with_headings(F.col("body"), F.col("section"), F.col("subsection")) if config.prefix_headings else F.col("body"))


def _named(numbered: DataFrame) -> DataFrame:
    return numbered.select(
        fn.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "content", F.get("pages", F.lit(0)).alias("page_start"),
        F.get("pages", F.size("pages") - 1).alias("page_end"), "pages", "section", "subsection", "chunk_index",
    )


def chunk_documents(pages: DataFrame, config: ChunkConfig = ChunkConfig(), *, spread: bool = False) -> DataFrame:
    """Chunks of all documents, from their labelled pages.  ``spread`` is for documents that are longer than a task should
    hold; it gives the same chunks."""
    return number(raw_chunks(clean(pages, config, runs=not spread), config, spread=spread), config)


#: Lines that a block of pages has at most, if it has more than one page.
BLOCK_LINES = 1 << 16
BLOCKS = pa.schema([("document_id", pa.string()), ("page_number", pa.int32()), ("section", pa.string()), ("subsection", pa.string()), ("at", pa.list_(pa.int32())), ("line", pa.string())])
#: What the rules look at that is the same for equal lines of pages of equal labels, and what ``edge_marks`` adds.
LINE_MARKS = ("line", "kind", "short", "unit", "heading", "key", "boilerplate", "printed_number")


def line_blocks(pages: DataFrame) -> DataFrame:
    """Pages in blocks of equal labels: a row for each different ``line`` of a block, then one for each page, with the places
    ``at`` which its lines are among them.  What lines say is computed on the former, however often a block has them."""

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, said = batch.column(4).offsets, batch.column(4).values
        begin = starts[0].as_py()
        coded = said.slice(begin, starts[-1].as_py() - begin).dictionary_encode()
        at = pa.ListArray.from_arrays(pa.array(starts.to_numpy() - begin, pa.int32()), coded.indices.cast(pa.int32()))
        lines, many = coded.dictionary.cast(pa.string()), batch.num_rows
        above = [pa.nulls(len(lines), f.type) for f in BLOCKS]
        labels = [pa.repeat(batch.column(k)[0].cast(pa.string()), len(lines) + many) for k in (2, 3)]
        own = [pa.concat_arrays([a, b.cast(a.type)]) for a, b in ((above[0], batch.column(0)), (above[1], batch.column(1)), (above[4], at))]
        return pa.RecordBatch.from_arrays([*own[:2], *labels, own[2], pa.concat_arrays([lines, pa.nulls(many, pa.string())])], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = [batch.column(k).dictionary_encode("encode").indices.to_numpy() for k in (2, 3)]
            order = np.lexsort(labels)
            new = np.flatnonzero(np.any([np.diff(v[order]) != 0 for v in labels], axis=0)) + 1
            batch = batch.take(pa.array(order))
            starts, made = batch.column(4).offsets.to_numpy(), []
            for a, b in pairwise([0, *new.tolist(), batch.num_rows]):
                while a < b:
                    end = min(b, max(a + 1, int(np.searchsorted(starts, int(starts[a]) + BLOCK_LINES, "right")) - 1))
                    made.append(block(batch.slice(a, end - a)))
                    a = end
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    lined = pages.where("document_id is not null and page_number is not null and text is not null")
    rows = lined.select("document_id", F.col("page_number").cast("int"), "section", "subsection", fn.chunker_lines(F.col("text")).alias("lines"))
    return rows.mapInArrow(run, "document_id string, page_number int, section string, subsection string, at array<int>, line string")


def chunk_pages(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of documents of one page each, as ``chunk_documents`` gives them.  Nothing repeats across pages and a page is one
    run, so each is cleaned, cut and numbered where it is, without a shuffle."""
    if config.repeat_min_pages < 2:  # what a page alone has counts as repeated
        return chunk_documents(pages, config)

    def stay(at: list[int], seen: dict[str, list]) -> list[int]:
        full = [k for k, i in enumerate(at) if seen["line"][i]]
        ends = {k for r, k in enumerate(full) if r < config.edge_lines or r >= len(full) - config.edge_lines}
        drop = {k for k in ends if seen["boilerplate"][at[k]] or k in (full[0], full[-1]) and seen["printed_number"][at[k]]}
        return [i for k, i in enumerate(at) if k not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {name: [] for name in LINE_MARKS}
        rows, filling, edged = [], True, False
        for batch in batches:
            of_line = batch.column("at").is_null().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(of_line)) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(edges) if batch.num_rows else ():
                part = batch.slice(a, b - a)
                if of_line[a]:
                    for name in LINE_MARKS:
                        more = part.column(name).to_pylist()
                        seen[name] = seen[name] + more if filling else more
                    filling, edged = True, any(seen["boilerplate"]) or any(seen["printed_number"])
                    continue
                filling = False
                columns = [seen[name] for name in ("line", "kind", "short", "unit", "heading", "key")]
                starts = part.column("at").offsets.to_pylist()
                places = part.column("at").values.slice(starts[0], starts[-1] - starts[0]).to_pylist()
                section, subsection = part.column("section")[0].as_py(), part.column("subsection")[0].as_py()
                for k, (document, page) in enumerate(zip(part.column("document_id").to_pylist(), part.column("page_number").to_pylist())):
                    at = places[starts[k] - starts[0] : starts[k + 1] - starts[0]]
                    at = stay(at, seen) if edged else at
                    text, *marks = (list(map(v.__getitem__, at)) for v in columns)
                    x = _lines_of([text, [page] * len(at), [subsection] * len(at), *marks])
                    rows += [(document, 0, n, c.kind, section, c.subsection, c.body, sorted(c.pages)) for n, c in enumerate(chunks(x, section, config))] if x else []
                    if len(rows) >= MADE:
                        yield _given(rows, ARROW)
                        rows = []
        if rows:
            yield _given(rows, ARROW)

    marked = edge_marks(marked_lines(with_kind(line_blocks(pages))))
    raw = marked.select("document_id", "page_number", "section", "subsection", "at", *LINE_MARKS).mapInArrow(run, RAW)
    # bodies are never blank and have pages, so a chunk's place in its run is its number
    return _named(raw.select("document_id", _content(config).alias("content"), "pages", "section", "subsection", F.col("seq").alias("chunk_index")))
