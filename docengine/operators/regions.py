"""Tables in documents of any length, by a scan in slices.

Where tables are is decided by an automaton that reads one letter a line.  A document, or a stretch of equal section in it,
can have more lines than a task should hold, so it is not read from its start: each page is a slice that gives the state it
would end in for every state it may begin in, these maps are composed in order of the pages, and then all pages are
labelled at once, each from the state it really begins in.  What the automaton looks ahead to, and the lines above a table
that may be its title, cross pages by windows over one row a page.

The states: outside a table, inside after a line of structure (a caption may follow), inside otherwise.  A caption outside
begins a table if data follow; inside, where no structure came just before, it needs data within two lines.

``parts`` then numbers stretches of a run that can be chunked on their own, because nothing that the chunker remembers
crosses them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import scratch
from docengine.functions import text as fn
from docengine.schemas import ChunkConfig

OUT, AFTER, IN = range(3)
RUN, PAGE = ["document_id", "run"], ["document_id", "run", "page_number"]
#: Lines above a table that a title is looked for in.
ABOVE = 3
TITLE = r"(?:T(?:Tb?|bT)|Tb?)$"
STRUCTURE, DATA = frozenset("hnr"), frozenset("nr")


def step(state: int, letter: str, ahead: str) -> int:
    """The state after a line; ``ahead`` begins with the next two lines that aren't blank."""
    if letter in STRUCTURE:
        return AFTER
    if letter == "b":
        return state
    if letter != "c":
        return OUT
    if state == AFTER or ahead[:1] in DATA and ahead:
        return IN
    return IN if state == IN and ahead[:1] in ("h", "c", "t") and ahead[1:2] in DATA and len(ahead) > 1 else OUT


def walk(letters: str, ahead: str) -> list[str]:
    """For each line what follows it, in two letters at most."""
    out, seen = [""] * len(letters), ahead[:2]
    for k in range(len(letters) - 1, -1, -1):
        out[k] = seen
        if letters[k] != "b":
            seen = (letters[k] + seen)[:2]
    return out


def passed(letters: str, ahead: str) -> tuple[int, int, int]:
    """The map of a slice: the state that it ends in for each state that it begins in."""
    states, follow = [OUT, AFTER, IN], walk(letters, ahead)
    for letter, after in zip(letters, follow):
        states = [step(s, letter, after) for s in states]
    return states[0], states[1], states[2]


def fragments(letters: str, ahead: str, state: int) -> list[tuple[int, bool, int, int, int, int]]:
    """The stretches of a slice inside a table: ``start``, whether it ``begins`` there, lines of data, the line after its
    last data (-1 if there is none), full lines up to that, and all full lines."""
    out, follow, inside = [], walk(letters, ahead), state != OUT
    start, begins, data, stop, upto, full = 0, False, 0, -1, 0, 0
    for k, letter in enumerate(letters):
        state = step(state, letter, follow[k])
        if state == OUT:
            if inside:
                out.append((start, begins, data, stop, upto, full))
            inside = False
            continue
        if not inside:
            inside, start, begins, data, stop, upto, full = True, k, True, 0, -1, 0, 0
        full += letter != "b"
        if letter in DATA:
            data, stop, upto = data + 1, k + 1, full
    return [*out, (start, begins, data, stop, upto, full)] if inside else out


def letter(kind: Column, line: Column) -> Column:
    """One letter a line, as ``chunk_rules`` reads them: a text short enough for a caption is a ``c``."""
    return F.when(kind == "blank", "b").when(kind == "hdr", "h").when(kind == "num", "n").when(kind == "row", "r").when(fn.is_short(line), "c").otherwise("t")


def title_letter(kind: Column, line: Column) -> Column:
    """``T`` where the line may be a table's title, ``b`` where it is blank, else ``x``."""
    t = fn.strip(line)
    first = F.substring(t, 1, 1)
    fits = (kind == "text") & (F.length(t) <= 100) & (first.rlike(r"^\p{IsUppercase}$") | first.rlike(r"(?U)^\d$")) & ~t.rlike("[.:;,]$")
    return F.when(t == "", "b").when(fits, "T").otherwise("x")


def slices(lines: DataFrame) -> DataFrame:
    """One row a page of lines (``kind`` and ``line``) with their ``run``: ``letters``, ``titles``, the ``ordinal`` of its first line
    in the run, and what comes ``ahead`` of it."""
    x = lines.select(*PAGE, "line_no", letter(F.col("kind"), F.col("line")).alias("l"), title_letter(F.col("kind"), F.col("line")).alias("t"))
    packed = x.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_no", "l", "t"))).alias("x"))
    own = packed.select(*PAGE, F.array_join(F.transform("x", lambda r: r["l"]), "").alias("letters"), F.array_join(F.transform("x", lambda r: r["t"]), "").alias("titles"))
    down, up = (Window.partitionBy(*RUN).orderBy(c) for c in (F.col("page_number"), F.desc("page_number")))
    head = F.nullif(F.substring(F.replace(F.col("letters"), F.lit("b")), 1, 2), F.lit(""))
    later = up.rowsBetween(Window.unboundedPreceding, -1)
    told = own.withColumn("head", head).withColumn("two", F.when(F.col("head").isNotNull(), F.substring(F.concat("head", F.coalesce(F.last("head", True).over(later), F.lit(""))), 1, 2)))
    before = F.concat(*[F.coalesce(F.lag("titles", k).over(down), F.lit("")) for k in range(ABOVE, 0, -1)])
    length = F.length("letters").cast("long")
    return told.select(
        *PAGE, "letters", "titles", F.coalesce(F.last("two", True).over(later), F.lit("")).alias("ahead"), F.substring(before, -ABOVE, ABOVE).alias("before"),
        (F.sum(length).over(down.rowsBetween(Window.unboundedPreceding, 0)) - length).alias("ordinal"),
    )


def entered(pages: DataFrame) -> DataFrame:
    """The slices with the ``state`` that each begins in: maps of slices in parallel, then their composition by runs, which
    reads three states a page."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [sum(s << 2 * k for k, s in enumerate(passed(x, a))) for x, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends, pa.int32())], names=[*PAGE, "ends"])

    def compose(group: pa.Table) -> pa.Table:
        group, state, states = group.sort_by("page_number"), OUT, []
        for ends in group["ends"].to_pylist():
            states.append(state)
            state = ends >> 2 * state & 3
        return group.select(PAGE).append_column("state", pa.array(states, pa.int32()))

    kinds = f"document_id string, run long, page_number {pages.schema['page_number'].dataType.simpleString()}"
    ends = pages.select(*PAGE, "letters", "ahead").mapInArrow(maps, f"{kinds}, ends int")
    return pages.join(ends.groupBy(*RUN).applyInArrow(compose, f"{kinds}, state int"), PAGE)


def regions(begun: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The tables: ``document_id, run, title, start, stop``, numbers of lines in the run from 0: where the title begins, the
    table's first line and the one after its last data; and ``page_number`` of the first line."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            for k, (letters, ahead, state, before, titles) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4, 9)))):
                found = fragments(letters, ahead, state)
                rows += [(*x, (before + titles[: x[0]])[-ABOVE:]) for x in found]
                at += [k] * len(found)
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            own = [c.take(pa.array(at, pa.int64())) for c in batch.columns[:4]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, kinds))], names=[*PAGE, "ordinal", "at", "begins", "data", "upto", "full_upto", "full", "above"])

    page = begun.schema["page_number"].dataType.simpleString()
    schema = f"document_id string, run long, page_number {page}, ordinal long, at long, begins boolean, data long, upto long, full_upto long, full long, above string"
    found = begun.select(*PAGE, "ordinal", "letters", "ahead", "state", "before", "titles").mapInArrow(label, schema)
    order = Window.partitionBy(*RUN).orderBy("page_number", "at").rowsBetween(Window.unboundedPreceding, 0)
    counted = found.withColumns({"region": F.sum(F.col("begins").cast("int")).over(order), "passed": F.sum("full").over(order) - F.col("full")})
    begin = F.struct("page_number", (F.col("ordinal") + F.col("at")).alias("start"), F.col("passed").alias("full"), "above")
    last = F.struct("page_number", (F.col("ordinal") + F.col("upto")).alias("stop"), (F.col("passed") + F.col("full_upto")).alias("full"))
    whole = counted.groupBy(*RUN, "region").agg(F.max(F.when(F.col("begins"), begin)).alias("b"), F.max(F.when(F.col("data") > 0, last)).alias("l"), F.sum("data").alias("data"))
    kept = whole.where((F.col("data") >= max(1, config.min_table_data_lines)) & (F.col("data") >= 0.35 * (F.col("l.full") - F.col("b.full"))))
    tables = kept.select(*RUN, F.col("b.page_number").alias("page_number"), F.col("b.start").alias("start"), F.col("l.stop").alias("stop"), F.col("b.above").alias("above"))
    floor = F.coalesce(F.lag("stop").over(Window.partitionBy(*RUN).orderBy("start")), F.lit(0))
    room = F.least(F.lit(ABOVE), F.col("start") - floor).cast("int")
    title = F.length(F.regexp_extract(F.right("above", room), TITLE, 0))
    return tables.select(*RUN, (F.col("start") - title).alias("title"), "start", "stop", "page_number")


def table_regions(lines: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The tables of lines (``document_id, run, page_number, line_no, kind, line``)."""
    return regions(entered(slices(lines)), config)


def page_runs(lines: DataFrame) -> DataFrame:
    """``document_id, page_number, run`` of the pages that have lines: ``chunk.section_runs``, decided on one row a page."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    own = lines.select("document_id", "page_number", "section").distinct()
    new = F.when(F.row_number().over(order) == 1, 0).otherwise((~F.col("section").eqNullSafe(F.lag("section").over(order))).cast("int"))
    return own.withColumn("new", new).select("document_id", "page_number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


def parts(lines: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``document_id, run, page_number, part``: pages of a run with the number of the part that they are in.  A part begins with
    a page of another subsection whose first full line is outside all tables and titles, after a line that is no heading
    and outside all tables.  There no table, no context of one, no waiting heading and no chunk that is being filled or
    merged goes on.  A run whose subsection never changes is one part.  Slices with their states are written once, as three
    steps read them."""
    begun = scratch.stored(entered(slices(lines)), "slices")
    tables = regions(begun, config)
    full = F.col("kind") != "blank"
    heading = fn.is_chunk_heading(F.col("line"), F.col("kind"), F.col("section"), F.col("subsection"))
    ends = lines.groupBy(*PAGE).agg(F.max("subsection").alias("subsection"), F.min(F.when(full, F.col("line_no"))).alias("line_no"), F.max_by(heading, F.when(full, F.col("line_no"))).alias("heading"))
    first = F.instr(F.translate("letters", "hnrct", "xxxxx"), "x") - 1
    pages = begun.join(ends.where("line_no is not null"), PAGE).select(*RUN, "page_number", "subsection", "heading", "state", (F.col("ordinal") + first).alias("place"), F.lit(1).alias("order"), F.lit(None).cast("long").alias("title"))
    down = Window.partitionBy(*RUN).orderBy("page_number")
    before = F.lag(F.struct("subsection", "heading")).over(down)
    asked = pages.withColumn("fits", before.isNotNull() & ~before["subsection"].eqNullSafe(F.col("subsection")) & ~before["heading"] & (F.col("state") == OUT))
    starts = tables.select(*RUN, "page_number", F.col("start").alias("place"), F.lit(0).alias("order"), "title", F.lit(False).alias("fits"))
    both = asked.select(*RUN, "page_number", "place", "order", "title", "fits").unionByName(starts)
    following = Window.partitionBy(*RUN).orderBy(F.desc("place"), "order").rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("next", F.last("title", True).over(following)).where("order = 1")
    cuts = told.select(*PAGE, (F.col("fits") & (F.col("next").isNull() | (F.col("next") > F.col("place")))).cast("int").alias("cut"))
    numbered = begun.select(*PAGE).join(cuts, PAGE, "left")
    return numbered.select(*PAGE, F.sum(F.coalesce("cut", F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("part"))
