"""Noise removal: running headers and footers, repeated labels and printed page numbers, by counting across pages.

Everything here is joins, aggregates and windows over lines; a document of any length is spread over its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine import scratch
from docengine.functions import text as fn
from docengine.schemas import ChunkConfig

PAGE = ("document_id", "page_number")


def page_lines(pages: DataFrame) -> DataFrame:
    """One row a line, ``line_no`` from 0, blank ones included."""
    return pages.select(*PAGE, "section", "subsection", F.posexplode(fn.chunker_lines(F.col("text"))).alias("line_no", "line"))


def _full(lines: str) -> Column:
    """The non-blank lines of an array, with their places."""
    return F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda x: x["line"] != "")


def edged_pages(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """One row a page: ``many``, the number of its lines, and ``edges``, the first and last non-blank ones with their ranks."""
    lined = pages.select(*PAGE, "section", "subsection", fn.chunker_lines(F.col("text")).alias("_lines"))
    full = lined.select(*PAGE, "section", "subsection", F.size("_lines").alias("many"), _full("_lines").alias("_full"))
    n = F.size("_full")
    ranked = F.transform("_full", lambda x, k: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), (k + 1).cast("long").alias("rank_down"), (n - k).cast("long").alias("rank_up")))
    outer = F.filter(ranked, lambda x: (x["rank_down"] <= config.edge_lines) | (x["rank_up"] <= config.edge_lines))
    return full.select(*PAGE, "section", "subsection", "many", outer.alias("edges"))


def _each_edge(paged: DataFrame) -> DataFrame:
    return paged.select(*PAGE, "section", F.explode("edges").alias("e")).select(*PAGE, "section", "e.*")


def edges(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The first and last non-blank lines of each page, with ``rank_down`` and ``rank_up`` among these."""
    return _each_edge(edged_pages(pages.withColumn("subsection", F.lit(None).cast("string")), config))


def _shape() -> Column:
    """The shape of an edge line that can repeat, else null."""
    shape = fn.shape(F.col("line"))
    return F.when((F.length("line") <= 100) & ~shape.isin("", "#"), shape)


def edge_shapes(edged: DataFrame) -> DataFrame:
    """The distinct shapes of each page's edge lines that can repeat."""
    return edged.select(*PAGE, "section", _shape().alias("shape")).where("shape is not null").distinct()


def repeated_shapes(paged: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Of pages with their edges (``edged_pages``) the shapes on enough pages of a document, or of one of its sections:
    ``document_id, section, shape, everywhere`` (``section`` says nothing where ``everywhere`` is true).

    A page counts under each of its shapes and once under none; one aggregate by grouping sets gives all four counts, of
    shapes and of pages, by section and by document, and windows over these short rows, which share one exchange, bring
    them together."""
    shapes = F.filter(F.transform(F.filter("edges", lambda e: F.length(e["line"]) <= 100), lambda e: fn.shape(e["line"])), lambda s: ~s.isin("", "#"))
    each = F.explode(F.array_distinct(F.concat(shapes, F.array(F.lit(None).cast("string"))))).alias("shape")
    marked = paged.where(F.size("edges") > 0).select(*PAGE, "section", each)
    keys = ["document_id", "section", "shape"]
    counted = marked.groupingSets([keys, ["document_id", "shape"]], *keys).agg(F.count("*").alias("n"), (F.grouping("section") == 1).alias("whole"))
    most = lambda condition, *by: F.max(F.when(condition, F.col("n"))).over(Window.partitionBy(*by))
    pages, whole = F.col("shape").isNull(), F.col("whole")
    told = counted.withColumn("all_pages", most(pages & whole, "document_id")).withColumn("all", most(whole, "document_id", "shape")).withColumn("section_pages", most(pages & ~whole, "document_id", "section"))
    at_least = lambda share, column: F.greatest(F.lit(config.repeat_min_pages), F.ceil(share * F.col(column)))
    everywhere = F.col("all") >= at_least(config.repeat_global_ratio, "all_pages")
    here = F.col("n") >= at_least(config.repeat_ratio, "section_pages")
    return told.where(~whole & ~pages).select("document_id", "section", "shape", everywhere.alias("everywhere"), here.alias("here")).where("everywhere or here").select("document_id", "section", "shape", "everywhere")


def running_labels(pages: DataFrame) -> DataFrame:
    """For each label's key the number of pages that carry it and the first of them."""
    keys = F.array_except(F.array_distinct(F.array(fn.norm_key(F.col("section")), fn.norm_key(F.col("subsection")))), F.array(F.lit("")))
    return pages.select(*PAGE, F.explode(keys).alias("key")).distinct().groupBy("document_id", "key").agg(F.count("*").alias("label_pages"), F.min("page_number").alias("first_page"))


def _value(number: str) -> Column:
    return F.when(F.col(number).rlike(r"(?U)^\d+$"), F.col(number).try_cast("long"))


def _says_number(value: Column, line: Column) -> Column:
    """Whether a line that can be a page number is said to be one: a numeral, or after the word."""
    return value.isNull() | fn.strip(line).rlike("(?iu)^page")


def edge_marks(lines: DataFrame) -> DataFrame:
    """Lines with what drops an edge line of a document of one page: ``boilerplate`` on any edge, ``printed_number`` on the
    first or last full line."""
    line = F.col("line")
    numbered = lines.withColumn("_number", fn.page_number_candidate(line)).withColumn("_value", _value("_number"))
    return numbered.withColumns({
        "boilerplate": (F.length(line) <= 100) & fn.is_boilerplate(line) & ~F.col("kind").isin("num", "row", "hdr"),
        "printed_number": F.col("_number").isNotNull() & _says_number(F.col("_value"), line),
    }).drop("_number", "_value")


def page_number_drops(edged: DataFrame) -> DataFrame:
    """Lines that are printed page numbers: said to be, or one apart from the neighbouring page's at the same place."""
    ends = edged.where((F.col("rank_down") == 1) | (F.col("rank_up") == 1))
    place = F.array_compact(F.array(F.when(F.col("rank_down") == 1, "first"), F.when(F.col("rank_up") == 1, "last")))
    found = ends.select(*PAGE, "line_no", "line", F.explode(place).alias("place"), fn.page_number_candidate(F.col("line")).alias("number")).where(F.col("number").isNotNull())
    valued = found.withColumn("value", _value("number"))
    near = Window.partitionBy("document_id", "place").orderBy("page_number")

    def follows(step: int):
        page, value = F.lag("page_number", step).over(near), F.lag("value", step).over(near)
        return F.coalesce((page == F.col("page_number") - step) & (value == F.col("value") - step), F.lit(False))

    return valued.withColumn("drop", _says_number(F.col("value"), F.col("line")) | follows(1) | follows(-1)).where("drop").select(*PAGE, "line_no").distinct()


def with_kind(lines: DataFrame) -> DataFrame:
    """Stripped lines with their ``kind``; words and values are computed once each."""
    line = F.col("line")
    valued = fn.ends_as_value(line)
    staged = lines.withColumn("_words", F.when(valued | (F.length(line) <= fn.HEADER_CHARS), fn.tokens(line))).withColumn("_values", F.when(valued, F.transform("_words", fn.is_value)))
    return staged.withColumn("kind", fn.line_kind(F.col("line"), F.col("_words"), F.col("_values"))).drop("_words", "_values")


def _marks(pages: DataFrame, edged: DataFrame, config: ChunkConfig) -> DataFrame:
    """For each page what its edge lines must not be: ``shapes``, ``keys`` and places (``numbers``).  A shape is on a share
    of pages and a page has a few edge lines, so a page's arrays are short however long the document."""
    repeated = repeated_shapes(pages, config)
    everywhere = repeated.where("everywhere").groupBy("document_id").agg(F.collect_set("shape").alias("in_all"))
    here = repeated.where("not everywhere").groupBy("document_id", "section").agg(F.collect_set("shape").alias("in_section")).select(F.col("document_id").alias("d"), F.col("section").alias("s"), "in_section")
    label = F.explode(F.array_distinct(F.array(fn.norm_key(F.col("section")), fn.norm_key(F.col("subsection")))))
    running = running_labels(pages).where(F.col("label_pages") >= config.repeat_min_pages)
    again = pages.select(*PAGE, label.alias("key")).join(running, ["document_id", "key"]).where("page_number <> first_page").groupBy(*PAGE).agg(F.collect_set("key").alias("keys"))
    numbers = page_number_drops(edged).groupBy(*PAGE).agg(F.collect_set("line_no").alias("numbers"))
    placed = pages.select(*PAGE, "section").join(everywhere, "document_id", "left").join(here, (F.col("document_id") == F.col("d")) & F.col("section").eqNullSafe(F.col("s")), "left")
    none = F.array().cast("array<string>")
    shapes = F.concat(F.coalesce("in_all", none), F.coalesce("in_section", none))
    return placed.select(*PAGE, shapes.alias("shapes")).join(again, list(PAGE), "left").join(numbers, list(PAGE), "left")


def page_runs(pages: DataFrame) -> DataFrame:
    """``pages``, of which each has lines, with ``run``, the number of the stretch of equal section that they are in."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    new = F.when(F.row_number().over(order) == 1, 0).otherwise((~F.col("section").eqNullSafe(F.lag("section").over(order))).cast("int"))
    return pages.withColumn("_new", new).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _drops(paged: DataFrame, config: ChunkConfig) -> DataFrame:
    """For each page (``edged_pages``) the numbers of the lines to drop (``drops``, null if there are none), which are edge lines
    all.  The kind is computed where it decides."""
    edged = _each_edge(paged)
    met = edged.select(*PAGE, "line_no", "line").join(_marks(paged, edged, config), list(PAGE))
    has = lambda array, x: F.coalesce(F.array_contains(array, x), F.lit(False))
    running = (F.length("line") <= 100) & (has("shapes", fn.shape(F.col("line"))) | fn.is_boilerplate(F.col("line")))
    begin = fn.norm_key(F.substring("line", 1, 16))  # of few lines the whole key is needed
    label = F.coalesce(F.exists("keys", lambda k: F.startswith(k, begin)), F.lit(False)) & has("keys", F.nullif(fn.norm_key(F.col("line")), F.lit("")))
    told = with_kind(met.select(*PAGE, "line_no", F.when(running, F.col("line")).alias("line"), (label | has("numbers", F.col("line_no"))).alias("said")))
    dropped = F.when(F.col("said") | F.col("line").isNotNull() & ~F.col("kind").isin("num", "row", "hdr"), F.col("line_no"))
    return told.select(*PAGE, dropped.alias("dropped")).groupBy(*PAGE).agg(F.collect_set("dropped").alias("drops"))


def clean(pages: DataFrame, config: ChunkConfig = ChunkConfig(), *, runs: bool = False) -> DataFrame:
    """The lines that are left, as ``page_lines`` gives them, with their ``kind``, and with ``runs`` also the ``run`` of
    ``chunk.section_runs``.  What to drop, and runs, are decided on edge lines, which are written once to the shared folder;
    texts meet it as whole pages, and kinds are computed for the lines that are left."""
    paged = scratch.stored(edged_pages(pages, config), "edges")
    decided = paged.select(*PAGE, "section", "many").join(_drops(paged, config), list(PAGE), "left")
    if runs:
        decided = page_runs(decided.where(F.col("many") > F.coalesce(F.size("drops"), F.lit(0))))
    own = ["run"] if runs else []
    lined = pages.select(*PAGE, "section", "subsection", "text").join(decided.select(*PAGE, "drops", *own), list(PAGE))
    lines = lined.select(*PAGE, "section", "subsection", "drops", *own, F.posexplode(fn.chunker_lines(F.col("text"))).alias("line_no", "line"))
    kept = lines.where(~F.coalesce(F.array_contains("drops", F.col("line_no")), F.lit(False)))
    return with_kind(kept).select(*PAGE, "section", "subsection", "line_no", "line", "kind", *own)
