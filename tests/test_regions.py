"""Tables found in slices are those that the chunker finds in whole runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docengine.operators import chunk, chunk_rules, clean, regions
from docengine.schemas import ChunkConfig

#: Lines of every kind: blank, header, values, row, caption, title, prose and a line with a stop.
LINES = ["", "Particulars", "(₹ in million)", "12.5", "1,000 2,000", "Net sales 10 20", "a short caption", "Title Of It", "2024 Figures", "Some prose that goes on and on so that it is not taken for a caption of anything at all here, really.", "A sentence ends."]


def letters_of(r, n):
    return "".join(r.choice("bbhnnrrrccct") for _ in range(n))


def whole(letters):
    """The regions of letters by the chunker's expression: where each begins and ends, its last data included."""
    return [(m.start(), m.end()) for m in chunk_rules.REGION.finditer(letters)]


def test_slices_compose_to_the_whole():
    r = random.Random(8)
    for _ in range(3000):
        letters = letters_of(r, r.randrange(1, 40))
        cuts = sorted(r.sample(range(len(letters) + 1), r.randrange(0, min(6, len(letters)))))
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]
        state, found, at = regions.OUT, [], 0
        for k, part in enumerate(parts):
            ahead = "".join(parts[k + 1 :]).replace("b", "")[:2]
            for start, begins, data, stop, upto, full in regions.fragments(part, ahead, state):
                if begins:
                    found.append([at + start, 0, 0])
                found[-1][1] += data
                found[-1][2] = at + stop if stop >= 0 else found[-1][2]
            state = regions.passed(part, ahead)[state]
            at += len(part)
        wanted = []
        for a, b in whole(letters):
            places = [k + 1 for k in range(a, b) if letters[k] in "nr"]
            wanted.append([a, len(places), places[-1] if places else 0])
        assert found == wanted, letters


def test_what_is_ahead_is_the_next_two_full_lines():
    assert regions.walk("hbbcnb", "rt") == ["cn", "cn", "cn", "nr", "rt", "rt"] and regions.walk("bb", "") == ["", ""]


def documents(seed, n):
    r = random.Random(seed)
    for d in range(n):
        section = "A"
        for page in range(1, r.randrange(2, 9)):
            section = r.choice([section, section, section, "B", None])
            weights = r.choice([[1] * 11, [1, 1, 1, 3, 3, 9, 3, 2, 1, 1, 1], [2, 0, 0, 0, 0, 1, 3, 6, 2, 2, 2]])
            yield f"d{d}", page, "\n".join(r.choices(LINES, weights, k=r.randrange(1, 14))), section, r.choice(["S", "S", "T", None])


@pytest.fixture(scope="module")
def lines(spark):
    pages = spark.createDataFrame(list(documents(5, 120)), "document_id string, page_number int, text string, section string, subsection string")
    return chunk.section_runs(clean.with_kind(clean.page_lines(pages)))


@pytest.mark.parametrize("config", [ChunkConfig(), ChunkConfig(min_table_data_lines=1), ChunkConfig(min_table_data_lines=6)])
def test_tables_of_random_documents(lines, config):
    rows = {}
    for r in lines.select("document_id", "run", "page_number", "line_no", "kind", "line", F.lit(True).alias("x")).withColumn("short", regions.fn.is_short(F.col("line"))).collect():
        rows.setdefault((r.document_id, r.run), []).append(r)
    wanted = set()
    for key, own in rows.items():
        own.sort(key=lambda r: (r.page_number, r.line_no))
        none = [None] * len(own)
        x = chunk_rules.Lines([r.line for r in own], [r.page_number for r in own], none, [r.kind for r in own], [r.short for r in own], none, none, none, re.compile("a"), re.compile("a"))
        wanted |= {(*key, *t, own[t[1]].page_number) for t in chunk_rules.tables(x, config)}
    found = {tuple(r) for r in regions.table_regions(lines, config).collect()}
    assert found == wanted and len(wanted) > 40


def test_no_lines_have_no_tables(lines):
    assert regions.table_regions(lines.limit(0)).count() == 0


# ------------------------------------------------------------------ chunks of parts
def pages_of(spark, seed, n, length):
    """Documents with tables of many rows, paragraphs that introduce them and comment on them, headings, and subsections that
    change at any page."""
    r = random.Random(seed)
    words = "the firm sold its shares and bought land in the year as the board had set out".split()
    prose = lambda: " ".join(r.choices(words, k=r.randrange(4, 40))).capitalize() + r.choice([".", ".", ":", ""])
    rows = []
    for d in range(n):
        subsection = "S0"
        for page in range(1, r.randrange(3, length)):
            out = []
            for _ in range(r.randrange(1, 5)):
                kind = r.randrange(6)
                if kind == 0:
                    out += [r.choice(["Statement of Sales", "The following table shows sales:", "A SHOUTED HEADING"]), "Particulars", *[f"Item {r.choice('abc')} {r.randrange(99)} {r.randrange(99)}" for _ in range(r.randrange(2, 60))]]
                elif kind == 1:
                    out += ["Note: this should be read in conjunction with the rest.", ""]
                elif kind == 2:
                    out += [r.choice(["A SHOUTED HEADING", subsection or "", ""])]
                else:
                    out += [prose() for _ in range(r.randrange(1, 4))] + [""]
            subsection = r.choice([subsection, subsection, f"S{r.randrange(3)}", None])
            rows.append((f"d{d}", page, "\n".join(out), "SECTION ONE" if page < 9 else None, subsection))
    return spark.createDataFrame(rows, "document_id string, page_number int, text string, section string, subsection string")


@pytest.mark.parametrize("config", [ChunkConfig(), ChunkConfig(max_chars=500, min_chars=120, min_table_data_lines=2)])
def test_spread_documents_have_the_chunks_of_whole_ones(spark, config):
    pages = pages_of(spark, 2, 25, 24)
    once, spread = (sorted(map(repr, chunk.chunk_documents(pages, config, spread=s).collect())) for s in (False, True))
    assert once == spread and len(once) > 200
    lines = clean.clean(pages, config)
    placed = lines.join(regions.page_runs(lines), ["document_id", "page_number"])
    assert sorted(map(tuple, placed.select("document_id", "page_number", "line_no", "run").collect())) == sorted(map(tuple, chunk.section_runs(lines).select("document_id", "page_number", "line_no", "run").collect()))
    cut = regions.parts(placed, config)
    assert cut.select(F.max("part")).first()[0] >= 3


def test_a_long_document_goes_to_many_tasks(spark):
    """One document, one section: no group that a task packs holds more than a small share of the lines."""
    pages = spark.range(3000).select(F.lit("D").alias("document_id"), (F.col("id") + 1).cast("int").alias("page_number"), F.concat(F.lit("Some words of this page stand here."), F.repeat(F.lit("\nThey go on for a while and then they end."), 20)).alias("text"), F.lit("S").alias("section"), F.concat(F.lit("Part "), (F.col("id") / 10).cast("int").cast("string")).alias("subsection"))
    lines = clean.clean(pages)
    placed = lines.join(regions.page_runs(lines), ["document_id", "page_number"])
    sizes = placed.join(regions.parts(placed), ["document_id", "run", "page_number"]).groupBy("run", "part").count()
    assert sizes.count() == 300 and sizes.select(F.max("count")).first()[0] <= 0.01 * lines.count()


def test_table_functions_give_the_chunks_of_the_operators(spark):
    from docengine.functions import table_functions

    table_functions.register(spark)
    own = chunk.section_runs(clean.clean(pages_of(spark, 4, 8, 12)))
    chunk.marked_lines(own).createOrReplaceTempView("marked")
    call = "SELECT * FROM {}(TABLE(marked) PARTITION BY (document_id, run) ORDER BY (page_number, line_no))"
    for name, wanted in (("chunk_lines", chunk.raw_chunks(clean.clean(pages_of(spark, 4, 8, 12)))), ("paragraph_lines", chunk.paragraph_units(own))):
        found = spark.sql(call.format(name))
        assert sorted(map(repr, found.select(*wanted.columns).collect())) == sorted(map(repr, wanted.collect())) and not found.isEmpty()
    spark.catalog.dropTempView("marked")
