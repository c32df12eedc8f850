"""Runs stream through tasks, and what is dear is computed for the lines that need it."""

import re

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as fn
from docengine.operators import chunk, clean
from docengine.plans import tables
from docengine.schemas import ChunkConfig

PAGES = "document_id string, page_number int, text string, section string, subsection string"


def pages(spark):
    body = "\n".join(f"Sentence {k} of a page that says a thing or two." for k in range(9))
    rows = [(f"d{d}", p, f"Running title\n{body}\n{p}", ("A", "A", "B", None)[p % 4], None) for d in range(40) for p in range(1, 9)]
    # a page between two of another section of which nothing is left
    rows += [("gone", p, "Running title\n3" if p == 3 else f"Running title\n{body}\n{p}", "B" if p == 3 else "A", None) for p in range(1, 9)]
    return spark.createDataFrame(rows, PAGES)


def test_runs_are_those_of_the_lines_that_are_left(spark):
    keys = ["document_id", "page_number", "line_no", "run"]
    own = clean.clean(pages(spark), runs=True).select(keys).collect()
    wanted = chunk.section_runs(clean.clean(pages(spark))).select(keys).collect()
    assert sorted(own) == sorted(wanted) and {r.run for r in own if r.document_id == "gone"} == {0}


def test_runs_stream_across_batches(spark):
    """No group of its own for a run, and the same chunks however rows are cut into batches."""
    lines = clean.clean(pages(spark), runs=True)
    made = chunk.raw_chunks(lines)
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().toString()
    wanted = sorted(map(repr, made.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(repr, chunk.raw_chunks(lines).collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_strip_takes_what_white_space_matches(spark):
    codes = spark.range(1, 0x3100).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    x = F.concat("c", F.lit("a b"), "c")
    by_pattern = F.regexp_replace(x, rf"^{fn.WS}|{fn.WS}$", "")
    assert codes.where(fn.strip(x) != by_pattern).count() == 0 and codes.where(fn.strip(x) == "a b").count() == len(fn.BLANKS)
    assert len(set(fn.BLANKS)) == len(fn.BLANKS) and re.fullmatch(r"[\s]+", fn.BLANKS)


def test_kinds_are_told_by_the_last_character_first(spark):
    line = ["", "Total 1 2", "Total 1, 2,", "a (1) (2)", "12", "x -", "x – —", "x 5% 6%", "٣ ٤", "a ٣ ٤", "Mar 31, 2024 and later", "x" * 200 + " 1 2", "x" * 200, "1 2 x", "FY2024"]
    found = clean.with_kind(spark.createDataFrame([(t,) for t in line], "line string")).collect()
    assert [r.kind for r in found] == ["blank", "row", "row", "row", "num", "text", "row", "row", "num", "row", "hdr", "row", "text", "text", "hdr"]


def test_encoding_holds_few_rows_at_a_time(spark, monkeypatch):
    """Vectors are made in slices, may take the text's place, and are the same however they are cut."""
    from docengine.operators import dense
    from docengine.sources import documents

    texts = spark.range(0, 3000, 1, 1).select(F.col("id"), F.col("id").alias("position"), F.concat_ws(" ", F.lit("word"), (F.col("id") % 37).cast("string"), (F.col("id") % 11).cast("string")).alias("text"))
    encode = documents.hashed_encoder(32)
    own = encode(texts, "text", "text")
    assert own.columns == ["id", "position", "text"]
    sizes = own.select(F.col("id")).mapInArrow(lambda batches: iter(list(batches)), "id long").count()
    assert sizes == 3000 and own.join(encode(texts, "text"), "id").where(own["text"] != F.col("embedding")).count() == 0
    index, asked = encode(texts, "text"), encode(texts.where("id < 20"), "text").select(F.col("id").alias("query_id"), "embedding")
    found = sorted(map(tuple, dense.search(index, asked).collect()))
    monkeypatch.setattr(dense, "STORED", 100)
    assert sorted(map(tuple, dense.search(index, asked).collect())) == found and len(found) == 200


def test_a_fit_makes_slots_once(spark, monkeypatch):
    """Its passes read what the first has written, which is deleted then."""
    from docengine import scratch
    from docengine.operators import latent

    seen, delete = [], scratch.delete
    monkeypatch.setattr(latent.scratch, "delete", lambda s, path: (seen.append(path), delete(s, path)))
    texts = spark.range(60).select(F.concat_ws(" ", F.lit("word"), (F.col("id") % 7).cast("string"), (F.col("id") % 5).cast("string")).alias("content"))
    assert latent.fit(texts, width=4, slots=64).directions.shape == (64, 4)
    assert len(seen) == 1 and not scratch.exists(spark, seen[0])


@pytest.fixture
def as_dealt(spark):
    """Partitions stay as shuffles deal them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield lambda df: df.groupBy(F.spark_partition_id()).count().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_of_one_source_are_numbered_in_many_tasks(spark, as_dealt, tmp_path):
    rows = [(i, f"text {i}", "en", "all") for i in range(200)] + [(7, "again", "en", "all"), (None, "no id", "en", "all"), (3, "no source", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = tables.pages(spark, str(tmp_path))
    assert as_dealt(found) > 1
    numbers = sorted((r.page_number, r.doc_id) for r in found.where("document_id = 'all'").collect())
    assert [n for n, _ in numbers] == list(range(1, 203)) and [d for _, d in numbers] == [None, *sorted([*range(200), 7])]
    assert [(r.page_number, r.text) for r in found.where("document_id is null").collect()] == [(1, "no source")]


def test_chunks_of_one_document_are_numbered_in_many_tasks(spark, as_dealt):
    rows = [("A", run, seq, "", "S", None, "" if seq == 1 else f"{run} {seq}", [run + 1]) for run in range(60) for seq in range(3)] + [(None, 0, 0, "", "S", None, "x", [1])]
    found = chunk.number(spark.createDataFrame(rows, chunk.RAW), ChunkConfig(prefix_headings=False))
    assert as_dealt(found) > 1
    said = sorted((r.chunk_index, r.content) for r in found.where("document_id = 'A'").collect())
    assert said == list(enumerate(f"{run} {seq}" for run in range(60) for seq in (0, 2)))
    assert [r.chunk_index for r in found.where("document_id is null").collect()] == [0]


def test_edges_are_taken_from_texts_once(spark):
    """Once for the edges, once for the lines."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([("A", k, f"Title\nwords {chr(96 + k)}\n{k}", "S", None) for k in range(1, 9)], PAGES)
    assert clean.clean(pages.mapInArrow(count, pages.schema)).count() == 8
    assert seen.value == 16


def test_kinds_are_told_of_different_lines(spark):
    """Equal lines meet before their kind is computed."""
    from docengine.plans import queries

    plan = queries.line_kinds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and "Aggregate [line" in plan


def test_parts_compose_states_once(spark):
    """The steps after it read what it has written."""
    from docengine.operators import regions

    lines = clean.with_kind(clean.page_lines(pages(spark).where("document_id < 'd2'")))
    placed = lines.join(regions.page_runs(lines), ["document_id", "page_number"])
    found = regions.parts(placed)
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == placed.select(*regions.PAGE).distinct().count()
