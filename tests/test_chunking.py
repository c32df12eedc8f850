"""Chunking of made-up pages: tables, boundaries, running lines, headings and sizes."""

import pytest

from docengine import expect
from docengine.operators.chunk import chunk_documents
from docengine.schemas import ChunkConfig

SCHEMA = "document_id string, page_number int, text string, section string, subsection string"
TITLE, SECTION = "Statement of Cash Held", "FINANCIAL SUMMARY"
HEAD = ["(₹ in million)", "Particulars", "Sep 30, 2025", "Mar 31, 2025", "Mar 31, 2024", "Mar 31, 2023"]
FIRST = ["Sales of goods", "869.18", "1,631.06", "1,537.61", "967.96", "Other gains 25.09 6.38 14.19 2.32"]
SECOND = ["Total gains 894.27 1,637.44 1,551.80 970.28", "Result before tax 111.59 199.09 125.55 72.50"]


@pytest.fixture
def chunk(spark):
    def run(pages, config=ChunkConfig(), document="D"):
        rows = [(document, k, *p) for k, p in enumerate(pages, 1)]
        df = chunk_documents(spark.createDataFrame(rows, SCHEMA), config)
        found = sorted(df.collect(), key=lambda r: r.chunk_index)
        assert [c.chunk_index for c in found] == list(range(len(found)))
        assert not expect.violations(df, expect.chunk_rules(), "chunk_id").collect()
        return found

    return run


def test_paragraphs_go_under_their_headings(chunk):
    (c,) = chunk([("We make pumps.\nWe run two plants.\n\nWe sell them abroad.", "BUSINESS", "Overview")])
    assert c.content == "BUSINESS\nOverview\nWe make pumps.\nWe run two plants.\n\nWe sell them abroad."
    assert (c.chunk_id, c.section, c.subsection, c.pages) == ("D_chunk_0000", "BUSINESS", "Overview", [1])


def test_table_on_one_page(chunk):
    (c,) = chunk([("\n".join([TITLE, *HEAD, *FIRST, *SECOND]), SECTION, TITLE)])
    lines = c.content.split("\n")
    assert f"Table title: {TITLE} (₹ in million)" in lines
    assert "Columns: Particulars | Sep 30, 2025 | Mar 31, 2025 | Mar 31, 2024 | Mar 31, 2023" in lines
    assert "Sales of goods | 869.18 | 1,631.06 | 1,537.61 | 967.96" in lines
    assert "Other gains | 25.09 | 6.38 | 14.19 | 2.32" in lines


def test_table_over_two_pages_has_its_head_once(chunk):
    found = chunk([("Some words.", "OTHER", None), ("\n".join([TITLE, *HEAD, *FIRST]), SECTION, TITLE), ("\n".join([*HEAD[1:], *SECOND]), SECTION, TITLE)])
    (c,) = [c for c in found if "Table title" in c.content]
    assert c.pages == [2, 3] and c.content.count("Sep 30, 2025") == 1 and "Result before tax | 111.59" in c.content


def test_long_text_splits_at_sentences(chunk):
    text = " ".join(f"The Company finished project number {i} in the year and opened new capacity." for i in range(60))
    found = chunk([(text[:2000], SECTION, "Growth"), (text[2000:], SECTION, "Growth")], ChunkConfig(max_chars=700, min_chars=200))
    assert len(found) > 3 and all(len(c.content) <= 760 and c.content.startswith(SECTION) for c in found)


def test_sections_do_not_mix(chunk):
    found = chunk([("Demand may fall.", "RISKS", "Inner"), ("The offer is of new shares.", "OFFER", None)])
    assert [(c.section, c.pages) for c in found] == [("RISKS", [1]), ("OFFER", [2])]


def test_running_lines_and_page_numbers_go(chunk):
    words = ["pumps", "exports", "copper", "checks", "freight", "staff"]
    pages = [(f"ABC Limited - Prospectus\n" + "\n".join(f"Text {i} on {words[i]} point {j} in detail." for j in range(4)) + f"\nPage {45 + i} of 400\n{45 + i}", "BUSINESS", "Overview") for i in range(6)]
    found = chunk(pages)
    text = "\n".join(c.content for c in found)
    assert "Prospectus" not in text and "of 400" not in text and "\n45\n" not in text
    assert all(f"Text {i} on" in text for i in range(6)) and {p for c in found for p in c.pages} == set(range(1, 7))


def test_lone_number_is_a_value(chunk):
    (c,) = chunk([("\n".join([TITLE, *HEAD, *FIRST[:5], "Number of staff", "72"]), SECTION, TITLE)])
    assert "Number of staff | 72" in c.content


def test_heading_is_not_said_twice(chunk):
    (c,) = chunk([(SECTION + "\nSales rose.", SECTION, None)])
    assert c.content.count(SECTION) == 1


def test_text_stays_as_recognised(chunk):
    (c,) = chunk([("Plain words.", "BUSINESS", "Overview"), ("Sales fr0m 1,63l.06 m1llion", "BUSINESS", "Overview")])
    assert "Sales fr0m 1,63l.06 m1llion" in c.content and c.pages == [1, 2]


def test_large_table_splits_and_repeats_its_head(chunk):
    rows = [f"Item {chr(97 + i // 26)}{chr(97 + i % 26)} {i}.10 {i}.20 {i}.30 {i}.40" for i in range(70)]
    pages = [("\n".join([TITLE, *HEAD, *rows[:25]]), SECTION, TITLE), ("\n".join(rows[25:50]), SECTION, TITLE), ("\n".join(rows[50:]), SECTION, TITLE)]
    found = chunk(pages, ChunkConfig(max_chars=900, min_chars=200))
    assert len(found) > 2 and all(f"Table title: {TITLE}" in c.content and "Columns: Particulars" in c.content for c in found)
    text = "\n".join(c.content for c in found)
    assert all(f"| {i}.10 | {i}.20 | {i}.30 | {i}.40" in text for i in range(70))
    assert found[0].page_start == 1 and found[-1].page_end == 3


def test_table_takes_its_context_along(chunk):
    text = "\n".join(["A word on marketing.", "", "The following table shows the cash:", TITLE, *HEAD, *FIRST, *SECOND, "", "This should be read in conjunction with the notes to the accounts.", "", "A word on dividends."])
    found = chunk([(text, SECTION, TITLE)])
    (c,) = [c for c in found if "Table title" in c.content]
    assert "The following table shows" in c.content and "read in conjunction" in c.content
    assert "marketing" not in c.content and "dividends" not in c.content


def test_heading_at_the_foot_of_a_page_travels_on(chunk):
    found = chunk([("We hold some firms.\nGROUP STRUCTURE", "BUSINESS", "Overview"), ("Our firms and what they do are told here.", "BUSINESS", "Structure")])
    assert any("GROUP STRUCTURE" in c.content and "what they do" in c.content for c in found)
    assert not any(c.content.endswith("GROUP STRUCTURE") for c in found)


def test_numbers_start_again_in_each_document(spark):
    rows = [("A", 1, "Words of A.", "S", None), ("B", 1, "Words of B.", "S", None)]
    found = chunk_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((c.document_id, c.chunk_index, c.chunk_id) for c in found) == [("A", 0, "A_chunk_0000"), ("B", 0, "B_chunk_0000")]
