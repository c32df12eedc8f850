"""Documents of one page each are chunked where they are, as ``chunk_documents`` chunks them."""

import random

import pytest

from docengine.operators.chunk import chunk_documents, chunk_pages
from docengine.plans.queries import QUERIES
from docengine.schemas import ChunkConfig

SCHEMA = "document_id string, page_number int, text string, section string, subsection string"
LINES = [
    "", "  ", " ", "12", "iv", "XL", "Page 3", "page - 4 -", "٣", "Page 3 of 9", "This page is intentionally left blank", "BUSINESS", "Our Plants", "Particulars", "(₹ in million)", "Mar 31, 2024", "2024",
    "Sales of goods 869.18 1,631.06", "Total gains 25.09 6.38", "Part sold 17 3", "Part sold 17 3", "Other gains", "1,604.50", "-", "We make pumps. We sell them abroad.", "The following table sets this out:",
    "Note: to be read together", "COSTS AND GAINS", "A line of words that goes on for a while, and then on. " * 12,
]
LABELS = [("BUSINESS", "Our Plants"), ("BUSINESS", None), (None, None), ("COSTS AND GAINS", "Costs and gains"), (None, "Notes")]


def documents() -> list[tuple]:
    r = random.Random(5)
    rows = [(f"d{k:03d}", 1 + k % 4, r.choice(["\n", "\n", "\r\n", "\f"]).join(r.choices(LINES, k=r.randint(1, 24))), *r.choice(LABELS)) for k in range(240)]
    alone = [(f"alone{k:03d}", 1, line, *LABELS[k % 5]) for k, line in enumerate(LINES)]
    same = [(f"same{k}", 1, "Sold Parts\nParticulars\nPart sold 17 3\nPart sold 17 3\nPart sold 17 3", "BUSINESS", None) for k in range(5)]
    return [*rows, *alone, *same, ("none", 1, None, "BUSINESS", None), (None, 1, "We make pumps.", "BUSINESS", None), ("unplaced", None, "We make pumps.", "BUSINESS", None)]


@pytest.mark.parametrize("config", [ChunkConfig(), ChunkConfig(max_chars=300, min_chars=80, edge_lines=1, prefix_headings=False), ChunkConfig(edge_lines=0, min_table_data_lines=1), ChunkConfig(repeat_min_pages=1)], ids=str)
def test_single_pages_give_the_chunks_of_documents(spark, config):
    df = spark.createDataFrame(documents(), SCHEMA).repartition(3)
    asked = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(asked)
    try:
        spark.conf.set(asked, "7")  # the lines of a block come in many batches
        found, wanted = chunk_pages(df, config).collect(), chunk_documents(df, config).collect()
    finally:
        spark.conf.set(asked, before)
    assert found[0].__fields__ == wanted[0].__fields__ and len(wanted) > 150
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_tables_of_orders_are_shuffled_once(spark):
    """An exchange brings the lines of an order together; its page is cut and numbered where it is."""
    plan = QUERIES["table_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan
