"""The grouped steps of chunking as SQL table functions.

``register`` adds them to a session:

    SELECT * FROM chunk_lines(TABLE(marked) PARTITION BY (document_id, run) ORDER BY (page_number, line_no))

where ``marked`` are lines as ``chunk.marked_lines`` gives them.  ``paragraph_lines`` gives paragraphs and headings instead.
Spark partitions and orders the rows; a call sees one run.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from docengine.functions import text as fn
from docengine.operators.chunk import MARKS, RAW, _flags
from docengine.operators.chunk_rules import Lines, chunks, paragraphs
from docengine.schemas import ChunkConfig

UNITS = "document_id string, run long, unit int, kind string, subsection string, n_lines int, text string"


class _Run:
    def __init__(self) -> None:
        self.rows: list[Row] = []

    def eval(self, row: Row) -> None:
        self.rows.append(row)

    def lines(self) -> Lines | None:
        full = [k for k, r in enumerate(self.rows) if r["line"].strip()]
        if not full:
            return None
        kept = self.rows[full[0] : full[-1] + 1]
        return Lines(*([r[c] for r in kept] for c in MARKS), _flags(fn.INTRO), _flags(fn.OUTRO))


class ChunkLines(_Run):
    """Chunks of a run, as ``chunk.raw_chunks`` makes them with default settings."""

    def terminate(self) -> Iterator[tuple]:
        x = self.lines()
        for k, c in enumerate(chunks(x, self.rows[0]["section"], ChunkConfig()) if x else []):
            yield self.rows[0]["document_id"], self.rows[0]["run"], k, c.kind, self.rows[0]["section"], c.subsection, c.body, sorted(c.pages)


class ParagraphLines(_Run):
    """Paragraphs and headings of a run."""

    def terminate(self) -> Iterator[tuple]:
        x = self.lines()
        for k, u in enumerate(paragraphs(x, 0, len(x.text)) if x else [], 1):
            yield self.rows[0]["document_id"], self.rows[0]["run"], k, u.kind, u.subsection, u.part.text.count("\n") + 1, u.part.text


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_lines", udtf(ChunkLines, returnType=RAW))
    spark.udtf.register("paragraph_lines", udtf(ParagraphLines, returnType=UNITS))
