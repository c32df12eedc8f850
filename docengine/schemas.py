"""Record types of the engine, as DDL, and the chunker's settings."""

from __future__ import annotations

from dataclasses import dataclass

DOCUMENT_TYPES = ("RHP", "DRHP", "FINAL_PROSPECTUS")
METHODS = ("pymupdf", "ocr")
FLAGS = ("normal", "suspicious")

PAGE = (
    "document_id string, page_number int, text string, extraction_method string, character_count int, word_count int, image_count int, quality_flag string, "
    "section string, subsection string"
)
_PAGE_STRUCT = ", ".join(x.replace(" ", ": ", 1) for x in PAGE.split(", "))
DOCUMENT = f"document_id string, company_name string, document_type string, source_file string, page_count int, pages array<struct<{_PAGE_STRUCT}>>"
CHUNK = "chunk_id string, document_id string, content string, page_start int, page_end int, pages array<int>, section string, subsection string, chunk_index int"
MANIFEST = "pdf string, document_id string, company_name string, document_type string"
GOLD = (
    "document_id string, document_name string, evaluation_type string, notes string, "
    "cases array<struct<id: string, query: string, relevant_chunk_ids: array<string>, rationale: string>>"
)
VECTOR = "id string, position long, embedding array<float>"


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters; shares of pages for running lines."""

    max_chars: int = 2500
    min_chars: int = 400
    table_slack: float = 1.5
    max_context_chars: int = 600
    edge_lines: int = 3
    repeat_ratio: float = 0.25
    repeat_global_ratio: float = 0.10
    repeat_min_pages: int = 3
    min_table_data_lines: int = 3
    column_major_label_run: int = 6
    prefix_headings: bool = True
