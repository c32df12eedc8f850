"""Documents as JSON files, ``<folder>/<document_id>.json``, through a data source writer with commit and abort.

A task writes its documents page by page into a hidden folder of the write; no document is held in memory.  Only when all
tasks are done are the files moved under their names, each replacing the document of that name; a task that fails, or is
run twice, leaves nothing but files of the hidden folder, which commit and abort delete.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docengine.schemas import PAGE

HEAD = ("document_id", "company_name", "document_type", "source_file", "page_count")
FIELDS = tuple(x.split()[0] for x in PAGE.split(", "))


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, str]  # name to the file in the hidden folder


def _json(value: object, indent: int) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n" + " " * indent)


class JsonDocumentWriter(DataSourceArrowWriter):
    """Takes rows of a document and a page, clustered by document and in order of the pages; a row without a page number is a
    document without pages."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.stage = path.rstrip("/"), overwrite, f".writing-{uuid.uuid4().hex}"

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = self._fs()
        files: dict[str, str] = {}
        stream, last, first = None, None, True

        def close() -> None:
            if stream is not None:
                stream.write(("]\n}" if first else "\n  ]\n}").encode())
                stream.close()

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    name = row["document_id"]
                    if stream is None or name != last:
                        close()
                        if not name or "/" in name or name.startswith((".", "_")):
                            raise ValueError(f"document_id can't be a file name: {name!r}")
                        if name in files:
                            raise ValueError(f"rows of {name} are not together")
                        files[name] = f"{root}/{self.stage}/{uuid.uuid4().hex}.json"
                        fs.create_dir(f"{root}/{self.stage}", recursive=True)
                        stream, last, first = fs.open_output_stream(files[name]), name, True
                        head = "".join(f"  {json.dumps(c)}: {_json(row[c], 2)},\n" for c in HEAD)
                        stream.write(f'{{\n{head}  "pages": ['.encode())
                    if row["page_number"] is not None:
                        page = {c: row[c] for c in FIELDS}
                        stream.write((("\n    " if first else ",\n    ") + _json(page, 4)).encode())
                        first = False
            close()
            stream = None
        finally:
            if stream is not None:
                stream.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = self._fs()
        files = {name: at for m in messages if isinstance(m, Written) for name, at in m.files.items()}
        if sum(len(m.files) for m in messages if isinstance(m, Written)) > len(files):
            self.abort(messages)
            raise ValueError("a document is in several partitions")
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if info.type == pafs.FileType.File and info.extension == "json" and posixpath.basename(info.path)[:-5] not in files:
                    fs.delete_file(info.path)
        for name, at in files.items():
            fs.move(at, f"{root}/{name}.json")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = self._fs()
        if fs.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.stage}")


class JsonDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_documents"

    def schema(self) -> str:
        return ", ".join([f"{c} {'int' if c == 'page_count' else 'string'}" for c in HEAD] + [x for x in PAGE.split(", ") if not x.startswith("document_id")])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return JsonDocumentWriter(self.options["path"], overwrite)


def save_pages(documents: DataFrame, pages: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A file for each of ``documents``, with its ``pages`` in order.  Files of other documents stay, unless ``overwrite``."""
    spark: SparkSession = documents.sparkSession
    spark.dataSource.register(JsonDocuments)
    rest = [c for c in FIELDS if c != "document_id"]
    rows = documents.select(*HEAD).join(pages.select("document_id", *rest), "document_id", "left").select(*HEAD, *rest)
    ordered = rows.repartition("document_id").sortWithinPartitions("document_id", "page_number")
    ordered.write.format("json_documents").mode("overwrite" if overwrite else "append").save(path)


def save_documents(documents: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """As ``save_pages``, of documents that hold their pages as an array."""
    rest = [c for c in FIELDS if c != "document_id"]
    pages = documents.select("document_id", F.explode("pages").alias("p")).select("document_id", *[F.col(f"p.{c}").alias(c) for c in rest])
    save_pages(documents, pages, path, overwrite=overwrite)
