"""Files of pages, read by their full path inside tasks: a data source, and functions over a manifest.

Only ids and paths are dealt to tasks.  A task opens the files it was dealt, one at a time, and gives their pages on as the
extractor yields them, so no file's content is ever in a shuffle.  A file that isn't there, is a folder or can't be read
gives one row with an error in place of pages; ``raise_error`` makes an exception of it.

Paths are local ones that all executors see, or URIs that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docengine.functions.text import ocr_quality
from docengine.operators.pages import measure, suspicious

#: Files that one task reads at least, where there are many.
FILES = 8
#: Pages in one batch.
PAGES = 256
FOUND = "document_id string, page_number int, text string, image_count int, error string, sha256 string"
ERRORS: dict[str, type[Exception]] = {"FileNotFoundError": FileNotFoundError, "ValueError": ValueError}


class Extractor(Protocol):
    """Reads the pages of a file: a text and a number of images each.  Raises ValueError for one it can't open."""

    def __call__(self, content: bytes) -> Iterable[tuple[str, int]]: ...


class Recogniser(Protocol):
    """Reads one page, by its number from 1, as an image."""

    def __call__(self, content: bytes, page_number: int) -> str: ...


def form_feed_pages(content: bytes) -> Iterable[tuple[str, int]]:
    """The built-in extractor: plain text with a form feed between pages."""
    return [(page, 0) for page in content.decode("utf-8").split("\f")]


class Page(NamedTuple):
    document_id: str
    page_number: int | None
    text: str | None
    image_count: int | None
    error: str | None
    sha256: str | None


# ------------------------------------------------------------------ one file
def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def file_info(path: str) -> pafs.FileInfo:
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such file: {path}")
    if info.type == pafs.FileType.Directory:
        raise ValueError(f"not a file: {path}")
    return info


def content_of(path: str) -> bytes:
    """The file's bytes; a ``FileNotFoundError`` or ``ValueError`` says why there are none."""
    file_info(path)
    fs, at = _opened(path)
    try:
        with fs.open_input_stream(at) as stream:
            return stream.read()
    except OSError as e:
        raise ValueError(f"can't be read: {path}: {e}") from e


def pages_of_file(document_id: str, path: str, extract: Extractor) -> Iterator[Page]:
    """The pages of one file in order, or one row with an error.  An error after some pages stands for the whole file."""
    try:
        content = content_of(path)
        digest = hashlib.sha256(content).hexdigest()
        for k, (text, images) in enumerate(extract(content), 1):
            yield Page(document_id, k, text, images, None, digest)
    except Exception as e:  # whatever an extractor raises is this file's failure, not the job's
        kind = "FileNotFoundError" if isinstance(e, FileNotFoundError) else "ValueError"
        yield Page(document_id, None, None, None, f"{kind}: {e}", None)


def raise_error(error: str) -> None:
    kind, _, message = error.partition(": ")
    raise ERRORS.get(kind, ValueError)(message)


# ------------------------------------------------------------------ the data source
class Slice(InputPartition):
    def __init__(self, entries: list[tuple[str, str]]):
        self.entries = entries


def resolved(path: str, folder: str) -> str:
    return path if "://" in path or path.startswith("/") else f"{folder.rstrip('/')}/{path}"


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], extract: Extractor):
        self.manifest, self.folder, self.extract = options["path"], options.get("folder", "."), extract
        self.files = int(options.get("files_per_partition", FILES))

    def partitions(self) -> list[InputPartition]:
        listed = json.loads(content_of(self.manifest))
        entries = [(e["document_id"], resolved(e["pdf"], self.folder)) for e in listed]
        return [Slice(entries[k : k + self.files]) for k in range(0, len(entries), self.files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Slice)
        for document_id, path in partition.entries:
            yield from pages_of_file(document_id, path, self.extract)


def paged_files(extract: Extractor = form_feed_pages) -> type[DataSource]:
    """A data source to register: ``spark.read.format("paged_files").option("folder", ...).load(manifest)`` has a row for each
    page of each file that a checked manifest lists.  Only these files are opened."""

    class PagedFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "paged_files"

        def schema(self) -> str:
            return FOUND

        def reader(self, schema) -> DataSourceReader:
            return PagedReader(self.options, extract)

    return PagedFiles


# ------------------------------------------------------------------ files of a manifest
def located(manifest: DataFrame, folder: str) -> DataFrame:
    """``document_id, path`` with the full path of each file."""
    whole = F.col("pdf").contains("://") | F.col("pdf").startswith("/")
    return manifest.select("document_id", F.when(whole, F.col("pdf")).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), "pdf")).alias("path"))


def dealt(entries: DataFrame) -> DataFrame:
    """Entries spread over as many tasks as their number asks for."""
    return entries.repartition(max(1, -(-entries.count() // FILES)), "document_id")


def _batches(rows: Iterator[Page]) -> Iterator[pa.RecordBatch]:
    held: list[Page] = []
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string()]
    for row in rows:
        held.append(row)
        if len(held) == PAGES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=list(Page._fields))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=list(Page._fields))


def read_located(entries: DataFrame, extract: Extractor) -> DataFrame:
    """All pages and errors of ``document_id, path`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document_id, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _batches(pages_of_file(document_id, path, extract))

    return dealt(entries.select("document_id", "path")).mapInArrow(run, FOUND)


def split_failures(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pages, failures)``: a document with an error has no pages."""
    failures = found.where("error is not null").select("document_id", "error")
    blank = F.lit(None).cast("string")
    whole = found.where("error is null").drop("error", "sha256").join(failures.select("document_id"), "document_id", "left_anti")
    return measure(whole).withColumns({"section": blank, "subsection": blank}), failures


def parse_files(spark: SparkSession, manifest: DataFrame, folder: str, extract: Extractor = form_feed_pages) -> tuple[DataFrame, DataFrame]:
    """``(pages, failures)`` of the manifest's files; a file that can't be read is a failure, not the end of the job."""
    return split_failures(read_located(located(manifest, folder), extract))


def parse_file(spark: SparkSession, path: str, document_id: str, extract: Extractor = form_feed_pages) -> DataFrame:
    """The measured pages of one file, or the error that it has."""
    found = read_located(spark.createDataFrame([(document_id, path)], "document_id string, path string"), extract)
    bad = found.where("error is not null").first()
    if bad:
        raise_error(bad["error"])
    return split_failures(found)[0]


def recognise(spark: SparkSession, pages: DataFrame, manifest: DataFrame, folder: str, read_page: Recogniser) -> DataFrame:
    """Recognised text of the suspicious pages only; each file is opened once for all of its pages, where it lies."""
    asked = suspicious(pages).groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("numbers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, numbers, path in zip(*(batch.column(k).to_pylist() for k in range(3))):
                content = content_of(path)
                texts = [read_page(content, n) for n in numbers]
                yield pa.RecordBatch.from_arrays([pa.array([document] * len(texts), pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["document_id", "page_number", "text"])

    return asked.join(located(manifest, folder), "document_id").select("document_id", "numbers", "path").mapInArrow(run, "document_id string, page_number int, text string")


def check_page_number(page_number: int, page_count: int) -> int:
    if isinstance(page_number, bool) or not isinstance(page_number, int):
        raise TypeError("page_number must be an integer")
    if not 1 <= page_number <= page_count:
        raise ValueError(f"page_number must be from 1 to {page_count}")
    return page_number


def recognise_page(spark: SparkSession, manifest: DataFrame, folder: str, document_id: str, page_number: int, read_page: Recogniser, extract: Extractor = form_feed_pages) -> DataFrame:
    """One page of one file, recognised, as a measured page."""
    entry = located(manifest, folder).where(F.col("document_id") == document_id).first()
    if entry is None:
        raise FileNotFoundError(f"no file of {document_id} in {folder}")
    content = content_of(entry["path"])
    check_page_number(page_number, sum(1 for _ in extract(content)))
    row = spark.createDataFrame([(document_id, page_number, read_page(content, page_number), 0)], "document_id string, page_number int, text string, image_count int")
    return measure(row, "ocr").withColumn("quality_flag", ocr_quality(F.col("text")))


def states(entries: DataFrame) -> DataFrame:
    """``document_id, path, size, modified`` of files, without opening them, or their ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path in batch.column(1).to_pylist():
                try:
                    info = file_info(path)
                    rows.append((info.size, info.mtime_ns, None))
                except (OSError, ValueError) as e:
                    rows.append((None, None, f"{'FileNotFoundError' if isinstance(e, FileNotFoundError) else 'ValueError'}: {e}"))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["document_id", "path", "size", "modified", "error"])

    return dealt(entries.select("document_id", "path")).mapInArrow(run, "document_id string, path string, size long, modified long, error string")


def ends_with(path: Column, suffix: str) -> Column:
    return F.lower(path).endswith(suffix.lower())


