"""Ingestion of new documents as they arrive: a file stream whose documents are labelled and chunked when they are whole.

Pages of a document may come in any order, in different files and batches, and more than once: they wait in the stream's
state, keyed by document, until as many different pages are there as the document is said to have.  Then they go on
together and their state is dropped, so the state holds unfinished documents only, and the chunks are those of one batch
over all pages.  A page that comes after its document is whole begins a new version of it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docengine.operators import chunk, sections
from docengine.schemas import PAGE, ChunkConfig

FIELDS = [x.split()[0] for x in PAGE.split(", ")]
#: A page and how many its document has.
COUNTED = f"{PAGE}, page_count int"


def page_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 100, counted: bool = False) -> DataFrame:
    """Pages as Parquet files land in a folder.  ``counted`` pages say how many their document has (``page_count``) and may
    come in any files; otherwise a document's pages come in one file."""
    return spark.readStream.schema(COUNTED if counted else PAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one document the pages so far; all of them once they are as many as they should be.  Of a page that came twice the
    later one counts."""
    held: dict[int, tuple] = pickle.loads(bytes(state.get[0])) if state.exists else {}
    count = state.get[1] if state.exists else 0
    for frame in frames:
        for row in frame[FIELDS].itertuples(index=False, name=None):
            held[int(row[1])] = tuple(None if v is None or v != v else v for v in row)
        count = int(frame["page_count"].max())
    if len(held) >= count:
        if state.exists:
            state.remove()
        yield pd.DataFrame([held[k] for k in sorted(held)], columns=FIELDS).astype(object)
    else:
        state.update((pickle.dumps(held), count))


def whole_documents(pages: DataFrame) -> DataFrame:
    """The pages of a stream of counted pages, each document's together when the last of them has come."""
    return pages.groupBy("document_id").applyInPandasWithState(_gather, PAGE, "held binary, page_count int", "append", GroupStateTimeout.NoTimeout)


def chunk_stream(pages: DataFrame, to: str, checkpoint: str, config: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Writes the chunks of each batch's whole documents under its number, so a batch that is repeated replaces itself."""
    whole = whole_documents(pages) if "page_count" in pages.columns else pages

    def write(batch: DataFrame, number: int) -> None:
        chunk.chunk_documents(sections.detect(batch), config).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return whole.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
