"""Intermediate results that outlive a lost executor.

Lineage is cut by writing a table into the folder that ``spark.checkpoint.dir`` names; every executor and the driver can
read it.  Where the session names none, a folder under the system's temporary directory serves a session that runs on one
machine (tests); any other is an error, as its executors would each write to a disk of their own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/docengine"
    return base.rstrip("/")


@contextmanager
def tidy(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Queries that run meanwhile delete their shuffle files at their end, and run under further ``settings``."""
    settings = {CLEANUP: "true", **settings}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Joins of tables that grow with the corpus take the same plan at every size.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

#: Texts cross to Python in batches of fewer rows than Spark's 10,000, of which a task holds several in the JVM and in Python.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


_scopes: list[list[Store]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Tables of operators that are called meanwhile are deleted at the end; what is to stay must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for store in _scopes.pop():
            store.clear()


class Store:
    """Tables of one operator call, under a name of its own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str, **settings: str):
        self.spark, self.settings = spark, settings
        self.root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
        if _scopes:
            _scopes[-1].append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.root}/{name}"
        with tidy(self.spark, **self.settings):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Delete all of the tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
