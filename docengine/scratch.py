"""A folder for tables that one call writes and reads again, and small files in whatever file system a path names."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.  Without that setting a session on one
    machine has one in the system's temporary directory; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/docengine"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in a new folder, for what reads them more than once."""
    spark = rows.sparkSession
    path = folder(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_json(spark: SparkSession, path: str) -> object:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def create_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a file that must not be there yet; of two writers one gets a ``FileExistsError``."""
    fs, p = _at(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            raise FileExistsError(f"written by another meanwhile: {path}") from e
        raise
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
