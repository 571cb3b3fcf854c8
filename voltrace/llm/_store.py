"""Shared working storage: tables and files that every executor and the driver can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` as a URI; where that is unset (tests, local mode) a new local one, set for the session.

    A path without a scheme belongs to Spark's default file system, so it is completed by Spark: workers that read it
    through pyarrow then see the same files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="voltrace-")
        _made.add(path)
        spark.conf.set("spark.checkpoint.dir", path)
    if "://" not in path:
        given = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toString()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in shared storage; what lies there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/voltrace/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@atexit.register
def _remove_made() -> None:
    for path in _made:
        try:
            fs, local = open_store(path)
            fs.delete_dir(local)
        except OSError:  # never written, or gone with its parent
            continue


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into shared storage and read it back: later work neither repeats df's plan nor depends on executors that ran it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    """All columns of df by their names, whatever characters those have."""
    return [F.col(quoted(c)) for c in df.columns]


def field_list(df: DataFrame) -> str:
    """df's schema as DDL, whatever characters its names have."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)


def plain_names(df: DataFrame) -> DataFrame:
    """df with columns named by their places, as Arrow functions can't be given names with dots or backticks."""
    return df.toDF(*(f"_column_{i}" for i in range(len(df.columns))))


def bound_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Let Python workers get Arrow batches of at most about ``limit`` bytes (or one row), whatever the length of the texts.

    This holds for the session from then on, as plans run after the operator that built them has returned.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    size = int(now) if now.isdigit() else int(now[:-1]) if now[-1:] == "b" and now[:-1].isdigit() else None
    if size is None or size <= 0 or size > limit:
        spark.conf.set(key, f"{limit}b")


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it: a URI of any store that pyarrow knows, or a local path."""
    for scheme in ("s3a://", "s3n://"):  # Hadoop's names of one store
        path = path.replace(scheme, "s3://", 1) if path.startswith(scheme) else path
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class BlobWriter:
    """Blobs one after another in a file of its own name; a task that runs again writes another file."""

    def __init__(self, folder: str):
        self.path, self.at = f"{folder}/{uuid.uuid4().hex}.blobs", 0
        fs, local = open_store(self.path)
        self.out = fs.open_output_stream(local)

    def add(self, blob: bytes) -> tuple[str, int, int]:
        """(path, offset, length) under which the blob can be read once the file is closed."""
        self.out.write(blob)
        self.at += len(blob)
        return self.path, self.at - len(blob), len(blob)

    def close(self) -> None:
        self.out.close()


def read_blob(path: str, offset: int, length: int) -> bytes:
    fs, local = open_store(path)
    with fs.open_input_file(local) as f:
        return f.read_at(length, offset)
