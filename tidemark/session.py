"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def local_session(app: str = "tidemark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-node benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a cluster a
    machine-local folder would be lost with its executor, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCOPES: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate or result table in the shared folder, below a folder of the
    application or, inside :func:`scratch_scope`, of the scope."""
    folder = _SCOPES[-1] if _SCOPES else _application_folder(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark/{spark.sparkContext.applicationId}"


def _drop(folder: str) -> None:
    files, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    if files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_dir(path)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables written inside are dropped at the end: for jobs that leave no lazy result behind."""
    _SCOPES.append(f"{_application_folder(spark)}/scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _drop(_SCOPES.pop())


def drop_scratch(spark: SparkSession) -> None:
    """Drop all that the application has written to the shared folder; its lazy results end with it."""
    _drop(_application_folder(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back, so that later jobs neither recompute it nor
    see another outcome of a sampled or unordered step after an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_TYPES = {
    "string": pa.string(),
    "double": pa.float64(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"),
}


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A result of a handful of rows as a local relation, which later plans read without a job."""
    struct = T.StructType.fromDDL(schema)
    columns = [
        pa.array([row[i] for row in rows], ARROW_TYPES[field.dataType.simpleString()])
        for i, field in enumerate(struct.fields)
    ]
    return spark.createDataFrame(pa.table(columns, names=struct.names), schema=struct)
