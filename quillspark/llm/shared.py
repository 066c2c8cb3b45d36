"""The folder that driver and executors share, and tables written there.

The cluster names the folder in ``spark.checkpoint.dir``. Only a local master without that
setting (tests, notebooks) gets a temporary folder of its own; elsewhere the warehouse is used.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of a fresh folder below the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quillspark"
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    _made().append(f"{root.rstrip('/')}/q-{uuid.uuid4().hex}")
    return _made()[-1]


_local_state = threading.local()


def _made() -> list[str]:
    """Folders handed out in this thread, in order: queries of other threads keep theirs."""
    if not hasattr(_local_state, "made"):
        _local_state.made = []
    return _local_state.made


def mark() -> int:
    """A place in the order of folders, for ``drop_since``."""
    return len(_made())


def drop_since(spark: SparkSession, place: int, keep: tuple[str, ...] = ()) -> None:
    """Remove the folders handed out since ``place`` but for those to keep, once nothing reads them any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for uri in [u for u in _made()[place:] if u not in keep]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(conf).delete(path, True)
        _made().remove(uri)


def write_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Write one whole file from a task or the driver; a retried task replaces it by the same bytes."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, name)


def read_file(uri: str) -> bytes:
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(name) as f:
        return f.read()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, rows: int = 1000):
    """Arrow batches cut to fewer rows, so that what a step makes of one stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
