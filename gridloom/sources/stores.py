"""File stores and shared tables: local or mounted paths and every store that pyarrow knows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHUNK = 8 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and its name there."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def folder_of(path: str) -> str:
    return path.rpartition("/")[0] if "://" in path else os.path.dirname(os.path.abspath(path))


def open_input(path: str):
    """A seekable file."""
    store, name = store_of(path)
    return store.open_input_file(name)


def open_output(path: str):
    store, name = store_of(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    return store.open_output_stream(name)


def size_of(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    store, name = store_of(path)
    info = store.get_file_info(name)
    return info.size if info.is_file else None


def move(part: str, final: str) -> None:
    store, name = store_of(part)
    store.move(name, store_of(final)[1])


def remove(path: str) -> None:
    store, name = store_of(path)
    if store.get_file_info(name).is_file:
        store.delete_file(name)


def append_files(parts: list[str], destination: str) -> None:
    """Join files byte by byte under a temporary name, which then becomes the destination."""
    temporary = f"{destination}.{uuid.uuid4().hex}.tmp"
    try:
        with open_output(temporary) as out:
            for part in parts:
                with open_input(part) as f:
                    while block := f.read(CHUNK):
                        out.write(block)
        move(temporary, destination)
    finally:
        remove(temporary)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new name in the folder that all executors share (spark.checkpoint.dir); a temporary one only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/gridloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again, so that it is made once."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
