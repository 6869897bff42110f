"""Helpers shared by the corpus operators: shared-folder tables, batch slicing, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes to bytes: A-Z lower-cased, every byte outside words to a space. Bytes of 0x80 and up (all of a non-ASCII
#: character) belong to words, so splitting bytes gives the words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes of the Arrow batches that go to a Python worker, where the session names no number of its own; a longer row stays whole.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: By operator, the large tables that a worker keeps from task to task.
WORKER_TABLES: dict[str, dict] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text in order; none for null."""
    return text.translate(WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/gridloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `budget` bytes in a column; a longer single value stays whole."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > budget:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def without(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns whose names an operator is about to add, so that clashing extras cannot break it."""
    lower = {n.lower() for n in names} - {k.lower() for k in keep}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def give_back() -> None:
    """Return what is freed to the system: workers live on between tasks and stages, and allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def free_tables(but: str = "") -> None:
    """Free the tables that a worker has kept of other operators."""
    old = [table for name, table in WORKER_TABLES.items() if name != but and table]
    for table in old:
        table.clear()
    if old:
        gc.collect()
        give_back()


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, keeps: str = "") -> DataFrame:
    """mapInArrow with batches of bounded size, by workers that give back their memory at a task's end and keep no tables but those named.

    Spark's own bounds are 10,000 rows and 64 MB, held by the JVM and by Python, and twice where a worker returns the texts.
    """
    if not df.sparkSession.conf.get(_BATCH_CONF, None):
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_tables(keeps)
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
