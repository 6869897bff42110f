"""Packed files as they arrive in a folder: a stream of their catalogue.

Only paths come from the file source; the index records are then read by position on the executors, as in a batch scan, so
payloads are not touched. Everything that works on `read_index` works on the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.packed import INDEX_SCHEMA, scan_index


def index_stream(spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """INDEX_SCHEMA rows of every file that appears in a folder, each file once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path")
    names = [f.name for f in spark.createDataFrame([], INDEX_SCHEMA).schema]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame([dict(zip(names, row, strict=True)) for row in _plain(path)], columns=names)

    def _plain(path: str) -> Iterator[tuple]:
        numbers = [n for n, _ in _grid_fields]
        for row in scan_index(path):
            row = list(row)
            row[6] = dict(zip(numbers, row[6], strict=True))
            row[12] = [{"level": i, "height": h, "vars": [{"name": n, "checksum": c, "reserved": r} for n, c, r in v]} for i, h, v in row[12]]
            yield tuple(row)

    _grid_fields = [(f.name, f.dataType.simpleString()) for f in spark.createDataFrame([], INDEX_SCHEMA).schema["grid"].dataType]
    return files.mapInPandas(scan, INDEX_SCHEMA)


def hourly_arrivals(index: DataFrame, watermark: str = "6 hours") -> DataFrame:
    """Recordsets an hour of valid time; hours older than the watermark are closed."""
    timed = index.withColumn("at", F.col("time").cast("timestamp")).withWatermark("at", watermark)
    return timed.groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "n")
