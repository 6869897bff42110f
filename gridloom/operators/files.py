"""Operators on packed files: subsets, concatenation, time bins, datasets and sampling."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.projection import Grid, Projection
from gridloom.functions.textcodec import NUMBERS
from gridloom.operators import fields as fo
from gridloom.operators import sampling
from gridloom.sources import packed, stores


def file_info(index: DataFrame) -> tuple[Grid, list[float], int, float, str]:
    """Grid, heights, flag, offset and source of an index whose files agree; one row is read."""
    r = index.select("grid", "vertical_flag", "offset", "source", F.transform("levels", lambda v: v["height"]).alias("h")).first()
    if r is None:
        raise ValueError("there is no index record")
    g = r["grid"]
    return Grid(Projection(*(g[n] for n in NUMBERS[:11])), g["nx"], g["ny"]), r["h"], r["vertical_flag"], r["offset"], r["source"]


def _require(index: DataFrame) -> None:
    if problem := packed.check_index(index).first():
        raise ValueError(f"{problem['path']}: inconsistent {problem['problem']}")


def open_cells(spark: SparkSession, path, variables=None, levels=None, drop=None, bbox=None) -> DataFrame:
    """Cells of packed files; times, levels and variables are pruned before any payload is read, the box inside the decoder."""
    index = packed.read_index(spark, path)
    grid, heights, *_ = file_info(index)
    window = grid.window_from_bbox(bbox) if bbox else None
    recs = fo.select_records(packed.records(index), fo.normalise_levels(len(heights), levels), variables, drop)
    return fo.cells(fo.decode(packed.with_payload(recs), window))


def sample_files(spark: SparkSession, path, points: DataFrame, variables, z_kind: str = "pressure", method: str = "linear", time=None) -> DataFrame:
    """Sample points from one or many packed files; each point's time picks its file."""
    index = packed.read_index(spark, path)
    grid, heights, flag, offset, _ = file_info(index)
    if not sampling.duplicate_times(index).isEmpty():
        raise ValueError("several sources hold the same time")
    if time is None and "time" not in points.columns:  # sources of a single time need no time of the points
        held = [r["time"] for r in index.select("time").distinct().limit(2).collect()]
        time = held[0] if len(held) == 1 else None
    pts = sampling.normalise_points(points, time)
    if gone := sampling.missing_times(pts, index).orderBy("time").first():
        raise ValueError(f"no source holds the time {gone['time']}")
    names = fo.normalise_variables(variables)
    want = {n for n in names if n != "pressure"} | {*sampling.needs(flag, z_kind, "pressure" in names and z_kind != "pressure")}
    recs = packed.records(index).join(pts.select("time").distinct(), "time", "left_semi")
    have = recs.groupBy("time").agg(F.collect_set("variable").alias("v"))
    lacking = have.select("time", F.array_except(F.array(*map(F.lit, sorted(want))), "v").alias("m")).where(F.size("m") > 0).first() if want else None
    if lacking:
        kind = ValueError if {*lacking["m"]} & {"PRSS", "SHGT"} else KeyError
        raise kind(f"{lacking['m']} not found at {lacking['time']}")
    box = sampling.bounding_window(sampling.horizontal_plan(pts, grid, method)).first()
    from gridloom.functions.projection import Window as GridWindow

    window = None if box["x_start"] is None else GridWindow(box["x_start"], box["x_stop"], box["y_start"], box["y_stop"])
    cells = fo.cells(fo.decode(packed.with_payload(recs.where(F.col("variable").isin(sorted(want)))), window))
    return sampling.sample_points(cells, pts, names, grid, heights, flag, z_kind, method, offset)


def index_bytes(recs: DataFrame, level: str = "level") -> DataFrame:
    """(time, used): bytes of the index record that the records of a time take, differences included."""
    n = F.count(F.lit(1)) + F.count("diff_variable")
    return recs.groupBy("time").agg((F.lit(158) + 8 * F.countDistinct(level) + 8 * n).alias("used"))


def check_record_length(recs: DataFrame, record_length: int, level: str = "level") -> None:
    """The index of every time, differences included, must fit in a record of the new grid."""
    if bad := index_bytes(recs, level).where(F.col("used") > record_length).first():
        raise ValueError(f"an index of {bad['used']} bytes exceeds the record length {record_length}")


def extract_subset(spark: SparkSession, source: str, dest: str, bbox=None, levels=None, variables=None) -> str:
    """A new file of a box, levels and variables of another: fields are packed again, differences made anew, levels compacted."""
    index = packed.read_index(spark, source)
    _require(index)
    grid, heights, flag, offset, sid = file_info(index)
    window = grid.window_from_bbox(bbox) if bbox else grid.full_window
    keep = fo.normalise_levels(len(heights), levels) or list(range(len(heights)))
    sub = grid.subset(window) if bbox else grid
    recs = fo.select_records(packed.records(index), keep, None if variables is None else fo.normalise_variables(variables))
    check_record_length(recs, sub.record_length)
    number = F.create_map(*[F.lit(int(v)) for pair in ((old, new) for new, old in enumerate(keep)) for v in pair])
    data = fo.decode(packed.with_payload(recs), window)
    schema = data.select("time", "level", "seq", "variable", "forecast", "diff_variable", F.lit(None).cast("binary").alias("data")).schema

    def raw(batches):
        import numpy as np
        import pyarrow as pa

        names = ["time", "level", "seq", "variable", "forecast", "diff_variable"]
        for b in batches:
            values = [np.asarray(f.values, "<f4").tobytes() for f in b.column("field")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(values, pa.binary())], names=[*names, "data"])

    out = data.mapInArrow(raw, schema).withColumn("level", number[F.col("level")]).withColumn("file", F.lit(os.path.basename(dest)))
    packed.write_packed(out, stores.folder_of(dest), sub, [heights[i] for i in keep], flag, sid, offset)
    return dest


def concat_plan(index: DataFrame, sort: bool = True) -> DataFrame:
    """(path, first_time, place): files in the order in which they are joined."""
    per = index.groupBy("path").agg(F.min("time").alias("first_time"), F.min("place").alias("given"))
    order = ["first_time", "given"] if sort else ["given"]
    return per.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("given")


def _axis():
    return F.struct("vertical_flag", "offset", F.transform("levels", lambda v: v["height"]).alias("h"))


def _check_joinable(index: DataFrame, by: str) -> None:
    """Files that are joined (the same `by`) must agree in grid, axis and source, and hold each time once."""
    _require(index)
    n = index.groupBy(by).agg(F.countDistinct("grid").alias("grid"), F.countDistinct(_axis()).alias("vertical axis"), F.countDistinct("source").alias("source"))
    for what in ("grid", "vertical axis", "source"):
        if not n.where(F.col(what) > 1).isEmpty():
            raise ValueError(f"the sources differ in {what}")
    if twice := index.groupBy(by, "time").count().where("count > 1").first():
        raise ValueError(f"time {twice['time']} is in several sources")


def _join_files(spark: SparkSession, jobs: list[tuple[str, list[str]]]) -> list[str]:
    """Join the files of each destination on the executors, one task a destination; a lost task starts again under a new temporary name."""

    def run(batches):
        for b in batches:
            for dest, paths in zip(b.column("dest").to_pylist(), b.column("paths").to_pylist(), strict=True):
                stores.append_files(paths, dest)
            yield b.select(["dest"])

    plan = spark.createDataFrame(jobs, "dest string, paths array<string>").repartition(max(1, len(jobs)), "dest")
    plan.mapInArrow(run, "dest string").collect()  # one name a destination
    return [dest for dest, _ in jobs]


def concat(spark: SparkSession, sources: list[str], destination: str, sort: bool = True) -> str:
    """Join files byte by byte, by earliest time or as given, after checking that they fit together."""
    if isinstance(sources, (str, os.PathLike)):
        raise TypeError("sources must be a list of paths")
    sources, destination = [os.fspath(s) for s in sources], os.fspath(destination)
    if not sources:
        raise ValueError("there is nothing to join")
    names = [stores.store_of(s)[1] for s in sources]
    if stores.store_of(destination)[1] in names:
        raise ValueError("the destination must not be one of the sources")
    if empty := [s for s in sources if stores.size_of(s) == 0]:
        raise ValueError(f"{empty[0]} holds no records")
    given = spark.createDataFrame(list(zip(sources, range(len(sources)), strict=True)), "path string, place int")
    index = packed.read_index(spark, sources)
    _check_joinable(index.withColumn("bin", F.lit(0)), "bin")
    order = [r["path"] for r in concat_plan(index.join(given, "path"), sort).orderBy("place").collect()]
    return _join_files(spark, [(destination, order)])[0]


def time_bins(first: DataFrame, freq: str = "1 day", time_range=None) -> DataFrame:
    """(bin, files) of files with their first time (path, time): those of the closed range, by bin start, each bin's in order of time and path."""
    if time_range:
        first = first.where(F.col("time").between(*[F.lit(t).cast("timestamp_ntz") for t in time_range]))
    return first.groupBy(F.window("time", freq).start.alias("bin")).agg(F.sort_array(F.collect_list(F.struct("time", "path"))).alias("files"))


def concat_by_time(spark: SparkSession, directory: str, output_directory: str, freq: str = "1 day", pattern: str = "*", time_range=None, template: str = "%Y%m%d", sort: bool = True) -> list[str]:
    """Join a folder's files in bins of their first stored time, one task a bin. The file name of a bin is its start in `template`."""
    files = packed.list_files(directory, pattern)
    if not files:
        raise ValueError(f"no file matches {pattern!r}")
    first = packed.read_index(spark, files, first_only=True).select("path", "time")
    bins = time_bins(first, freq, time_range).orderBy("bin").collect()  # the file list
    names = [b["bin"].strftime(template) for b in bins]
    if len({*names}) < len(names):
        raise ValueError("two bins have the same file name; use a finer template")
    jobs = [(f"{os.fspath(output_directory).rstrip('/')}/{name}", [f["path"] for f in b["files"]]) for b, name in zip(bins, names, strict=True)]
    if not jobs:
        return []
    given = [(p, k, dest) for dest, paths in jobs for k, p in enumerate(paths)]
    if {stores.store_of(d)[1] for d, _ in jobs} & {stores.store_of(p)[1] for p, *_ in given}:
        raise ValueError("the destination must not be one of the sources")
    binned = packed.read_index(spark, [p for p, *_ in given]).join(spark.createDataFrame(given, "path string, place int, dest string"), "path")
    _check_joinable(binned, "dest")
    if sort:  # by the earliest time of a file, which need not be its first
        order = concat_plan(binned).select("path", F.col("place").alias("nth"))
        nth = {r["path"]: r["nth"] for r in order.collect()}
        jobs = [(dest, sorted(paths, key=nth.__getitem__)) for dest, paths in jobs]
    else:
        at = {p: k for k, p in enumerate(files)}
        jobs = [(dest, sorted(paths, key=at.__getitem__)) for dest, paths in jobs]
    return _join_files(spark, jobs)
