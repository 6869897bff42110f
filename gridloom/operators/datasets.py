"""Wide datasets of packed files: opening, coordinates and their metadata, pressure and heights, and writing back.

A dataset is two frames. `upper` has the keys (time, level, y, x), `surface` (time, y, x), each its own variables and
forecast_hour, the forecast of the time's index record; `upper` also has the physical level coordinate. What belongs to the whole
(source, grid, vertical axis) is kept as metadata of the column `time`, so it follows the frames through filters and joins.
"""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import vertical
from gridloom.functions.projection import Grid, Projection
from gridloom.operators import fields as fo
from gridloom.operators import files
from gridloom.sources import packed, stores

KEYS = ("time", "level", "y", "x", "forecast_hour", *dict.fromkeys(vertical.COORDINATE.values()))
#: CF attributes of spatial coordinates: fixed values.
SPATIAL = {
    "lon": {"standard_name": "longitude", "units": "degrees_east", "axis": "X"},
    "lat": {"standard_name": "latitude", "units": "degrees_north", "axis": "Y"},
    "x": {"standard_name": "projection_x_coordinate", "units": "m", "axis": "X"},
    "y": {"standard_name": "projection_y_coordinate", "units": "m", "axis": "Y"},
}


@dataclass(frozen=True)
class Axis:
    """A vertical axis: its flag, the stored heights from level 0 on, and the offset."""

    flag: int
    heights: list[float]
    offset: float = 0.0


def level_subset(column: str, indexer, size: int) -> Column:
    """A predicate for an index along a dimension: a number (negative ones from the end), a slice or a list of numbers."""
    if isinstance(indexer, slice):
        wanted = range(size)[indexer]
    else:
        wanted = [range(size)[int(i)] for i in ([indexer] if isinstance(indexer, int) else indexer)]
    if isinstance(wanted, range) and wanted and wanted.step == 1:
        return F.col(column).between(wanted[0], wanted[-1])
    return F.col(column).isin(list(wanted))


def grid_metadata(grid: Grid) -> dict:
    """A grid as plain metadata."""
    return {"nx": grid.nx, "ny": grid.ny, **asdict(grid.projection)}


def grid_from_metadata(meta: dict) -> Grid:
    try:
        numbers = {n: float(meta[n]) for n in Projection.__dataclass_fields__}
        return Grid(Projection(**numbers), int(meta["nx"]), int(meta["ny"]))
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"the metadata do not hold a grid: {e}") from e


def _time_metadata(frame: DataFrame) -> dict:
    return frame.schema["time"].metadata if "time" in frame.columns else {}


def grid_of(frame: DataFrame) -> Grid:
    return grid_from_metadata(_time_metadata(frame).get("grid", {}))


def source_of(frame: DataFrame) -> str:
    if not (source := _time_metadata(frame).get("source")):
        raise ValueError("the frame does not know its source")
    return source


def axis_of(frame: DataFrame) -> Axis:
    if "axis" not in _time_metadata(frame):
        raise ValueError("the frame does not know its vertical axis")
    a = _time_metadata(frame)["axis"]
    return Axis(a["flag"], list(a["heights"]), a["offset"])


def axis_from_levels(spark: SparkSession, flag: int, levels: dict[int, float], surface: float, offset: float = 0.0) -> Axis:
    """An axis from the stored values of some levels above the surface: those between them have 0."""
    rows = spark.createDataFrame([(0, float(surface)), *((int(k), float(v)) for k, v in levels.items())], "lev int, stored double")
    return Axis(vertical.check_flag(flag), [r["stored"] for r in vertical.sparse_axis(rows).orderBy("lev").collect()], offset)


def with_spatial_metadata(frame: DataFrame) -> DataFrame:
    """CF attributes on the columns lon, lat, x and y; lon and lat beside x and y are no axes. Attributes that are there stay."""
    plane = {"x", "y"} & {*frame.columns}
    for name in SPATIAL.keys() & {*frame.columns}:
        attrs = {k: v for k, v in SPATIAL[name].items() if not (k == "axis" and plane and name in ("lon", "lat"))}
        frame = frame.withMetadata(name, attrs | frame.schema[name].metadata)
    return frame


def with_identity(frame: DataFrame, grid: Grid, axis: Axis, source: str) -> DataFrame:
    """The frame with source, grid and axis in the metadata of its time."""
    return frame.withMetadata("time", {"standard_name": "time", "axis_name": "T", "source": source, "grid": grid_metadata(grid), "axis": {"flag": axis.flag, "heights": [float(h) for h in axis.heights], "offset": float(axis.offset)}})


def open_dataset(spark: SparkSession, path, drop_variables=None, bbox=None, levels=None) -> tuple[DataFrame, DataFrame]:
    """(upper, surface) of packed files; times, levels and variables are pruned in the catalogue, the box inside the decoder."""
    index = packed.read_index(spark, path)
    grid, heights, flag, offset, source = files.file_info(index)
    window = grid.window_from_bbox(bbox) if bbox else None
    dropped = fo.normalise_variables(drop_variables) if drop_variables else []
    recs = fo.select_records(packed.records(index), fo.normalise_levels(len(heights), levels), None, dropped)
    tops = {r["variable"]: r["top"] for r in recs.groupBy("variable").agg(F.max("level").alias("top")).collect()}  # the file's variables
    cells = fo.cells(fo.decode(packed.with_payload(recs), window)).withColumnRenamed("index_forecast", "forecast_hour")
    if window:
        cells = cells.withColumns({"y": F.col("y") - window.y_start, "x": F.col("x") - window.x_start})
    upper, surface = fo.dataset(cells, sorted(tops), surface=[n for n, top in tops.items() if top == 0], keep=("forecast_hour",))
    name = vertical.COORDINATE[vertical.check_flag(flag)]
    upper = upper.withColumn(name, vertical.stored_level(heights, F.col("level")))
    standard, units = vertical.LEVEL_ATTRS[flag]
    upper = upper.withMetadata(name, {"standard_name": standard, "units": units, "surface": float(heights[0]), "offset": float(offset)})
    sub, axis = grid.subset(window) if window else grid, Axis(flag, heights, offset)
    return tuple(with_spatial_metadata(with_identity(f, sub, axis, source)) for f in (upper, surface))


def _need(names: tuple[str, ...], upper: DataFrame, surface: DataFrame, what: str) -> None:
    if gone := [n for n in names if n not in upper.columns and n not in surface.columns]:
        raise ValueError(f"{what} needs {', '.join(gone)}")


def _with_surface(upper: DataFrame, surface: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The upper frame with columns of the surface one, on the cells of each column of air."""
    add = [n for n in names if n not in upper.columns]
    return upper.join(surface.select("time", "y", "x", *add), ["time", "y", "x"], "left") if add else upper


def pressure(upper: DataFrame, surface: DataFrame, out: str = "p") -> DataFrame:
    """The upper frame with the pressure of each cell: stored, or from PRSS on sigma and hybrid axes, or the variable PRES on terrain-following ones."""
    axis = axis_of(upper)
    if axis.flag == vertical.TERRAIN:
        if "PRES" not in upper.columns:
            raise ValueError("pressure on a terrain-following axis needs PRES")
        return upper.withColumn(out, F.col("PRES").cast("double"))
    stored = vertical.stored_level(axis.heights, F.col("level"))
    if axis.flag == vertical.PRESSURE:
        return upper.withColumn(out, stored)
    _need(("PRSS",), upper, surface, "pressure")
    rows = _with_surface(upper, surface, ("PRSS",))
    return rows.withColumn(out, vertical.level_pressure(F.lit(axis.flag), stored, F.col("level"), F.col("PRSS").cast("double"), axis.offset)).select(*upper.columns, out)


def z_agl(upper: DataFrame, surface: DataFrame, out: str = "z_agl") -> DataFrame:
    """The upper frame with heights above ground: HGTS less SHGT, the stored heights, or hypsometric ones from PRSS and TEMP. Not stopped at 0."""
    axis = axis_of(upper)
    if axis.flag == vertical.TERRAIN:
        return upper.withColumn(out, vertical.stored_level(axis.heights, F.col("level")))
    if axis.flag == vertical.PRESSURE:
        _need(("HGTS", "SHGT"), upper, surface, "z_agl")
        rows = _with_surface(upper, surface, ("SHGT",))
        return rows.withColumn(out, F.col("HGTS").cast("double") - F.col("SHGT").cast("double")).select(*upper.columns, out)
    _need(("PRSS", "TEMP"), upper, surface, "z_agl")
    rows = _with_surface(pressure(upper, surface, "_p"), surface, ("PRSS",)).withColumns({"_ps": F.col("PRSS").cast("double"), "_tk": F.col("TEMP").cast("double")})
    return vertical.hypsometric(rows, ["time", "y", "x"], "level", "_p", "_ps", "_tk", out).select(*upper.columns, out)


def z_msl(upper: DataFrame, surface: DataFrame, out: str = "z_msl") -> DataFrame:
    """The upper frame with heights above sea level: z_agl and SHGT."""
    _need(("SHGT",), upper, surface, "z_msl")
    rows = _with_surface(z_agl(upper, surface, "_z"), surface, ("SHGT",))
    return rows.withColumn(out, F.col("_z") + F.col("SHGT").cast("double")).select(*upper.columns, out)


def _slices(frame: DataFrame, names: list[str], upper: bool) -> DataFrame:
    """(time, forecast, level, variable, y, x, value), with the missing values."""
    forecast = F.coalesce(F.col("forecast_hour").cast("int"), F.lit(0)) if "forecast_hour" in frame.columns else F.lit(0)
    rows = frame.select("time", forecast.alias("forecast"), (F.col("level").cast("int") if upper else F.lit(0)).alias("level"), "y", "x", *[F.col(n).cast("float").alias(n) for n in names])
    return rows.unpivot(["time", "forecast", "level", "y", "x"], names, "variable", "value")


def write_dataset(upper: DataFrame | None, surface: DataFrame | None, path: str, grid: Grid | None = None, axis: Axis | None = None, source: str | None = None) -> str:
    """Write a dataset as one packed file.

    Grid, axis and source come from the frames' metadata unless given; a surface alone needs the axis. Every slice must be
    complete and finite. A variable's metadata `diff` names its difference record. forecast_hour is that of the time's index record, 0 if absent.
    """
    frames = [(f, up) for f, up in ((upper, True), (surface, False)) if f is not None]
    if not frames:
        raise ValueError("there is nothing to write")
    for f, up in frames:
        if gone := [c for c in ("time", *(["level"] if up else []), "y", "x") if c not in f.columns]:
            raise ValueError(f"a frame lacks the columns {gone}")
    if upper is None and axis is None:
        raise ValueError("a surface alone needs an axis")
    first = frames[0][0]
    grid, axis, source = grid or grid_of(first), axis or axis_of(first), source or source_of(first)
    names = {up: [c for c in f.columns if c not in KEYS] for f, up in frames}
    diffs: dict[str, str] = {}
    for f, up in frames:
        for n in names[up]:
            if n.startswith("DIF"):
                raise ValueError(f"{n} is the name of a difference; name it in the metadata of its parent")
            if len(n) > 4:
                raise ValueError(f"variable names have at most 4 characters: {n!r}")
            if (diff := f.schema[n].metadata.get("diff")) is not None:
                if not isinstance(diff, str) or not diff.startswith("DIF"):
                    raise ValueError(f"the difference of {n} must be named DIF*, not {diff!r}")
                diffs[n] = diff
    if not any(names.values()):
        raise ValueError("there is no variable to write")
    if upper is not None:
        held = upper.select("time", "level").distinct().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("time").alias("t"), F.countDistinct("level").alias("l")).first()
        if held["n"] != held["t"] * held["l"]:
            raise ValueError("some times lack a level that others have")
    if len(frames) == 2:
        both = [f.select("time").distinct() for f, _ in frames]
        if not both[0].exceptAll(both[1]).unionAll(both[1].exceptAll(both[0])).isEmpty():
            raise ValueError("the frames do not have the same times")
    rows = reduce(DataFrame.unionByName, [_slices(f, names[up], up) for f, up in frames if names[up]])
    order = F.create_map(*[F.lit(v) for pair in ((n, i) for i, n in enumerate([n for up in (False, True) for n in names.get(up, [])])) for v in pair])
    data = fo.field_bytes(rows, grid.nx, ["time", "forecast", "level", "variable"], ny=grid.ny)
    diff = F.create_map(*[F.lit(v) for pair in diffs.items() for v in pair])[F.col("variable")] if diffs else F.lit(None).cast("string")
    out = data.select(F.lit(os.path.basename(path)).alias("file"), F.col("time").cast("timestamp_ntz").alias("time"), "level", order[F.col("variable")].alias("seq"), "variable", "forecast", "data", diff.alias("diff_variable"))
    packed.write_packed(out, stores.folder_of(path), grid, axis.heights, axis.flag, source, axis.offset)
    return path
