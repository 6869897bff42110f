"""Datasets of packed files: metadata, contracts of writing, odd sources, arrivals."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import vertical
from gridloom.functions.projection import Grid, Projection
from gridloom.operators import datasets, files, sampling
from gridloom.operators import fields as fo
from gridloom.sources import packed
from gridloom.streaming import arrivals

GRID = Grid(Projection(90.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, -10.0, 20.0), 16, 14)
AXIS = datasets.Axis(2, [1000.0, 900.0, 800.0])
T0 = datetime.datetime(2024, 7, 18)


@pytest.fixture(scope="module")
def frames(spark):
    cells = spark.range(2 * GRID.nx * GRID.ny).select(F.when(F.col("id") < GRID.nx * GRID.ny, F.lit(T0)).otherwise(F.lit(T0 + datetime.timedelta(hours=3))).cast("timestamp_ntz").alias("time"), (F.col("id") % GRID.nx).cast("int").alias("x"), (F.floor(F.col("id") / GRID.nx) % GRID.ny).cast("int").alias("y"))
    surface = cells.select("time", "y", "x", (1000.0 + F.col("x")).alias("PRSS"), (100.0 + F.col("y")).alias("SHGT"))
    upper = cells.select("time", F.explode(F.array(F.lit(1), F.lit(2))).alias("level"), "y", "x").select("time", "level", "y", "x", (280.0 + F.col("x") + F.col("level")).alias("TEMP"), (1000.0 * F.col("level") + F.col("y")).alias("HGTS"))
    return upper, surface


def write(frames, tmp_path, **over):
    args = {"upper": frames[0], "surface": frames[1], "path": str(tmp_path / "out"), "grid": GRID, "axis": AXIS, "source": "TEST"} | over
    return datasets.write_dataset(**args)


def test_dataset_round_trip_and_metadata(spark, frames, tmp_path):
    path = write(frames, tmp_path, upper=frames[0].withMetadata("TEMP", {"diff": "DIFT"}))
    upper, surface = datasets.open_dataset(spark, path)
    for f in (upper, surface):
        assert datasets.grid_of(f) == GRID and datasets.axis_of(f) == AXIS and datasets.source_of(f) == "TEST"
        assert {r.forecast_hour for r in f.select("forecast_hour").distinct().collect()} == {0}
        assert f.schema["x"].metadata["axis"] == "X" and f.schema["y"].metadata["units"] == "m"
    assert {*upper.columns} == {"time", "level", "y", "x", "forecast_hour", "pressure", "TEMP", "HGTS"} and {*surface.columns} == {"time", "y", "x", "forecast_hour", "PRSS", "SHGT"}
    assert upper.schema["pressure"].metadata == {"standard_name": "air_pressure", "units": "hPa", "surface": 1000.0, "offset": 0.0}
    assert {(r.level, r.pressure) for r in upper.select("level", "pressure").distinct().collect()} == {(1, 900.0), (2, 800.0)}
    far = upper.where("abs(TEMP - (280 + x + level)) > 0.01 OR HGTS <> 1000 * level + y").count()
    assert far == 0 and upper.count() == 4 * GRID.nx * GRID.ny
    heights = datasets.z_msl(datasets.z_agl(upper, surface), surface)
    assert heights.where("z_agl <> HGTS - 100 - y OR z_msl <> HGTS").count() == 0
    again = datasets.write_dataset(upper.drop("pressure"), surface, str(tmp_path / "again"))  # the frames know their grid, axis and source
    assert packed.check_index(packed.read_index(spark, [again])).count() == 0


def test_writing_keeps_its_contract(spark, frames, tmp_path):
    upper, surface = frames
    hole = F.when((F.col("x") == 3) & (F.col("y") == 4), F.lit(None)).otherwise(F.col("TEMP"))
    for bad, error, what in (
        ({"upper": None, "surface": None}, ValueError, "nothing"),
        ({"upper": None, "axis": None}, ValueError, "axis"),
        ({"upper": upper.drop("level")}, ValueError, "level"),
        ({"upper": upper.withColumnRenamed("TEMP", "DIFT")}, ValueError, "difference"),
        ({"upper": upper.withColumnRenamed("TEMP", "TEMPS")}, ValueError, "4 characters"),
        ({"upper": upper.withMetadata("TEMP", {"diff": "TEMD"})}, ValueError, "DIF"),
        ({"upper": upper.where("NOT (level = 2 AND time > '2024-07-18 01:00')")}, ValueError, "lack a level"),
        ({"surface": surface.where("time < '2024-07-18 01:00'")}, ValueError, "same times"),
        ({"upper": upper.withColumn("TEMP", hole)}, Exception, "missing values"),
        ({"upper": upper.withColumn("TEMP", F.col("TEMP") / 0.0 if False else F.when(F.col("x") == 1, F.lit(float("inf"))).otherwise(F.col("TEMP")))}, Exception, "not finite"),
        ({"surface": surface.where("x <> 5")}, Exception, "no complete field"),
        ({"surface": surface.withColumn("x", F.when(F.col("x") == 5, 6).otherwise(F.col("x")))}, Exception, "twice"),
        ({"source": "TOOLONG"}, Exception, "4 characters"),
    ):
        with pytest.raises(error, match=what):
            write(frames, tmp_path, **bad)
    with pytest.raises(ValueError, match="grid"):
        datasets.grid_of(upper)


def test_surface_alone_and_forecasts(spark, frames, tmp_path):
    path = write(frames, tmp_path, upper=None, surface=frames[1].withColumn("forecast_hour", F.lit(6)))
    rows = packed.read_index(spark, path).collect()
    assert [r.forecast for r in rows] == [6, 6] and rows[0].nz == 3
    upper, surface = datasets.open_dataset(spark, path)
    assert upper.count() == 0 and {r.forecast_hour for r in surface.collect()} == {6}
    index = packed.read_index(spark, path)
    assert packed.contains(index, T0) and packed.contains(index, "2024-07-18", 0, "PRSS") and not packed.contains(index, "2024-07-18", 1)
    assert packed.recordset(index, -1).first()["time"] == T0 + datetime.timedelta(hours=3) and packed.recordset(index, T0).first()["rs_ordinal"] == 0


def test_points_without_a_time(spark, frames, tmp_path):
    one = [f.where("time < '2024-07-18 01:00'") for f in frames]
    path = write(one, tmp_path)
    points = spark.createDataFrame([(22.0, -8.0, 900.0), (23.0, -7.0, 850.0), (0.0, 0.0, 900.0)], "lon double, lat double, z double")
    got = sorted((r.lon, r.TEMP) for r in files.sample_files(spark, path, points, "TEMP").collect())
    assert got[0] == (0.0, None) and abs(got[1][1] - 283.0) < 0.01 and abs(got[2][1] - 284.5) < 0.02
    both = write(frames, tmp_path)
    with pytest.raises(ValueError, match="time"):
        files.sample_files(spark, both, points, "TEMP")


def test_a_level_of_no_pressure_is_infinitely_high(spark):
    df = spark.createDataFrame([(1, 0, 900.0, 1000.0, 280.0), (1, 1, 0.0, 1000.0, 270.0), (1, 2, 500.0, 1000.0, 260.0)], "k int, lev int, p double, ps double, tk double")
    z = [r.z_agl for r in vertical.hypsometric(df, ["k"]).orderBy("lev").collect()]
    assert z[0] > 0 and z[1] == float("inf") and not np.isfinite(z[2])
    rows = spark.createDataFrame([(1, 0, 10.0, 1.0, 15.0), (1, 1, 20.0, 2.0, 15.0), (1, 2, float("inf"), 9.0, 15.0), (1, 3, float("nan"), 9.0, 15.0), (2, 0, 10.0, 1.0, 15.0), (2, 1, float("inf"), 2.0, 15.0)], "k int, level int, coord double, value double, z double")
    assert {r.k: r.value for r in sampling.bracket(rows, ["k"]).collect()} == {1: 1.5, 2: None}


def test_indexers_and_axes(spark):
    rows = spark.range(6).select(F.col("id").cast("int").alias("level"))
    pick = lambda i: [r.level for r in rows.where(datasets.level_subset("level", i, 6)).orderBy("level").collect()]
    assert pick(2) == [2] and pick(-1) == [5] and pick(slice(1, 4)) == [1, 2, 3] and pick(slice(None, None, -2)) == [1, 3, 5] and pick([0, -2]) == [0, 4] and pick([]) == []
    with pytest.raises(IndexError):
        datasets.level_subset("level", 6, 6)
    assert datasets.axis_from_levels(spark, 2, {1: 900.0, 3: 700.0}, 1000.0).heights == [1000.0, 900.0, 0.0, 700.0]
    with pytest.raises(ValueError):
        fo.normalise_levels(3, [7])
    frame = datasets.with_spatial_metadata(spark.createDataFrame([(1, 2, 3.0, 4.0)], "y int, x int, lon double, lat double"))
    assert "axis" not in frame.schema["lon"].metadata and frame.schema["lat"].metadata["units"] == "degrees_north"


def test_arrivals_are_listed_as_a_stream(spark, frames, tmp_path):
    (tmp_path / "in").mkdir()
    write(frames, tmp_path / "in")
    stream = arrivals.index_stream(spark, str(tmp_path / "in"))
    assert stream.isStreaming
    q = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(90)
    got = spark.table("arrived")
    want = packed.read_index(spark, str(tmp_path / "in"))
    drop = ["path"]
    assert sorted(map(repr, got.drop(*drop).collect())) == sorted(map(repr, want.drop(*drop).collect()))
    assert packed.records(got).count() == packed.records(want).count() == 2 * (2 + 4)
    hours = {r.hour: r.n for r in arrivals.hourly_arrivals(want).collect()}
    assert sorted(hours.values()) == [1, 1]
