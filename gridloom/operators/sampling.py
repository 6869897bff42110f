"""Point sampling: horizontal plans, corner joins, vertical coordinates and bracket interpolation.

Points meet cells in one equi-join on (time, y, x): four weighted corners a point. Everything after it is aggregation by point,
so neither side is ever collected and Catalyst may broadcast or shuffle either one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import vertical
from gridloom.functions.projection import Grid
from gridloom.sources.stores import materialize

METHODS, KINDS = ("linear", "nearest"), ("native", "pressure", "agl", "msl")
SURFACE = ("PRSS", "SHGT")


def normalise_points(points: DataFrame, time=None, key: str = "pid") -> DataFrame:
    """Points with lon, lat, z as doubles, a time and a key. All other columns are kept. A column `time` wins over `time=`."""
    if missing := [c for c in ("lon", "lat", "z") if c not in points.columns]:
        raise ValueError(f"points need the columns {missing}")
    if "time" not in points.columns:
        if time is None:
            raise ValueError("points need a time column, or time= must be given")
        points = points.withColumn("time", F.lit(time).cast("timestamp_ntz"))
    elif time is not None:
        points = points.withColumn("time", F.coalesce("time", F.lit(time).cast("timestamp_ntz")))
    if key not in points.columns:  # written, since the points are read twice and their numbers must not change
        points = materialize(points.withColumn(key, F.monotonically_increasing_id()), "points")
    return points.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat", "z")})


def inside_grid(fx: Column, fy: Column, grid: Grid) -> Column:
    ok = (fx >= 0) & (fx <= grid.nx - 1) & (fy >= 0) & (fy <= grid.ny - 1) & ~F.isnan(fx) & ~F.isnan(fy)
    return F.coalesce(ok, F.lit(False))


def horizontal_plan(points: DataFrame, grid: Grid, method: str = "linear") -> DataFrame:
    """The points with inside, lower and upper corners and weights."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    fx, fy = grid.fractional_indices(F.col("lon"), F.col("lat"))
    out = points.withColumns({"fx": fx, "fy": fy}).withColumn("inside", inside_grid(F.col("fx"), F.col("fy"), grid))
    clip = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1))).cast("int")
    if method == "nearest":
        at = {"x0": clip(F.rint("fx"), grid.nx), "y0": clip(F.rint("fy"), grid.ny)}
        return out.withColumns(at).withColumns({"x1": F.col("x0"), "y1": F.col("y0"), "wx": F.lit(0.0), "wy": F.lit(0.0)})
    out = out.withColumns({"x0": clip(F.floor("fx"), grid.nx), "y0": clip(F.floor("fy"), grid.ny)})
    return out.withColumns({"x1": clip(F.col("x0") + 1, grid.nx), "y1": clip(F.col("y0") + 1, grid.ny), "wx": F.col("fx") - F.col("x0"), "wy": F.col("fy") - F.col("y0")})


def bounding_window(plan: DataFrame) -> DataFrame:
    """One row: the cells that points inside the grid need."""
    return plan.where("inside").agg(F.min("x0").alias("x_start"), (F.max("x1") + 1).alias("x_stop"), F.min("y0").alias("y_start"), (F.max("y1") + 1).alias("y_stop"))


def corners(plan: DataFrame, keep: list[str]) -> DataFrame:
    """The weighted cells of each point inside the grid; cells without weight are not asked for."""
    one = lambda x, y, w: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), w.alias("w"))
    wx, wy = F.col("wx"), F.col("wy")
    four = F.array(one("x0", "y0", (1 - wx) * (1 - wy)), one("x1", "y0", wx * (1 - wy)), one("x0", "y1", (1 - wx) * wy), one("x1", "y1", wx * wy))
    return plan.where("inside").select(*keep, F.explode(four).alias("c")).select(*keep, "c.x", "c.y", "c.w").where("w <> 0")


def profiles(plan: DataFrame, cells: DataFrame, key: str = "pid", time: str = "time", level: str = "level", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, variable, level, value) of every point at every level of every variable of its time; `keep` goes along from the point."""
    met = corners(plan, [key, time, *keep]).join(cells.select(time, level, "variable", "y", "x", "value"), [time, "y", "x"])
    weight = F.sum(F.col("w") * F.col("value").cast("double"))
    # a missing corner leaves the whole sample missing
    return met.groupBy(key, *keep, "variable", level).agg(F.when(F.count("value") == F.count("w"), weight).alias("value"))


def bracket(rows: DataFrame, by: list[str], coord: str = "coord", z: str = "z", value: str = "value", level: str = "level", level_free: Column | None = None) -> DataFrame:
    """Linear interpolation of (coord, value) profiles at z: closed at both ends, at least two levels, null outside.

    Profiles for which level_free holds, or that have one level only, give the value of their lowest level instead. One
    aggregation does both.
    """
    c, v, lv = F.col(coord), F.col(value), F.col(level)
    finite = (c > float("-inf")) & (c < float("inf"))  # NaN is above infinity
    ok = F.coalesce(finite & v.isNotNull() & ~F.isnan(v), F.lit(False))
    below, above = ok & (c <= F.col(z)), ok & (c >= F.col(z))
    got = rows.groupBy(*by).agg(
        F.max(F.when(below, F.struct(c.alias("c"), (-lv).alias("l"), v.alias("v")))).alias("lo"),
        F.min(F.when(above, F.struct(c.alias("c"), lv.alias("l"), v.alias("v")))).alias("hi"),
        F.count(F.when(ok, 1)).alias("n"),
        F.max(z).alias(z),
        F.min(F.struct(lv.alias("l"), v.alias("v"))).alias("low"),
        F.count(F.lit(1)).alias("levels"),
    )
    span = F.col("hi.c") - F.col("lo.c")
    out = F.when(span == 0, F.col("lo.v")).otherwise(F.col("lo.v") + (F.col(z) - F.col("lo.c")) / F.nullif(span, F.lit(0.0)) * (F.col("hi.v") - F.col("lo.v")))
    out = F.when((F.col("n") >= 2) & F.col("lo").isNotNull() & F.col("hi").isNotNull(), out)
    if level_free is not None:
        out = F.when(level_free | (F.col("levels") == 1), F.col("low.v")).otherwise(out)
    return got.select(*by, out.alias(value))


def needs(flag: int, kind: str, pressure: bool) -> list[str]:
    """Variables besides the wanted ones that a coordinate takes."""
    if kind not in KINDS:
        raise ValueError(f"z_kind must be one of {KINDS}")
    vertical.check_flag(flag)
    out = []
    if flag in (vertical.SIGMA, vertical.HYBRID):
        out += ["PRSS"] if kind == "pressure" or pressure else []
        out += ["PRSS", "TEMP"] if kind in ("agl", "msl") else []
    elif flag == vertical.PRESSURE and kind in ("agl", "msl"):
        out += ["HGTS"]
    if kind == "msl" and flag != vertical.PRESSURE or kind == "agl" and flag == vertical.PRESSURE:
        out += ["SHGT"]
    if flag == vertical.TERRAIN and kind == "pressure":
        raise ValueError("terrain-following axes have no pressure")
    return list(dict.fromkeys(out))


def level_coordinates(prof: DataFrame, heights: list[float], flag: int, kind: str, offset: float = 0.0, key: str = "pid", level: str = "level") -> DataFrame:
    """Profile rows with `coord`, the vertical coordinate of their level at their point.

    Auxiliary variables (surface pressure, terrain, heights) are spread over a point's rows by windows on the point, the
    partitioning that the profiles already have.
    """
    lv, stored = F.col(level), vertical.stored_level(heights, F.col(level))
    over = Window.partitionBy(key)
    surface = F.min_by(F.when(F.col("variable") == "PRSS", F.col("value")), F.when(F.col("variable") == "PRSS", lv)).over(over)
    terrain = F.min_by(F.when(F.col("variable") == "SHGT", F.col("value")), F.when(F.col("variable") == "SHGT", lv)).over(over)
    if kind == "native":
        return prof.withColumn("coord", lv.cast("double"))
    if flag == vertical.PRESSURE:
        if kind == "pressure":
            return prof.withColumn("coord", stored)
        heights_of = F.max(F.when(F.col("variable") == "HGTS", F.col("value"))).over(Window.partitionBy(key, level))
        rows = prof.withColumns({"_h": heights_of, "_t": terrain})
        return rows.withColumn("coord", F.greatest(F.col("_h") - F.col("_t"), F.lit(0.0)) if kind == "agl" else F.col("_h")).drop("_h", "_t")
    if flag == vertical.TERRAIN:
        if kind == "pressure":
            raise ValueError("terrain-following axes have no pressure")
        return prof.withColumn("coord", stored) if kind == "agl" else prof.withColumn("_t", terrain).withColumn("coord", stored + F.col("_t")).drop("_t")
    rows = prof.withColumn("_s", surface)
    p = vertical.sigma_pressure(stored, F.col("_s"), offset) if flag == vertical.SIGMA else vertical.hybrid_pressure(stored, F.col("_s"), lv)
    if kind == "pressure":
        return rows.withColumn("coord", p).drop("_s")
    temperature = F.max(F.when(F.col("variable") == "TEMP", F.col("value"))).over(Window.partitionBy(key, level))
    rows = rows.withColumns({"_p": p, "_tk": temperature, "_t": terrain})
    # each variable's sum starts at that variable's own first level
    rows = vertical.hypsometric(rows, [key, "variable"], level, "_p", "_s", "_tk", "_z")
    return rows.withColumn("coord", F.col("_z") + F.col("_t") if kind == "msl" else F.col("_z")).drop("_s", "_p", "_tk", "_t", "_z")


def sample_points(cells: DataFrame, points: DataFrame, variables: list[str], grid: Grid, heights: list[float], flag: int, z_kind: str = "pressure", method: str = "linear", offset: float = 0.0, time=None, key: str = "pid") -> DataFrame:
    """The points with one column per variable, null where a point is outside the grid or the profile.

    cells: time, level, variable, y, x, value. The variable `pressure` is the pressure at z. PRSS, SHGT and variables with a
    single level are sampled horizontally only.
    """
    variables = [variables] if isinstance(variables, str) else list(variables)
    if not variables:
        raise ValueError("at least one variable is needed")
    wants_pressure = "pressure" in variables
    real = [v for v in variables if v != "pressure"]
    extra = needs(flag, z_kind, wants_pressure and z_kind != "pressure")
    points = normalise_points(points, time, key)
    plan = horizontal_plan(points, grid, method)
    asked = cells.where(F.col("variable").isin(sorted({*real, *extra})))
    if "HGTS" in extra and not wants_pressure and not real:
        asked = cells.where(F.col("variable").isin(extra))
    prof = profiles(plan, asked, key, keep=("z",))
    if wants_pressure and z_kind != "pressure":
        prof = prof.unionByName(_pressure_profiles(prof, heights, flag, offset, key))
    rows = level_coordinates(prof, heights, flag, z_kind, offset, key)
    found = bracket(rows, [key, "variable"], level_free=F.col("variable").isin(*SURFACE))
    wide = found.groupBy(key).agg(*[F.max(F.when(F.col("variable") == v, F.col("value"))).cast("float").alias(v) for v in variables if not (v == "pressure" and z_kind == "pressure")])
    out = points.join(wide, key, "left")
    if wants_pressure and z_kind == "pressure":
        out = out.withColumn("pressure", F.col("z").cast("float"))
    return out


def _pressure_profiles(prof: DataFrame, heights: list[float], flag: int, offset: float, key: str) -> DataFrame:
    """Synthetic profile rows of the pressure at every level of the axis."""
    surface = prof.groupBy(key, "z").agg(F.min_by(F.when(F.col("variable") == "PRSS", F.col("value")), F.when(F.col("variable") == "PRSS", F.col("level"))).alias("_s"))
    levels = surface.select(key, "z", "_s", F.posexplode(F.array(*[F.lit(float(h)) for h in heights])).alias("level", "stored"))
    p = vertical.level_pressure(F.lit(flag), F.col("stored"), F.col("level"), F.col("_s"), offset)
    return levels.select(key, "z", F.lit("pressure").alias("variable"), "level", p.alias("value"))


def duplicate_times(times: DataFrame) -> DataFrame:
    """Times that more than one source (path) holds."""
    return times.groupBy("time").agg(F.countDistinct("path").alias("n")).where("n > 1").select("time")


def missing_times(points: DataFrame, times: DataFrame, time: str = "time") -> DataFrame:
    """Times of points that no source holds."""
    return points.select(time).distinct().join(times.select(time).distinct(), time, "left_anti")
