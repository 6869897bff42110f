"""Vertical coordinates: pressure and heights of levels for all kinds of axes, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Axis flags, the gas constant of dry air and gravity.
SIGMA, PRESSURE, TERRAIN, HYBRID = 1, 2, 3, 4
R_DRY, GRAVITY = 287.05, 9.80665
#: CF standard name and units of the level coordinate of each axis, and of the spatial coordinates: fixed values.
LEVEL_ATTRS = {SIGMA: ("atmosphere_sigma_coordinate", "1"), PRESSURE: ("air_pressure", "hPa"), TERRAIN: ("height", "m"), HYBRID: ("atmosphere_hybrid_sigma_pressure_coordinate", "1")}
#: Name of the physical level coordinate of each axis.
COORDINATE = {SIGMA: "sigma", PRESSURE: "pressure", TERRAIN: "height", HYBRID: "sigma"}


def check_flag(flag: int) -> int:
    if flag not in COORDINATE:
        raise ValueError(f"unknown vertical flag {flag}")
    return flag


def sigma_pressure(sigma: Column, surface: Column, offset: float | Column = 0.0) -> Column:
    return (surface - offset) * sigma + offset


def hybrid_pressure(stored: Column, surface: Column, level: Column) -> Column:
    """floor(L) + surface x (L - floor L); level index 0 is the surface."""
    return F.when(level == 0, surface).otherwise(F.floor(stored) + surface * (stored - F.floor(stored)))


def level_pressure(flag: Column, stored: Column, level: Column, surface: Column, offset: float | Column = 0.0) -> Column:
    """Pressure of a level on any axis; null on terrain-following ones."""
    return F.when(flag == SIGMA, sigma_pressure(stored, surface, offset)).when(flag == PRESSURE, stored).when(flag == HYBRID, hybrid_pressure(stored, surface, level))


def hypsometric(df: DataFrame, by: list[str], level: str = "lev", pressure: str = "p", surface: str = "ps", temperature: str = "tk", out: str = "z_agl") -> DataFrame:
    """Heights above ground from pressures and temperatures, summed upwards from the lowest level of each column."""
    w = Window.partitionBy(*by).orderBy(level)
    p, t = F.col(pressure), F.col(temperature)
    below_p, below_t = F.lag(p).over(w), F.lag(t).over(w)
    k = R_DRY / GRAVITY
    inf = float("inf")

    def log_ratio(below: Column, above: Column) -> Column:
        """A level of zero pressure is infinitely high, and what stands above it has no height."""
        return F.when(above == 0, F.lit(inf)).when(below == 0, F.lit(-inf)).otherwise(F.log(below / above))

    step = F.when(below_p.isNull(), t * k * log_ratio(F.col(surface), p)).otherwise((below_t + t) / 2 * k * log_ratio(below_p, p))
    df = df.withColumn("_dz", step)
    return df.withColumn(out, F.sum("_dz").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_dz")


def axis_levels(spark, heights: list[float]) -> DataFrame:
    """(lev, stored) of an axis."""
    return spark.createDataFrame(list(enumerate(map(float, heights))), "lev int, stored double")


def sparse_axis(levels: DataFrame, level: str = "lev", stored: str = "stored") -> DataFrame:
    """An axis from a part of its levels: those that are missing up to the highest have 0."""
    top = levels.agg(F.max(level).alias("top")).select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias(level))
    return top.join(levels, level, "left").select(level, F.coalesce(F.col(stored), F.lit(0.0)).alias(stored))


def stored_level(heights: list[float], level: Column) -> Column:
    """The stored value of a level index; null outside the axis."""
    return F.try_element_at(F.array(*[F.lit(float(h)) for h in heights]), (level + 1).cast("int"))
