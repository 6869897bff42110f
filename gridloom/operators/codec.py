"""The codec on exploded cells, in pure Catalyst: the same maths as gridloom.functions.packing for use inside queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.scalars import checksum

__all__ = ["checksum", "decode_cells", "encode_rows", "pack_parameters", "zero_small"]


def pack_parameters(cells: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, exponent, precision) of each field."""
    along = F.col(value) - F.lag(value).over(Window.partitionBy(*keys, "y").orderBy("x"))
    # only the first column is compared downwards; its rows come from the same partitioning by field
    first = F.when(F.col("x") == 0, F.col(value))
    down = F.when(F.col("x") == 0, first - F.lag(first).over(Window.partitionBy(*keys, "x").orderBy("y")))
    steps = cells.withColumns({"_a": F.abs(along), "_d": F.abs(down)})
    out = steps.groupBy(*keys).agg(F.greatest(F.max("_a"), F.max("_d")).alias("rmax"))
    power = F.when(F.col("rmax") > 0, F.log("rmax") / F.log(F.lit(2.0))).otherwise(0.0)
    cut = F.when(power >= 0, F.floor(power)).otherwise(F.ceil(power))
    exponent = cut + F.when((power >= 0) | (power == cut), 1).otherwise(0)
    return out.select(*keys, exponent.cast("int").alias("exponent")).withColumn("precision", F.pow(F.lit(2.0), F.col("exponent")) / 254.0)


def zero_small(value: Column, precision: Column) -> Column:
    return F.when(F.abs(value) < precision, 0.0).otherwise(value)


def encode_rows(values: Column, start: Column, scale: Column) -> Column:
    """Bytes of a sequence of values, each from what a decoder holds so far: a fold over the array."""
    def step(acc, v):
        code = F.pmod(F.floor((v - acc["now"]) * scale + 127.5), F.lit(256)).cast("int")
        return F.struct((acc["now"] + (code - 127) / scale).alias("now"), F.concat(acc["out"], F.array(code)).alias("out"))

    zero = F.struct(start.cast("double").alias("now"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def decode_cells(coded: DataFrame, keys: list[str], scale: Column, initial: Column, precision: Column, code: str = "code") -> DataFrame:
    """Values of coded cells: running sums down the first column, then along the rows."""
    step = (F.col(code) - 127) / scale
    down = F.sum(F.when(F.col("x") == 0, step)).over(Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    rows = coded.withColumn("_s", F.when(F.col("x") == 0, down + initial).otherwise(step))
    value = F.sum("_s").over(Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_v", value).withColumn("value", zero_small(F.col("_v"), precision)).drop("_s", "_v")
