"""Records to fields to cells, filters, cubes and wide datasets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import packing
from gridloom.functions.projection import Window as GridWindow


def normalise_levels(n_levels: int, levels) -> list[int] | None:
    """Sorted distinct level indices; None means all."""
    if levels is None:
        return None
    out = sorted({int(v) for v in ([levels] if isinstance(levels, int) else levels)})
    if not out or out[0] < 0 or out[-1] >= n_levels:
        raise ValueError(f"levels are numbered from 0 to {n_levels - 1}, and at least one is needed")
    return out


def normalise_variables(variables) -> list[str]:
    out = [variables] if isinstance(variables, str) else list(variables)
    if not out:
        raise ValueError("at least one variable is needed")
    return out


def select_records(recs: DataFrame, levels: list[int] | None = None, variables: list[str] | None = None, drop: list[str] | None = None, level_col: str = "level") -> DataFrame:
    """Level and variable filters, positive and negative; difference records follow their parents."""
    if levels is not None:
        recs = recs.where(F.col(level_col).isin([int(v) for v in levels]))
    if variables is not None:
        recs = recs.where(F.col("variable").isin(list(variables)))
    if drop:
        recs = recs.where(~F.col("variable").isin(list(drop)))
    return recs


def compact_levels(df: DataFrame, level_col: str = "level", out: str = "new_level") -> DataFrame:
    """Number the levels that are left from 0: distinct levels are few, so ranks are made on them and joined back."""
    ranks = df.select(level_col).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(level_col)) - 1)
    return df.join(ranks, level_col)


def decode(loaded: DataFrame, window: GridWindow | None = None) -> DataFrame:
    """Fields of loaded records: float32 rows of the window, differences added. Payloads do not leave the decoder."""
    drop = ["payload", "diff_payload", "exponent", "precision", "initial_value", "diff_exponent", "diff_precision", "diff_initial"]
    kept = [c for c in loaded.columns if c not in drop]
    w = window
    schema = loaded.select(*kept, F.lit(0).alias("x_start"), F.lit(0).alias("y_start"), F.lit(0).alias("nx"), F.lit(0).alias("ny"), F.lit(None).cast("array<float>").alias("field")).schema

    def unpack(batches):
        for b in batches:
            fields, xs, ys, nxs, nys = [], [], [], [], []
            for g, p, e, pr, i, q, de, dp, di in zip(*(b.column(c).to_pylist() for c in ("grid", "payload", "exponent", "precision", "initial_value", "diff_payload", "diff_exponent", "diff_precision", "diff_initial")), strict=True):
                nx, ny = g["nx"], g["ny"]
                box = (w.x_start, w.x_stop, w.y_start, w.y_stop) if w else (0, nx, 0, ny)
                f = packing.unpack(p, nx, ny, pr, e, i, box)
                if q is not None:
                    f = f + packing.unpack(q, nx, ny, dp, de, di, box)
                fields.append(f.ravel())
                xs.append(box[0])
                ys.append(box[2])
                nxs.append(box[1] - box[0])
                nys.append(box[3] - box[2])
            new = [pa.array(v, pa.int32()) for v in (xs, ys, nxs, nys)] + [pa.array(fields, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, "x_start", "y_start", "nx", "ny", "field"])

    return loaded.mapInArrow(unpack, schema)


def cells(fields: DataFrame) -> DataFrame:
    """One row per grid cell of decoded fields."""
    rest = [c for c in fields.columns if c not in ("field", "x_start", "y_start", "nx", "ny")]
    out = fields.select(*rest, "x_start", "y_start", "nx", F.posexplode("field").alias("_i", "value"))
    return out.select(*rest, (F.col("y_start") + F.floor(F.col("_i") / F.col("nx"))).cast("int").alias("y"), (F.col("x_start") + F.col("_i") % F.col("nx")).alias("x"), "value")


def field_bytes(cells_: DataFrame, nx: int, keys: list[str], y0: int = 0, x0: int = 0, ny: int | None = None) -> DataFrame:
    """Cells back to fields as little-endian float32 rows, for writing. Each cell of a field must be there once, with a value."""
    place = ((F.col("y") - y0) * nx + (F.col("x") - x0)).cast("long").alias("i")
    packed = cells_.groupBy(*keys).agg(F.collect_list(F.struct(place, F.col("value").cast("float").alias("v"))).alias("a"))
    schema = packed.select(*keys, F.lit(None).cast("binary").alias("data")).schema

    def pack(batches):
        for b in batches:
            data, at = [], b.column("a")
            both = at.flatten()
            places, values = both.field("i").to_numpy(zero_copy_only=False), both.field("v")
            offsets = at.offsets.to_numpy() - at.offsets[0].as_py()
            known = values.is_valid().to_numpy(zero_copy_only=False)
            values = values.to_numpy(zero_copy_only=False)
            for k, (start, stop) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                size = nx * ny if ny else stop - start
                field, seen, i = np.empty(size, "<f4"), np.zeros(size, bool), places[start:stop]
                name = {c: b.column(c)[k].as_py() for c in keys}
                if size != stop - start or size % nx or i.min() < 0 or i.max() >= size:
                    raise ValueError(f"{name} is no complete field of {nx} x {ny or size // nx} cells")
                if not known[start:stop].all():
                    raise ValueError(f"{name} has missing values")
                seen[i] = True
                if not seen.all():
                    raise ValueError(f"{name} holds a cell twice and another not at all")
                field[i] = values[start:stop]
                data.append(field.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(data, pa.binary())], names=[*keys, "data"])

    return packed.mapInArrow(pack, schema)


def encode(fields: DataFrame, nx: int, ny: int, difference: bool = False) -> DataFrame:
    """Fields (`data`, float32 rows) packed by the writer's encoder: codes, exponent, precision, initial and checksum; with difference, of what the packing loses."""
    kept = [c for c in fields.columns if c != "data"]
    schema = fields.select(*kept, F.lit(None).cast("array<int>").alias("codes"), F.lit(0).alias("exponent"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("initial"), F.lit(0).alias("checksum")).schema

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column("data"):
                field = np.frombuffer(raw.as_buffer(), "<f4").reshape(ny, nx)
                p = packing.pack(field)
                out.append(packing.residual(field, p) if difference else p)
            codes = pa.array([np.frombuffer(p.payload, np.uint8).astype(np.int32) for p in out], pa.list_(pa.int32()))
            new = [codes, pa.array([p.exponent for p in out], pa.int32()), pa.array([p.precision for p in out], pa.float64()), pa.array([p.initial for p in out], pa.float64()), pa.array([p.checksum for p in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, "codes", "exponent", "precision", "initial", "checksum"])

    return fields.mapInArrow(run, schema)


def cube(cells_: DataFrame, variable: str, time: str = "time", level: str = "level") -> DataFrame:
    """(time, level, y, x, value) of one variable over all of its times and levels; null where a slice is absent."""
    mine = cells_.where(F.col("variable") == variable)
    # the spine of times x levels is built from two small arrays, one row per cell of the plane carries it
    span = mine.agg(F.collect_set(time).alias("ts"), F.collect_set(level).alias("ls"))
    plane = mine.select("y", "x").distinct().join(F.broadcast(span)).select("y", "x", F.explode("ts").alias(time), "ls").select("y", "x", time, F.explode("ls").alias(level))
    return plane.join(mine.select(time, level, "y", "x", "value"), [time, level, "y", "x"], "left")


def surface_variables(cells_: DataFrame, level: str = "level") -> DataFrame:
    """Variables whose records all stand at level 0."""
    return cells_.groupBy("variable").agg(F.max(level).alias("top")).where("top = 0").select("variable")


def dataset(cells_: DataFrame, variables: list[str], time: str = "time", level: str = "level", surface: list[str] | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The wide analysis view: upper-air variables keyed by (time, level, y, x), surface ones by (time, y, x); `keep` goes along with the time.

    Level 0 slices of variables that exist aloft too are left out of the upper frame; `cells` keeps all. surface names the
    variables that stand at level 0 only; they are looked up in the cells if it is not given. Each frame holds its own variables alone.
    """
    if surface is None:
        found = surface_variables(cells_.where(F.col("variable").isin(variables)), level)
        surface = [r[0] for r in found.collect()]  # some of the named variables
    low, high = [v for v in variables if v in surface], [v for v in variables if v not in surface]
    one = lambda v: F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v)
    also = [F.first(c).alias(c) for c in keep]
    upper = cells_.where(F.col("variable").isin(high) & (F.col(level) > 0)).groupBy(time, level, "y", "x")
    ground = cells_.where(F.col("variable").isin(low)).groupBy(time, "y", "x")
    frame = lambda g, names: g.agg(*also, *map(one, names)) if also or names else g.agg(F.lit(1).alias("_")).drop("_")
    return frame(upper, high), frame(ground, low)


def unpivot(wide: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    return wide.unpivot(keys, variables, "variable", "value").where(F.col("value").isNotNull())
