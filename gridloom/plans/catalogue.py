"""The query catalogue: each operator over the gridded view, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import scalars, vertical
from gridloom.operators import codec, datasets, files, sampling
from gridloom.operators import fields as fo
from gridloom.plans import bridge as b
from gridloom.sources import archive, packed
from gridloom.sources.stores import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAG_NAMES = {1: "sigma", 2: "pressure", 3: "terrain", 4: "hybrid"}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def with_view(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join([b.SQL, *ctes]) + "\n" + body


def stored_sql(flag: int, level: str = "level") -> str:
    return "(CASE " + " ".join(f"WHEN {level} = {i} THEN {h}::DOUBLE" for i, h in enumerate(b.AXES[flag])) + " END)"


# --- codec -----------------------------------------------------------------------------------------------------------

def _codes(spark, sf):
    """(t, lev, y, x, code): bytes made of the cells' quantities."""
    return b.counts(spark, sf).select("t", "lev", "y", "x", (F.floor(F.col("q") * 4) % 256).cast("int").alias("code"))


_CODES = "codes AS (SELECT t, lev, y, x, (floor(q * 4)::BIGINT % 256)::INT AS code FROM g)"


@query(with_view("SELECT t, lev, y, CASE WHEN sum(code) = 0 THEN 0 ELSE (sum(code) - 1) % 255 + 1 END::BIGINT AS checksum FROM codes GROUP BY t, lev, y", _CODES))
def q01_checksum(spark, sf):
    return _codes(spark, sf).groupBy("t", "lev", "y").agg(F.sum("code").alias("s")).select("t", "lev", "y", scalars.checksum(F.col("s")).cast("long").alias("checksum"))


_PARAMS = """
pa AS (SELECT t, lev, y, x, abs(temp - lag(temp) OVER (PARTITION BY t, lev, y ORDER BY x)) AS a, CASE WHEN x = 0 THEN abs(temp - lag(temp) OVER (PARTITION BY t, lev, x ORDER BY y)) END AS d FROM w),
pb AS (SELECT t, lev, greatest(max(a), max(d)) AS r FROM pa GROUP BY t, lev),
pc AS (SELECT t, lev, CASE WHEN r > 0 THEN ln(r) / ln(2::DOUBLE) ELSE 0 END AS p FROM pb),
params AS (SELECT t, lev, (trunc(p) + CASE WHEN p >= 0 OR p = trunc(p) THEN 1 ELSE 0 END)::INT AS exponent, pow(2::DOUBLE, trunc(p) + CASE WHEN p >= 0 OR p = trunc(p) THEN 1 ELSE 0 END) / 254::DOUBLE AS precision FROM pc)"""


def _temps(spark, sf):
    return b.wide(spark, sf).select("t", "lev", "y", "x", F.col("temp").alias("value"))


def _params(spark, sf):
    return codec.pack_parameters(_temps(spark, sf), ["t", "lev"])


@query(with_view("SELECT * FROM params", _PARAMS))
def q02_pack_parameters(spark, sf):
    return _params(spark, sf)


_ENCODED = """
e0 AS (SELECT w.t, w.lev, w.y, w.x, CASE WHEN abs(temp) < p.precision THEN 0 ELSE temp END AS v, pow(2::DOUBLE, 7 - p.exponent) AS scale FROM w JOIN params p USING (t, lev)),
c0 AS (SELECT t, lev, y, v, scale, 127 AS code, v AS now FROM e0 WHERE x = 0 AND y = 0 UNION ALL
  SELECT e.t, e.lev, e.y, e.v, e.scale, floor((e.v - c.now) * e.scale + 127.5::DOUBLE)::INT & 255, c.now + ((floor((e.v - c.now) * e.scale + 127.5::DOUBLE)::INT & 255) - 127) / e.scale FROM c0 c JOIN e0 e ON e.x = 0 AND e.t = c.t AND e.lev = c.lev AND e.y = c.y + 1),
cr AS (SELECT t, lev, y, 0 AS x, scale, code, now FROM c0 UNION ALL
  SELECT e.t, e.lev, e.y, e.x, e.scale, floor((e.v - c.now) * e.scale + 127.5::DOUBLE)::INT & 255, c.now + ((floor((e.v - c.now) * e.scale + 127.5::DOUBLE)::INT & 255) - 127) / e.scale FROM cr c JOIN e0 e ON e.t = c.t AND e.lev = c.lev AND e.y = c.y AND e.x = c.x + 1)"""


def _fields(spark, sf):
    """(t, lev, data): the temperatures as fields."""
    return fo.field_bytes(_temps(spark, sf), b.NX, ["t", "lev"], ny=b.NY)


def _code_cells(spark, sf):
    """(t, lev, y, x, code, scale, initial, precision) of the encoder that files are written with."""
    packed_ = fo.encode(_fields(spark, sf), b.NX, b.NY).withColumn("scale", F.pow(F.lit(2.0), 7 - F.col("exponent")))
    rows = packed_.select("t", "lev", "scale", "initial", "precision", F.posexplode("codes").alias("i", "code"))
    return rows.select("t", "lev", F.floor(F.col("i") / b.NX).cast("int").alias("y"), (F.col("i") % b.NX).alias("x"), "code", "scale", "initial", "precision")


@query(with_view("SELECT t, lev, y, x, code::INT AS code FROM cr", _PARAMS, _ENCODED))
def q03_encode(spark, sf):
    return _code_cells(spark, sf).select("t", "lev", "y", "x", "code")


_STEPS = "d0 AS (SELECT t, lev, y, x, (code - 127) / 64::DOUBLE AS s FROM codes), d1 AS (SELECT *, sum(CASE WHEN x = 0 THEN s END) OVER (PARTITION BY t, lev, x ORDER BY y) AS down FROM d0), dec AS (SELECT t, lev, y, x, 280 + sum(CASE WHEN x = 0 THEN down ELSE s END) OVER (PARTITION BY t, lev, y ORDER BY x) AS value FROM d1)"


def _decoded(spark, sf):
    return codec.decode_cells(_codes(spark, sf), ["t", "lev"], F.lit(64.0), F.lit(280.0), F.lit(0.0)).select("t", "lev", "y", "x", "value")


@query(with_view("SELECT * FROM dec", _CODES, _STEPS))
def q04_decode(spark, sf):
    return _decoded(spark, sf)


@query(with_view("SELECT * FROM dec WHERE x >= 5 AND x < 12 AND y >= 3 AND y < 9", _CODES, _STEPS))
def q05_decode_window(spark, sf):
    """Only the window's rows up to its last column, and the first column down to its last row, are decoded."""
    from gridloom.functions.projection import Window as W

    needed = _codes(spark, sf).where((F.col("x") < 12) & (F.col("y") < 9) & ((F.col("y") >= 3) | (F.col("x") == 0)))
    out = codec.decode_cells(needed, ["t", "lev"], F.lit(64.0), F.lit(280.0), F.lit(0.0))
    return out.where(W(5, 12, 3, 9).predicate()).select("t", "lev", "y", "x", "value")


@query(with_view("SELECT w.t, w.lev, y, x, CASE WHEN abs(temp - 300) < 8 * p.precision THEN 0 ELSE temp - 300 END::DOUBLE AS value FROM w JOIN params p USING (t, lev)", _PARAMS))
def q06_zero_small(spark, sf):
    rows = _temps(spark, sf).join(_params(spark, sf), ["t", "lev"])
    return rows.select("t", "lev", "y", "x", codec.zero_small(F.col("value") - 300, 8 * F.col("precision")).alias("value"))


@query(with_view("SELECT t AS time, lev AS level, y, x, temp::DOUBLE AS value FROM w"))
def q07_parent_plus_difference(spark, sf):
    """Temperatures of packed files: the parent and its difference record, both decoded and added."""
    got = files.open_cells(spark, b.packed_folder(spark, sf), ["TEMP"])
    return got.select(F.year("time").alias("time"), "level", "y", "x", b.snapped(F.col("value")).alias("value"))


@query(with_view("SELECT c.t, c.lev, c.y, c.x, e.v - CASE WHEN abs(c.now) < p.precision THEN 0 ELSE c.now END AS value FROM cr c JOIN e0 e USING (t, lev, y, x) JOIN params p ON p.t = c.t AND p.lev = c.lev", _PARAMS, _ENCODED))
def q08_difference_residual(spark, sf):
    out = codec.decode_cells(_code_cells(spark, sf), ["t", "lev"], F.col("scale"), F.col("initial"), F.col("precision")).withColumnRenamed("value", "back")
    return out.join(_temps(spark, sf), ["t", "lev", "y", "x"]).select("t", "lev", "y", "x", (F.col("value") - F.col("back")).alias("value"))


_RECORDS = """
rec AS (SELECT DISTINCT time, level, variable, CASE variable WHEN 'TEMP' THEN 0 WHEN 'HGTS' THEN 2 WHEN 'PRSS' THEN 3 ELSE 4 END AS o FROM cells),
entry AS (SELECT *, row_number() OVER (PARTITION BY time ORDER BY level, o) - 1 AS e FROM (SELECT * FROM rec UNION ALL SELECT time, level, 'DIFT', 1 FROM rec WHERE variable = 'TEMP'))"""


@query(with_view("SELECT time, level, variable, TRUE AS checksum_ok FROM rec", _RECORDS))
def q09_verify_checksums(spark, sf):
    """Checksums of all records of the packed files, differences included."""
    loaded = packed.with_payload(packed.records(packed.read_index(spark, b.packed_folder(spark, sf))))
    return packed.verify_checksums(loaded).select(F.year("time").alias("time"), "level", "variable", "checksum_ok")


# --- filters, grids, datasets ------------------------------------------------------------------------------------------

@query(with_view("SELECT time, level, variable, y, x, value FROM cells WHERE level IN (0, 2) AND variable IN ('TEMP', 'PRSS', 'SHGT') AND variable NOT IN ('SHGT')"))
def q10_select_records(spark, sf):
    return fo.select_records(b.cells(spark, sf), [0, 2], ["TEMP", "PRSS", "SHGT"], ["SHGT"])


@query(with_view("SELECT time, level, variable, y, x, value, (dense_rank() OVER (ORDER BY level) - 1)::INT AS new_level FROM cells WHERE level IN (1, 3)"))
def q11_compact_levels(spark, sf):
    return fo.compact_levels(fo.select_records(b.cells(spark, sf), [1, 3])).select("time", "level", "variable", "y", "x", "value", F.col("new_level").cast("int").alias("new_level"))


@query("SELECT o_orderkey, (((o_orderkey * 7 % 1441 - 720 + 180) % 360 + 360) % 360 - 180)::DOUBLE AS lon FROM orders")
def q12_wrap_longitudes(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", scalars.wrap_lon((F.col("o_orderkey") * 7 % 1441 - 720).cast("double")).alias("lon"))


@query("SELECT y::INT AS y, x::INT AS x, 20::DOUBLE + x AS lon, -10::DOUBLE + y AS lat FROM range(0, 20) a(y), range(0, 20) c(x)")
def q13_grid_coords(spark, sf):
    return b.GRID.coords(spark)


_BOXES = [(22.5, -8.0, 30.0, 4.5), (35.0, -3.0, 21.0, 9.0)]


@query("""WITH c AS (SELECT y, x, 20::DOUBLE + x AS lon, -10::DOUBLE + y AS lat FROM range(0, 20) a(y), range(0, 20) d(x)),
bx AS (SELECT * FROM (VALUES (0, 22.5::DOUBLE, -8::DOUBLE, 30::DOUBLE, 4.5::DOUBLE), (1, 35, -3, 21, 9)) v(box, w, s, e, n))
SELECT box::INT AS box, min(x)::INT AS x_start, (max(x) + 1)::INT AS x_stop, min(y)::INT AS y_start, (max(y) + 1)::INT AS y_stop FROM c, bx
WHERE CASE WHEN w <= e THEN lon BETWEEN w AND e ELSE lon >= w OR lon <= e END AND lat BETWEEN s AND n GROUP BY box""")
def q14_bbox_window(spark, sf):
    coords = b.GRID.coords(spark).withColumn("lon", scalars.wrap_lon(F.col("lon")))
    inside = lambda w, s, e, n: (F.col("lon").between(w, e) if w <= e else (F.col("lon") >= w) | (F.col("lon") <= e)) & F.col("lat").between(s, n)
    hit = coords.select("*", F.explode(F.array(*[F.when(inside(*box), F.lit(i)).otherwise(F.lit(-1)) for i, box in enumerate(_BOXES)])).alias("box")).where("box >= 0")
    return hit.groupBy("box").agg(F.min("x").alias("x_start"), (F.max("x") + 1).alias("x_stop"), F.min("y").alias("y_start"), (F.max("y") + 1).alias("y_stop"))


@query("SELECT 23::DOUBLE AS sync_lon, -8::DOUBLE AS sync_lat, 1::DOUBLE AS sync_x, 1::DOUBLE AS sync_y, 8 AS nx, 13 AS ny")
def q15_subset_grid(spark, sf):
    g = b.GRID.subset(b.GRID.window_from_bbox(_BOXES[0]))
    p = g.projection
    return spark.createDataFrame([(float(p.sync_lon), float(p.sync_lat), p.sync_x, p.sync_y, g.nx, g.ny)], "sync_lon double, sync_lat double, sync_x double, sync_y double, nx int, ny int")


@query(with_view("SELECT time, (dense_rank() OVER (ORDER BY level) - 1)::INT AS level, variable, y - 2 AS y, x - 3 AS x, value FROM cells WHERE variable IN ('TEMP', 'HGTS') AND level IN (1, 3) AND x >= 3 AND x < 11 AND y >= 2 AND y < 15"))
def q16_extract_subset(spark, sf):
    w = b.GRID.window_from_bbox(_BOXES[0])
    kept = fo.select_records(b.cells(spark, sf).where(w.predicate()), [1, 3], ["TEMP", "HGTS"])
    return fo.compact_levels(kept).select("time", F.col("new_level").cast("int").alias("level"), "variable", (F.col("y") - w.y_start).alias("y"), (F.col("x") - w.x_start).alias("x"), "value")


@query(with_view("SELECT time, (158 + 8 * count(DISTINCT level) + 8 * count(*))::BIGINT AS used, 158 + 8 * count(DISTINCT level) + 8 * count(*) <= 50 + 12 * 12 AS fits FROM entry GROUP BY time", _RECORDS))
def q17_record_length(spark, sf):
    """Bytes of the index records of the packed files, and whether they fit in the records of a grid of 12 x 12."""
    used = files.index_bytes(packed.records(packed.read_index(spark, b.packed_folder(spark, sf))))
    return used.select(F.year("time").alias("time"), "used", (F.col("used") <= scalars.record_length(F.lit(12), F.lit(12))).alias("fits"))


@query(with_view("SELECT t AS time, lev AS level, y, x, temp AS TEMP, hgts AS HGTS FROM w WHERE lev > 0"))
def q18_dataset_upper(spark, sf):
    return fo.dataset(b.cells(spark, sf), ["TEMP", "HGTS"])[0]


@query(with_view("SELECT t AS time, y, x, prss AS PRSS, shgt AS SHGT FROM w WHERE lev = 0"))
def q19_dataset_surface(spark, sf):
    return fo.dataset(b.cells(spark, sf), ["PRSS", "SHGT"])[1]


@query(with_view("SELECT variable FROM cells GROUP BY variable HAVING max(level) = 0"))
def q19b_surface_variables(spark, sf):
    return fo.surface_variables(b.cells(spark, sf))


@query(with_view("SELECT a.t AS time, a.lev AS level, a.y, a.x, CASE WHEN (a.t, a.lev) NOT IN ((1997, 2), (1998, 0)) THEN temp END AS value FROM w a"))
def q20_cube(spark, sf):
    some = b.cells(spark, sf).where("NOT (time = 1997 AND level = 2 OR time = 1998 AND level = 0)")
    return fo.cube(some, "TEMP")


@query("SELECT lev::INT AS lev, CASE lev WHEN 1 THEN 900::DOUBLE WHEN 3 THEN 700 ELSE 0 END AS stored FROM range(0, 4) a(lev)")
def q21_sparse_axis(spark, sf):
    return vertical.sparse_axis(vertical.axis_levels(spark, b.AXES[2]).where(F.col("lev").isin(1, 3)))


@query(with_view(f"SELECT time, level, variable, y, x, value, {stored_sql(2)} AS pressure FROM cells WHERE variable = 'TEMP'"))
def q21b_level_coordinate(spark, sf):
    return b.cells(spark, sf).where("variable = 'TEMP'").withColumn(vertical.COORDINATE[2], vertical.stored_level(b.AXES[2], F.col("level")))


@query(with_view("SELECT t, lev, y, x, 'temp' AS variable, temp AS value FROM w UNION ALL SELECT t, lev, y, x, 'hgts', hgts FROM w"))
def q22_unpivot(spark, sf):
    return fo.unpivot(b.wide(spark, sf).select("t", "lev", "y", "x", "temp", "hgts"), ["t", "lev", "y", "x"], ["temp", "hgts"])


@query(with_view("SELECT DISTINCT time FROM cells ORDER BY time"))
def q23_times(spark, sf):
    return b.cells(spark, sf).select("time").distinct().orderBy("time")


@query(with_view("SELECT DISTINCT variable FROM cells"))
def q24_variable_names(spark, sf):
    return b.cells(spark, sf).select("variable").distinct()


# --- sampling ----------------------------------------------------------------------------------------------------------

def _profiles(spark, sf, variables, kind="pressure", method="linear"):
    plan = sampling.horizontal_plan(b.points(spark, sf, kind), b.GRID, method)
    return sampling.profiles(plan, b.cells(spark, sf).where(F.col("variable").isin(variables)))


@query(with_view("SELECT pid, level, value FROM prof WHERE variable = 'TEMP'", b.points_sql()))
def q30_bilinear(spark, sf):
    return _profiles(spark, sf, ["TEMP"]).select("pid", "level", "value")


@query(with_view("SELECT f.pid, k.level, k.value FROM fx f JOIN cells k ON k.variable = 'TEMP' AND k.time = f.time AND k.x = round_even(fx, 0) AND k.y = round_even(fy, 0) WHERE fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19", b.points_sql()))
def q31_nearest(spark, sf):
    return _profiles(spark, sf, ["TEMP"], method="nearest").select("pid", "level", "value")


@query(with_view("SELECT time, count(*) AS n, count(*) FILTER (fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19) AS n_inside, min(floor(fx)) FILTER (fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19)::INT AS x_start, max(floor(fy)) FILTER (fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19)::INT AS y_last FROM fx GROUP BY time", b.points_sql()))
def q32_inside(spark, sf):
    plan = sampling.horizontal_plan(b.points(spark, sf), b.GRID)
    return plan.groupBy("time").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("inside"), 1)).alias("n_inside"), F.min(F.when(F.col("inside"), F.col("x0"))).alias("x_start"), F.max(F.when(F.col("inside"), F.col("y0"))).alias("y_last"))


@query(with_view("SELECT min(x0)::INT AS x_start, (max(x1) + 1)::INT AS x_stop, min(y0)::INT AS y_start, (max(y1) + 1)::INT AS y_stop FROM plan", b.points_sql()))
def q32b_bounding_window(spark, sf):
    return sampling.bounding_window(sampling.horizontal_plan(b.points(spark, sf), b.GRID))


def _interp(kind: str, coord: str, variables: str = "'TEMP'", pick: str = "TEMP", digits: int | None = None) -> str:
    """SQL of a sample of one variable at `coord`, an expression over prof p and its point's columns ps, ts, hg, tk."""
    aux = "aux AS (SELECT pid, max(value) FILTER (variable = 'PRSS') AS ps, max(value) FILTER (variable = 'SHGT') AS ts FROM prof GROUP BY pid), hg AS (SELECT pid, level, max(value) FILTER (variable = 'HGTS') AS hg, max(value) FILTER (variable = 'TEMP') AS tk FROM prof GROUP BY pid, level)"
    rows = f"rows AS (SELECT p.pid, p.variable, p.level, ({coord})::DOUBLE AS coord, p.value FROM prof p JOIN aux USING (pid) JOIN hg ON hg.pid = p.pid AND hg.level = p.level WHERE p.variable IN ({variables}))"
    value = f"round(v.value, {digits})" if digits else "v.value::FLOAT"
    return with_view(f"SELECT p.pid, {value} AS {pick} FROM pts p LEFT JOIN val v ON v.pid = p.pid AND v.variable = '{pick}'", b.points_sql(kind), aux, rows, b.BRACKET_SQL)


def _sampled(spark, sf, flag, kind, variables, digits=None):
    out = sampling.sample_points(b.cells(spark, sf), b.points(spark, sf, kind), variables, b.GRID, b.AXES[flag], flag, kind)
    return out.select("pid", *[F.round(F.col(v).cast("double"), digits).alias(v) if digits else F.col(v) for v in variables])


@query(_interp("native", "p.level"))
def q33_native(spark, sf):
    return _sampled(spark, sf, 2, "native", ["TEMP"])


@query(_interp("pressure", stored_sql(2, "p.level")))
def q34_pressure_axis(spark, sf):
    return _sampled(spark, sf, 2, "pressure", ["TEMP"])


@query(_interp("pressure", f"ps * {stored_sql(1, 'p.level')}"))
def q35_sigma_pressure(spark, sf):
    return _sampled(spark, sf, 1, "pressure", ["TEMP"])


@query(_interp("pressure", f"CASE WHEN p.level = 0 THEN ps ELSE floor({stored_sql(4, 'p.level')}) + ps * ({stored_sql(4, 'p.level')} - floor({stored_sql(4, 'p.level')})) END"))
def q36_hybrid_pressure(spark, sf):
    return _sampled(spark, sf, 4, "pressure", ["TEMP"])


_HYPSO = """
hp AS (SELECT t, lev, y, x, temp, prss, shgt, prss * CASE lev WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS p FROM w),
hs AS (SELECT *, CASE WHEN lev = 0 THEN temp * (287.05::DOUBLE / 9.80665::DOUBLE) * ln(prss / p) ELSE (lag(temp) OVER c + temp) / 2 * (287.05::DOUBLE / 9.80665::DOUBLE) * ln(lag(p) OVER c / p) END AS dz FROM hp WINDOW c AS (PARTITION BY t, y, x ORDER BY lev)),
hz AS (SELECT *, sum(dz) OVER (PARTITION BY t, y, x ORDER BY lev) AS z FROM hs)"""


@query(with_view("SELECT t, lev, y, x, round(z, 4) AS z_agl FROM hz", _HYPSO))
def q37_hypsometric(spark, sf):
    w = b.wide(spark, sf).withColumn("p", vertical.sigma_pressure(vertical.stored_level(b.AXES[1], F.col("lev")), F.col("prss")))
    return vertical.hypsometric(w, ["t", "y", "x"], surface="prss", temperature="temp").select("t", "lev", "y", "x", F.round("z_agl", 4).alias("z_agl"))


@query(with_view("SELECT t AS time, lev AS level, y, x, hgts - shgt AS z_agl, hgts AS z_msl FROM w WHERE lev > 0"))
def q38_dataset_heights(spark, sf):
    """Heights above ground and sea level of a dataset opened from packed files, on a pressure axis."""
    upper, surface = datasets.open_dataset(spark, b.packed_folder(spark, sf))
    got = datasets.z_msl(datasets.z_agl(upper, surface), surface)
    return got.select(F.year("time").alias("time"), "level", "y", "x", "z_agl", "z_msl")


def _on_axis(spark, sf, flag):
    """The view as a dataset of another vertical axis."""
    upper, surface = fo.dataset(b.cells(spark, sf), ["TEMP", "HGTS", "PRSS", "SHGT"], surface=["PRSS", "SHGT"])
    return [datasets.with_identity(f, b.GRID, datasets.Axis(flag, b.AXES[flag]), "VIEW") for f in (upper, surface)]


_LEVEL_P = {1: f"prss * {stored_sql(1, 'lev')}", 4: f"floor({stored_sql(4, 'lev')}) + prss * ({stored_sql(4, 'lev')} - floor({stored_sql(4, 'lev')}))"}


def _dataset_axis_sql(flag: int) -> str:
    """Pressure and hypsometric heights of the levels above the surface; sums start at the lowest of them."""
    return with_view(
        "SELECT t AS time, lev AS level, y, x, p::DOUBLE AS p, round(sum(dz) OVER (PARTITION BY t, y, x ORDER BY lev), 4) AS z_agl, round(sum(dz) OVER (PARTITION BY t, y, x ORDER BY lev) + shgt, 4) AS z_msl FROM dd",
        f"dp AS (SELECT t, lev, y, x, temp, prss, shgt, {_LEVEL_P[flag]} AS p FROM w WHERE lev > 0)",
        "dd AS (SELECT *, CASE WHEN lev = 1 THEN temp * (287.05::DOUBLE / 9.80665::DOUBLE) * ln(prss / p) ELSE (lag(temp) OVER c + temp) / 2 * (287.05::DOUBLE / 9.80665::DOUBLE) * ln(lag(p) OVER c / p) END AS dz FROM dp WINDOW c AS (PARTITION BY t, y, x ORDER BY lev))",
    )


def _dataset_axis(spark, sf, flag):
    upper, surface = _on_axis(spark, sf, flag)
    got = datasets.z_msl(datasets.z_agl(datasets.pressure(upper, surface), surface), surface)
    return got.select("time", "level", "y", "x", "p", F.round("z_agl", 4).alias("z_agl"), F.round("z_msl", 4).alias("z_msl"))


@query(_dataset_axis_sql(1))
def q38b_dataset_sigma(spark, sf):
    return _dataset_axis(spark, sf, 1)


@query(_dataset_axis_sql(4))
def q38c_dataset_hybrid(spark, sf):
    return _dataset_axis(spark, sf, 4)


@query(with_view(f"SELECT t AS time, lev AS level, y, x, {stored_sql(3, 'lev')} AS z_agl, {stored_sql(3, 'lev')} + shgt AS z_msl FROM w WHERE lev > 0"))
def q38d_dataset_terrain(spark, sf):
    upper, surface = _on_axis(spark, sf, 3)
    return datasets.z_msl(datasets.z_agl(upper, surface), surface).select("time", "level", "y", "x", "z_agl", "z_msl")


@query(_interp("agl", "greatest(hg - ts, 0)"))
def q39_agl_pressure_axis(spark, sf):
    return _sampled(spark, sf, 2, "agl", ["TEMP"])


@query(_interp("msl", "hg"))
def q39b_msl_pressure_axis(spark, sf):
    return _sampled(spark, sf, 2, "msl", ["TEMP"])


@query(_interp("agl", stored_sql(3, "p.level")))
def q40_terrain_agl(spark, sf):
    return _sampled(spark, sf, 3, "agl", ["TEMP"])


@query(_interp("msl", f"{stored_sql(3, 'p.level')} + ts"))
def q40b_terrain_msl(spark, sf):
    return _sampled(spark, sf, 3, "msl", ["TEMP"])


def _virtual_pressure_sql() -> str:
    aux = "aux AS (SELECT pid, max(value) FILTER (variable = 'SHGT') AS ts FROM prof GROUP BY pid)"
    rows = f"rows AS (SELECT p.pid, 'pressure' AS variable, p.level, greatest(p.value - ts, 0)::DOUBLE AS coord, {stored_sql(2, 'p.level')} AS value FROM prof p JOIN aux USING (pid) WHERE p.variable = 'HGTS')"
    return with_view("SELECT p.pid, v.value::FLOAT AS pressure FROM pts p LEFT JOIN val v ON v.pid = p.pid", b.points_sql("agl"), aux, rows, b.BRACKET_SQL)


@query(_virtual_pressure_sql())
def q41_virtual_pressure(spark, sf):
    return _sampled(spark, sf, 2, "agl", ["pressure"])


@query(with_view("SELECT p.pid, max(value) FILTER (variable = 'PRSS')::FLOAT AS PRSS, max(value) FILTER (variable = 'SHGT')::FLOAT AS SHGT FROM pts p LEFT JOIN prof USING (pid) GROUP BY p.pid", b.points_sql()))
def q42_surface_bypass(spark, sf):
    return _sampled(spark, sf, 2, "pressure", ["PRSS", "SHGT"])


# --- files, times, names -------------------------------------------------------------------------------------------------

def _file_times(spark, sf):
    """Orders as files with a time each: (path, time)."""
    return b.table(spark, sf, "orders").select(F.concat(F.lit("f"), (F.col("o_custkey") % 97).cast("string")).alias("path"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"))


_FILES = "ft AS (SELECT 'f' || (o_custkey % 97) AS path, o_orderdate::TIMESTAMP AS time FROM orders)"


@query(f"WITH {_FILES} SELECT time FROM ft GROUP BY time HAVING count(DISTINCT path) > 1")
def q50_duplicate_times(spark, sf):
    return sampling.duplicate_times(_file_times(spark, sf))


@query("SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP + INTERVAL (event_id % 7) HOUR AS time FROM events WHERE date_trunc('day', ts)::TIMESTAMP + INTERVAL (event_id % 7) HOUR NOT IN (SELECT TIMESTAMP '2024-01-01' + INTERVAL (12 * i) HOUR FROM range(0, 62) r(i))")
def q51_missing_times(spark, sf):
    wanted = b.table(spark, sf, "events").select((F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_interval(hours=F.col("event_id") % 7)).alias("time"))
    have = spark.range(62).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=(F.col("id") * 12).cast("int"))).alias("time"))
    return sampling.missing_times(wanted, have)


@query(f"WITH {_FILES}, p AS (SELECT path, min(time) AS first_time FROM ft GROUP BY path) SELECT path, first_time, row_number() OVER (ORDER BY first_time, substr(path, 2)::INT)::INT AS place FROM p")
def q52_concat_order(spark, sf):
    """Files by their first time; of equal ones in the order given, here that of their numbers."""
    return files.concat_plan(_file_times(spark, sf).withColumn("place", F.substring("path", 2, 9).cast("int")))


@query("SELECT time_bucket(INTERVAL 12 HOUR, ts)::TIMESTAMP AS bin, count(*) AS n, min(ts)::TIMESTAMP AS first_time FROM events GROUP BY 1")
def q53_time_bins(spark, sf):
    """Every event as a file with its first time."""
    first = b.table(spark, sf, "events").select(F.col("event_id").cast("string").alias("path"), F.col("ts").cast("timestamp_ntz").alias("time"))
    return files.time_bins(first, "12 hours").select("bin", F.size("files").cast("long").alias("n"), F.col("files")[0]["time"].alias("first_time"))


@query("SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS bin, count(*) AS n FROM orders GROUP BY bin")
def q53b_day_bins(spark, sf):
    first = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"))
    return files.time_bins(first).select("bin", F.size("files").cast("long").alias("n"))


@query(f"WITH {_FILES} SELECT path, min(time) AS first_time FROM ft GROUP BY path HAVING min(time) BETWEEN TIMESTAMP '1995-01-02' AND TIMESTAMP '1995-01-20'")
def q54_time_range(spark, sf):
    first = _file_times(spark, sf).groupBy("path").agg(F.min("time").alias("time"))
    return files.time_bins(first, "7 days", ("1995-01-02", "1995-01-20")).select(F.explode("files").alias("f")).select("f.path", F.col("f.time").alias("first_time"))


@query("SELECT l_orderkey % 500 AS k, coalesce(max(CASE WHEN l_quantity = 50 THEN l_linenumber END), min(CASE WHEN l_linenumber - 4 >= 0 THEN l_linenumber - 4 END), -1)::INT AS forecast FROM lineitem GROUP BY 1")
def q55_index_forecast(spark, sf):
    l = b.table(spark, sf, "lineitem")
    return l.groupBy((F.col("l_orderkey") % 500).alias("k")).agg(scalars.index_forecast(F.when(F.col("l_quantity") == 50, F.col("l_linenumber")), F.col("l_linenumber") - 4).cast("int").alias("forecast"))


_HOURS = "hrs AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-30 05:00', TIMESTAMP '2024-02-09 13:00', INTERVAL 1 HOUR)) AS t)"


@query(f"WITH {_HOURS} SELECT 'hrrr/' || strftime(t, '%Y/%m/%Y%m%d_') || lpad((hour(t) // 6 * 6)::VARCHAR, 2, '0') || '-' || lpad((hour(t) // 6 * 6 + 5)::VARCHAR, 2, '0') || '_hrrr' AS key, min(t) AS first_time FROM hrs GROUP BY key")
def q56_archive_keys(spark, sf):
    return archive.keys_for_range(spark, "hrrr", "2024-02-09 13:40", "2024-01-30 05:10")


_EVENT_KEYS = """
SELECT 'gdas' AS product, 'gdas1/' || year(ts) || '/gdas1.' || lower(strftime(ts, '%b')) || strftime(ts, '%y') || '.w' || ((day(ts) - 1) // 7 + 1) AS key, min(ts) AS first_time FROM events GROUP BY key
UNION ALL SELECT 'nam', 'nam12/' || strftime(ts, '%Y/%m/%Y%m%d') || '_nam12', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'gfs', 'gfs0p25/' || strftime(ts, '%Y/%m/%Y%m%d') || '_gfs0p25', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'nams_conus', 'nams/' || strftime(ts, '%Y/%m/%Y%m%d') || '_hysplit.t00z.namsa', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'nams_ak', 'nams/' || strftime(ts, '%Y/%m/%Y%m%d') || '_hysplit.t00z.namsa.AK', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'nams_hi', 'nams/' || strftime(ts, '%Y/%m/%Y%m%d') || '_hysplit.t00z.namsa.HI', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'reanalysis', 'reanalysis/' || year(ts) || '/RP' || strftime(ts, '%Y%m') || '.gbl', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'hrrr_v1', 'hrrr.v1/' || strftime(ts, '%Y/%m/') || 'hysplit.' || strftime(ts, '%Y%m%d.%H') || 'z.hrrra', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'gdas0p5', 'gdas0p5/' || strftime(ts, '%Y/%m/%Y%m%d') || '_gdas0p5', min(ts) FROM events GROUP BY 2
UNION ALL SELECT 'narr', 'narr/' || year(ts) || '/NARR' || strftime(ts, '%Y%m'), min(ts) FROM events GROUP BY 2"""


@query(_EVENT_KEYS)
def q57_product_keys(spark, sf):
    """Keys of all products for the events' times, in one scan: each row has its ten keys exploded before one aggregation."""
    names = ["gdas", "nam", "gfs", "nams_conus", "nams_ak", "nams_hi", "reanalysis", "hrrr_v1", "gdas0p5", "narr"]
    pairs = F.array(*[F.struct(F.lit(n).alias("product"), archive.product(n).key(F.col("ts")).alias("key")) for n in names])
    return b.table(spark, sf, "events").select("ts", F.explode(pairs).alias("k")).groupBy("k.product", "k.key").agg(F.min("ts").alias("first_time"))


@query("SELECT DISTINCT 's3://noaa-oar-arl-hysplit-pds/reanalysis/' || year(o_orderdate) || '/RP' || strftime(o_orderdate, '%Y%m') || '.gbl' AS url FROM orders")
def q57b_archive_urls(spark, sf):
    t = b.table(spark, sf, "orders").select(F.col("o_orderdate").alias("t"))
    return archive.keys_of(t, "reanalysis").select(archive.url_of(F.col("key"), "s3").alias("url"))


@query("""WITH f AS (SELECT 'f' || (s_suppkey % 13) AS path, s_suppkey // 26 AS time, s_nationkey % 2 AS g, s_suppkey % 39 // 13 AS s FROM supplier)
SELECT path, 'times' AS problem FROM f GROUP BY path HAVING count(DISTINCT time) < count(*) UNION ALL SELECT path, 'grids' FROM f GROUP BY path HAVING count(DISTINCT g) > 1
UNION ALL SELECT path, 'sources' FROM f GROUP BY path HAVING count(DISTINCT s) > 1""")
def q58_consistency(spark, sf):
    """Suppliers as index records: the rules that each file breaks."""
    k = F.col("s_suppkey")
    index = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("f"), (k % 13).cast("string")).alias("path"),
        F.floor(k / 26).alias("time"),
        F.floor(k % 39 / 13).cast("string").alias("source"),
        F.struct((F.col("s_nationkey") % 2).alias("nx")).alias("grid"),
        F.lit(2).alias("vertical_flag"),
        F.lit(0.0).alias("offset"),
        F.array(F.struct(F.lit(1000.0).alias("height"))).alias("levels"),
    )
    return packed.check_index(index)


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey % 256 AS c FROM lineitem),
n AS (SELECT *, lead(c) OVER w AS nc, lead(i) OVER w AS ni FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY i))
SELECT l_orderkey, i::INT AS seq, 'V' || (i % 3) AS variable, c::INT AS checksum, CASE WHEN ni % 3 = 2 THEN 'DIF2' END AS diff_variable, CASE WHEN ni % 3 = 2 THEN nc::INT END AS diff_checksum, (1000 * l_orderkey + 100 * (i + 1))::BIGINT AS position FROM n WHERE i % 3 <> 2""")
def q59_difference_parents(spark, sf):
    """Orders as index records, their lines as entries, every third a difference: records with what belongs to them."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    rows = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    entry = F.transform("lines", lambda x, i: F.struct(F.when(i % 3 == 2, F.lit("DIF2")).otherwise(F.concat(F.lit("V"), (i % 3).cast("string"))).alias("name"), (x["l_partkey"] % 256).cast("int").alias("checksum"), F.lit("").alias("reserved")))
    levels = F.array(F.struct(F.lit(0).alias("level"), F.lit(0.0).alias("height"), entry.alias("vars")))
    index = rows.select(F.col("l_orderkey").cast("string").alias("path"), F.lit(None).cast("timestamp_ntz").alias("time"), F.lit("TEST").alias("source"), F.lit(0).alias("forecast"), (F.col("l_orderkey") * 1000).cast("long").alias("rs_position"), F.lit(0).alias("rs_ordinal"), F.lit(100).cast("long").alias("record_length"), F.lit(None).cast("struct<nx:int>").alias("grid"), F.lit(2).alias("vertical_flag"), F.lit(0.0).alias("offset"), levels.alias("levels"))
    return packed.records(index).select(F.col("path").cast("long").alias("l_orderkey"), "seq", "variable", "checksum", "diff_variable", "diff_checksum", "position")


@query("SELECT p_partkey, CASE WHEN p_size < 40 THEN 2000 + p_size ELSE 1900 + p_size END::INT AS year, ((p_partkey % 26) + 1)::BIGINT * 1000 AS thousands, chr((65 + p_partkey % 26)::INT) AS letter, p_partkey // 1000 * 1000 AS high, p_partkey % 1000 AS low, 50 + p_partkey * p_size AS record_length FROM part")
def q60_header_scalars(spark, sf):
    p = b.table(spark, sf, "part")
    letter = F.char((65 + F.col("p_partkey") % 26).cast("int"))
    return p.select(
        "p_partkey", scalars.restore_year(F.col("p_size")).alias("year"), scalars.letter_to_thousands(letter).cast("long").alias("thousands"), scalars.thousands_to_letter((F.col("p_partkey") % 26 + 1) * 1000).alias("letter"), scalars.grid_thousands(F.col("p_partkey")).alias("high"), scalars.grid_rest(F.col("p_partkey")).alias("low"), scalars.record_length(F.col("p_partkey"), F.col("p_size")).alias("record_length")
    )


@query("SELECT p_partkey, CASE WHEN p_size < 40 THEN make_timestamp(2000 + p_size, 1 + p_partkey % 12, 1 + p_partkey % 28, p_partkey % 24, p_partkey % 60, 0) ELSE make_timestamp(1900 + p_size, 1 + p_partkey % 12, 1 + p_partkey % 28, p_partkey % 24, p_partkey % 60, 0) END AS time FROM part")
def q60b_header_time(spark, sf):
    k = F.col("p_partkey")
    as_int = lambda c: c.cast("int")
    return b.table(spark, sf, "part").select("p_partkey", scalars.header_time(F.col("p_size"), as_int(1 + k % 12), as_int(1 + k % 28), as_int(k % 24), as_int(k % 60)).alias("time"))


@query("""WITH c AS (SELECT sin(radians(38.5::DOUBLE)) AS n), k AS (SELECT n, 6371.2::DOUBLE * cos(radians(38.5::DOUBLE)) * pow(tan(pi() / 4 + radians(38.5::DOUBLE) / 2), n) / n AS rf FROM c),
o AS (SELECT n, rf, rf / pow(tan(pi() / 4 + radians(38.5::DOUBLE) / 2), n) AS r0, rf / pow(tan(pi() / 4 + radians(30::DOUBLE) / 2), n) AS rs FROM k),
p AS (SELECT event_id AS pid, -130 + (user_id % 300) / 5::DOUBLE AS lon, 25 + (event_id % 200) / 8::DOUBLE AS lat FROM events),
q AS (SELECT pid, rf / pow(tan(pi() / 4 + radians(lat) / 2), n) AS r, radians(lon + 97.5::DOUBLE) * n AS th, rs, radians(-125 + 97.5::DOUBLE) * n AS ts FROM p, o)
SELECT pid, round((r * sin(th) - rs * sin(ts)) / 3, 6) AS x, round((rs * cos(ts) - r * cos(th)) / 3, 6) AS y FROM q""")
def q61_lambert_indices(spark, sf):
    p = b.table(spark, sf, "events").select(F.col("event_id").alias("pid"), (-130 + (F.col("user_id") % 300) / 5.0).alias("lon"), (25 + (F.col("event_id") % 200) / 8.0).alias("lat"))
    x, y = b.LAMBERT.fractional_indices(F.col("lon"), F.col("lat"))
    return p.select("pid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _axis_sql() -> str:
    """Pressures of all axes in one pass: null on the terrain-following one."""
    parts = []
    for flag in b.AXES:
        s = stored_sql(flag, "lev")
        p = {1: f"prss * {s}", 2: s, 3: "NULL", 4: f"CASE WHEN lev = 0 THEN prss ELSE floor({s}) + prss * ({s} - floor({s})) END"}[flag]
        parts.append(f"SELECT {flag} AS flag, t, lev, y, x, ({p})::DOUBLE AS p FROM w")
    return with_view(" UNION ALL ".join(parts))


@query(_axis_sql())
def q62_axis_dispatch(spark, sf):
    w = b.wide(spark, sf).select("t", "lev", "y", "x", "prss", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), vertical.stored_level(h, F.col("lev")).alias("stored")) for f, h in b.AXES.items()])).alias("a"))
    return w.select("a.flag", "t", "lev", "y", "x", vertical.level_pressure(F.col("a.flag"), F.col("a.stored"), F.col("lev"), F.col("prss")).alias("p"))


@query("SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice = 0 THEN ' 0.0000000E+00' ELSE lpad(printf('%.7f', p_retailprice / pow(10::DOUBLE, floor(log10(p_retailprice)) + 1)), 10, ' ') || 'E+' || lpad((floor(log10(p_retailprice)) + 1)::INT::VARCHAR, 2, '0') END AS text FROM part")
def q63_scientific_text(spark, sf):
    return b.table(spark, sf, "part").select("p_partkey", "p_retailprice", scalars.scientific(F.col("p_retailprice")).alias("text"))


def _polar_sql() -> str:
    """Fractional indices on a polar, an oblique stereographic and a Mercator grid, closed forms on the sphere."""
    r = "6371.2::DOUBLE"
    lam = lambda lon, lon0: f"radians(({lon} - ({lon0}) + 540) % 360 - 180)"
    polar = lambda lon, lat: (f"{r} * (1 + sin(radians(60::DOUBLE))) * tan(pi() / 4 - radians({lat}) / 2) * sin({lam(lon, -105)})", f"-{r} * (1 + sin(radians(60::DOUBLE))) * tan(pi() / 4 - radians({lat}) / 2) * cos({lam(lon, -105)})")
    k = lambda lon, lat: f"(2 * {r} / (1 + sin(radians({lat})) * sin(radians(40::DOUBLE)) + cos(radians({lat})) * cos({lam(lon, -100)}) * cos(radians(40::DOUBLE))))"
    oblique = lambda lon, lat: (f"{k(lon, lat)} * cos(radians({lat})) * sin({lam(lon, -100)})", f"{k(lon, lat)} * (sin(radians({lat})) * cos(radians(40::DOUBLE)) - cos(radians({lat})) * cos({lam(lon, -100)}) * sin(radians(40::DOUBLE)))")
    merc = lambda lon, lat: (f"{r} * cos(radians(20::DOUBLE)) * {lam(lon, -90)}", f"{r} * cos(radians(20::DOUBLE)) * ln(tan(pi() / 4 + radians({lat}) / 2))")
    parts = []
    for kind, f in (("stere", polar), ("sterea", oblique), ("merc", merc)):
        (x, y), (sx, sy) = f("lon", "lat"), f("-125::DOUBLE", "22::DOUBLE")
        parts.append(f"SELECT '{kind}' AS kind, pid, round(({x} - ({sx})) / 12 + 1, 6) AS x, round(({y} - ({sy})) / 12 + 2, 6) AS y FROM p")
    return "WITH p AS (SELECT event_id AS pid, -130 + (user_id % 300) / 5::DOUBLE AS lon, 25 + (event_id % 200) / 8::DOUBLE AS lat FROM events) " + " UNION ALL ".join(parts)


@query(_polar_sql())
def q61b_projected_indices(spark, sf):
    from gridloom.functions.projection import Grid, Projection

    p = b.table(spark, sf, "events").select(F.col("event_id").alias("pid"), (-130 + (F.col("user_id") % 300) / 5.0).alias("lon"), (25 + (F.col("event_id") % 200) / 8.0).alias("lat"))
    grids = {"stere": (90, 0, 60, -105, 12, 0, 90), "sterea": (40, -100, 40, -100, 12, 0, 90), "merc": (0, -90, 20, -90, 12, 0, 0)}
    rows = []
    for kind, numbers in grids.items():
        grid = Grid(Projection(*map(float, numbers), 2.0, 3.0, 22.0, -125.0), 500, 400)
        assert grid.projection.kind == kind
        rows.append(F.struct(F.lit(kind).alias("kind"), *[F.round(v, 6).alias(n) for n, v in zip("xy", grid.fractional_indices(F.col("lon"), F.col("lat")), strict=True)]))
    return p.select("pid", F.explode(F.array(*rows)).alias("g")).select("g.kind", "pid", "g.x", "g.y")


def _hypso_sample_sql(flag: int, kind: str) -> str:
    """Samples on hypsometric heights of the points' own profiles."""
    p = {1: f"ps * {stored_sql(1, 'level')}", 4: f"CASE WHEN level = 0 THEN ps ELSE floor({stored_sql(4, 'level')}) + ps * ({stored_sql(4, 'level')} - floor({stored_sql(4, 'level')})) END"}[flag]
    return with_view(
        "SELECT p.pid, round(v.value::FLOAT::DOUBLE, 3) AS TEMP FROM pts p LEFT JOIN val v ON v.pid = p.pid",
        b.points_sql(kind),
        "aux AS (SELECT pid, max(value) FILTER (variable = 'PRSS') AS ps, max(value) FILTER (variable = 'SHGT') AS ts FROM prof GROUP BY pid)",
        f"lp AS (SELECT pid, level, value, ts, ps, {p} AS p FROM prof JOIN aux USING (pid) WHERE variable = 'TEMP')",
        "ld AS (SELECT *, CASE WHEN level = 0 THEN value * (287.05::DOUBLE / 9.80665::DOUBLE) * ln(ps / p) ELSE (lag(value) OVER c + value) / 2 * (287.05::DOUBLE / 9.80665::DOUBLE) * ln(lag(p) OVER c / p) END AS dz FROM lp WINDOW c AS (PARTITION BY pid ORDER BY level))",
        f"rows AS (SELECT pid, 'TEMP' AS variable, level, sum(dz) OVER (PARTITION BY pid ORDER BY level) {'+ ts' if kind == 'msl' else ''} AS coord, value FROM ld)",
        b.BRACKET_SQL,
    )


@query(_hypso_sample_sql(1, "agl"))
def q43_agl_sigma_axis(spark, sf):
    return _sampled(spark, sf, 1, "agl", ["TEMP"], 3)


@query(_hypso_sample_sql(1, "msl"))
def q43b_msl_sigma_axis(spark, sf):
    return _sampled(spark, sf, 1, "msl", ["TEMP"], 3)


@query(_hypso_sample_sql(4, "agl"))
def q44_agl_hybrid_axis(spark, sf):
    return _sampled(spark, sf, 4, "agl", ["TEMP"], 3)


@query(_hypso_sample_sql(4, "msl"))
def q44b_msl_hybrid_axis(spark, sf):
    return _sampled(spark, sf, 4, "msl", ["TEMP"], 3)


# --- packed files --------------------------------------------------------------------------------------------------------
# Each query writes the view as packed files (once a session) and goes through the file operators.

def _paths(spark, sf) -> list[str]:
    return packed.list_files(b.packed_folder(spark, sf))


def _read(spark, path, **filters) -> DataFrame:
    """Cells of packed files, the year for the time, values to the view's grain."""
    got = files.open_cells(spark, path, **filters)
    return got.select(F.year("time").alias("time"), "level", "variable", "y", "x", b.snapped(F.col("value")).alias("value"))


@query(with_view("SELECT * FROM cells"))
def q70_packed_file_round_trip(spark, sf):
    """The view written to packed files, read back and decoded."""
    return _read(spark, b.packed_folder(spark, sf))


@query("SELECT (1996 + i)::INT AS time, 'VIEW' AS source, ((1996 + i) % 3)::INT AS forecast, 20 AS nx, 20 AS ny, 2 AS vertical_flag, 4 AS nz, 450::BIGINT AS record_length, (6750 * i)::BIGINT AS rs_position, i::INT AS rs_ordinal, 20250::BIGINT AS file_size, 14::BIGINT AS entries, (20 + 0)::DOUBLE AS sync_lon FROM range(0, 3) r(i)")
def q71_index_scan(spark, sf):
    """The catalogue of a file of three times: joined from three files given in the wrong order."""
    joined = files.concat(spark, _paths(spark, sf)[::-1], shared_path(spark, "joined"))
    entries = F.aggregate("levels", F.lit(0).cast("long"), lambda a, v: a + F.size(v["vars"]))
    return packed.read_index(spark, joined).select(F.year("time").alias("time"), "source", "forecast", "grid.nx", "grid.ny", "vertical_flag", "nz", "record_length", "rs_position", "rs_ordinal", "file_size", entries.alias("entries"), "grid.sync_lon")


@query(with_view(f"SELECT e.time, e.level, {stored_sql(2, 'e.level')} AS height, e.variable, e.e::INT AS seq, (450 * (e.e + 1))::BIGINT AS position, CASE WHEN e.variable = 'TEMP' THEN 'DIFT' END AS diff_variable FROM entry e WHERE e.variable <> 'DIFT'", _RECORDS))
def q72_records(spark, sf):
    recs = packed.records(packed.read_index(spark, b.packed_folder(spark, sf)))
    return recs.select(F.year("time").alias("time"), "level", "height", "variable", "seq", "position", "diff_variable")


@query(with_view("SELECT f.time, f.level, f.variable, CASE WHEN f.level = 0 THEN -1 ELSE 3 * (f.level - 1) + f.time % 3 END::INT AS forecast, (trunc(p) + CASE WHEN p >= 0 OR p = trunc(p) THEN 1 ELSE 0 END)::INT AS exponent, first AS initial_value FROM f", """
st AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY time, level, variable, y ORDER BY x)) AS a, CASE WHEN x = 0 THEN abs(value - lag(value) OVER (PARTITION BY time, level, variable, x ORDER BY y)) END AS d FROM cells WHERE variable <> 'TEMP'),
f AS (SELECT time, level, variable, CASE WHEN greatest(max(a), max(d)) > 0 THEN ln(greatest(max(a), max(d))) / ln(2::DOUBLE) ELSE 0 END AS p, max(value) FILTER (x = 0 AND y = 0) AS first FROM st GROUP BY time, level, variable)"""))
def q73_record_headers(spark, sf):
    """Forecast, exponent and first value in the headers of records."""
    recs = fo.select_records(packed.records(packed.read_index(spark, b.packed_folder(spark, sf))), drop=["TEMP"])
    return packed.with_payload(recs).select(F.year("time").alias("time"), "level", "variable", "forecast", "exponent", "initial_value")


@query(with_view("SELECT * FROM cells WHERE variable IN ('HGTS', 'PRSS') AND level IN (0, 2) AND x >= 3 AND x < 11 AND y >= 2 AND y < 15"))
def q75_open_cells(spark, sf):
    return _read(spark, b.packed_folder(spark, sf), variables=["HGTS", "PRSS"], levels=[0, 2], bbox=_BOXES[0])


@query(with_view(f"SELECT t AS time, (t % 3)::INT AS forecast_hour, lev AS level, {stored_sql(2, 'lev')} AS pressure, y, x, hgts AS HGTS, temp::DOUBLE AS TEMP FROM w WHERE lev > 0"))
def q76_open_dataset_upper(spark, sf):
    upper = datasets.open_dataset(spark, b.packed_folder(spark, sf))[0]
    assert upper.columns == ["time", "level", "y", "x", "forecast_hour", "HGTS", "TEMP", "pressure"]
    return upper.select(F.year("time").alias("time"), "forecast_hour", "level", "pressure", "y", "x", F.col("HGTS").cast("double").alias("HGTS"), b.snapped(F.col("TEMP")).alias("TEMP"))


@query(with_view("SELECT t AS time, (t % 3)::INT AS forecast_hour, y - 2 AS y, x - 3 AS x, prss AS PRSS FROM w WHERE lev = 0 AND x >= 3 AND x < 11 AND y >= 2 AND y < 15"))
def q77_open_dataset_surface(spark, sf):
    surface = datasets.open_dataset(spark, b.packed_folder(spark, sf), drop_variables="SHGT", bbox=_BOXES[0])[1]
    assert datasets.grid_of(surface).nx == 8 and datasets.source_of(surface) == "VIEW" and datasets.axis_of(surface).heights == b.AXES[2]
    return surface.select(F.year("time").alias("time"), "forecast_hour", "y", "x", F.col("PRSS").cast("double").alias("PRSS"))


@query(with_view("SELECT time, (dense_rank() OVER (ORDER BY level) - 1)::INT AS level, variable, y - 2 AS y, x - 3 AS x, value FROM cells WHERE variable IN ('TEMP', 'HGTS') AND level IN (1, 3) AND x >= 3 AND x < 16 AND y >= 2 AND y < 18 AND time = 1997"))
def q78_extract_subset_file(spark, sf):
    """A box, two levels and two variables of a file as a file of its own, read back."""
    out = files.extract_subset(spark, _paths(spark, sf)[1], shared_path(spark, "subset"), (22.5, -8.0, 35.0, 7.5), [1, 3], ["TEMP", "HGTS"])
    return _read(spark, out)


@query("SELECT (1998 - i)::INT AS time, i::INT AS rs_ordinal, (6750 * i)::BIGINT AS rs_position FROM range(0, 3) r(i)")
def q79_concat_as_given(spark, sf):
    joined = files.concat(spark, _paths(spark, sf)[::-1], shared_path(spark, "given"), sort=False)
    return packed.read_index(spark, joined).select(F.year("time").alias("time"), "rs_ordinal", "rs_position")


@query("WITH t AS (SELECT make_timestamp(1996 + i, 1, 1, 0, 0, 0) AS time FROM range(0, 3) r(i)), f AS (SELECT time, time_bucket(INTERVAL 730 DAY, time, TIMESTAMP '1970-01-01') AS bin FROM t) SELECT strftime(bin, '%Y%m%d') AS file, year(time)::INT AS time, (row_number() OVER (PARTITION BY bin ORDER BY time) - 1)::INT AS rs_ordinal FROM f")
def q80_concat_by_time(spark, sf):
    """Files joined in bins of two years of 365 days, named after the bins."""
    made = files.concat_by_time(spark, b.packed_folder(spark, sf), shared_path(spark, "bins"), "730 days")
    return packed.read_index(spark, made).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.year("time").alias("time"), "rs_ordinal")


def _file_points(spark, sf, kind="pressure"):
    return b.points(spark, sf, kind).withColumn("time", b.start_of(F.col("time")))


@query(_interp("pressure", stored_sql(2, "p.level"), "'HGTS'", "HGTS"))
def q81_sample_files(spark, sf):
    """Points sampled from three files, each point's time picking its file."""
    return files.sample_files(spark, b.packed_folder(spark, sf), _file_points(spark, sf), "HGTS").select("pid", "HGTS")


@query(with_view("SELECT f.pid, k.value::FLOAT AS PRSS FROM fx f LEFT JOIN cells k ON k.variable = 'PRSS' AND k.time = f.time AND k.x = round_even(fx, 0) AND k.y = round_even(fy, 0) AND fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19", b.points_sql()))
def q82_sample_files_nearest(spark, sf):
    return files.sample_files(spark, b.packed_folder(spark, sf), _file_points(spark, sf), ["PRSS"], method="nearest").select("pid", "PRSS")


@query(_interp("agl", "greatest(hg - ts, 0)", "'HGTS'", "HGTS").replace("(1996 + event_id % 3)::INT AS time", "1997 AS time"))
def q83_sample_files_of_one_time(spark, sf):
    """Points without a time, sampled from a file that has one only."""
    return files.sample_files(spark, _paths(spark, sf)[1], _file_points(spark, sf, "agl").drop("time"), ["HGTS"], z_kind="agl").select("pid", "HGTS")


@query(with_view("SELECT time, level, variable, y, x, value, (time % 3)::INT AS forecast FROM cells WHERE level > 0 OR variable IN ('PRSS', 'SHGT')"))
def q85_write_dataset(spark, sf):
    """A dataset opened from packed files, written as one file with differences of TEMP, and read back."""
    upper, surface = datasets.open_dataset(spark, b.packed_folder(spark, sf))
    upper = upper.withColumn("TEMP", b.snapped(F.col("TEMP")).cast("float")).withMetadata("TEMP", {"diff": "DIFT"})
    out = datasets.write_dataset(upper, surface, shared_path(spark, "written"))
    cells = fo.cells(fo.decode(packed.with_payload(packed.records(packed.read_index(spark, out)))))
    return cells.select(F.year("time").alias("time"), "level", "variable", "y", "x", b.snapped(F.col("value")).alias("value"), "forecast")


@query("SELECT * FROM (VALUES ('last', 1998), ('first', 1996), ('named', 1997)) v(key, time)")
def q86_recordset_by_key(spark, sf):
    """Recordsets by ordinal, from either end, and by time."""
    index = packed.read_index(spark, files.concat(spark, _paths(spark, sf), shared_path(spark, "keyed")))
    assert packed.contains(index, "1997-01-01") and not packed.contains(index, "1997-01-02") and not packed.contains(index, "no time")
    assert packed.contains(index, "1997-01-01", 0, "PRSS") and not packed.contains(index, "1997-01-01", 1, "PRSS")
    rows = [packed.recordset(index, key).select(F.lit(name).alias("key"), F.year("time").alias("time")) for name, key in (("last", -1), ("first", 0), ("named", "1997-01-01 00:00"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(with_view("SELECT time, level, y, x, value FROM cells WHERE variable = 'TEMP' AND level BETWEEN 1 AND 2 AND y IN (0, 19, 4) AND x % 3 = 0"))
def q87_index_by_position(spark, sf):
    """Slices, numbers from the end and lists along the dimensions."""
    rows = b.cells(spark, sf).where("variable = 'TEMP'")
    rows = rows.where(datasets.level_subset("level", slice(1, 3), b.LEVELS)).where(datasets.level_subset("y", [0, -1, 4], b.NY)).where(datasets.level_subset("x", slice(None, None, 3), b.NX))
    return rows.select("time", "level", "y", "x", "value")
