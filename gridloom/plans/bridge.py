"""A deterministic gridded view over the star-schema tables, so that every operator can be held against SQL.

20 x 20 cells, 4 levels, 3 times, from one aggregation of lineitem; values are dyadic rationals, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.projection import Grid, Projection

NX = NY = 20
LEVELS = 4
TIMES = (1996, 1997, 1998)
GRID = Grid(Projection(90, 0, 1, 1, 0, 0, 0, 1, 1, -10, 20), NX, NY)
AXES = {1: [1.0, 0.9, 0.8, 0.7], 2: [1000.0, 900.0, 800.0, 700.0], 3: [0.0, 100.0, 500.0, 1500.0], 4: [0.995, 0.9, 0.8, 0.7]}
LAMBERT = Grid(Projection(38.5, -97.5, 38.5, -97.5, 3.0, 0, 38.5, 1, 1, 30, -125), 800, 600)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, lev, y, x, n, q) for every cell; the time filter is a range on l_shipdate, which reaches the scan."""
    l = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")))
    key = [F.year("l_shipdate").alias("t"), (F.col("l_linenumber") % LEVELS).alias("lev"), (F.col("l_suppkey") % NY).cast("int").alias("y"), (F.col("l_partkey") % NX).cast("int").alias("x")]
    base = l.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), (F.sum("l_quantity") / F.count(F.lit(1))).alias("q"))
    i = F.col("id")
    per = LEVELS * NY * NX
    spine = spark.range(len(TIMES) * per).select((F.floor(i / per) + TIMES[0]).cast("int").alias("t"), (F.floor(i / (NY * NX)) % LEVELS).cast("int").alias("lev"), (F.floor(i / NX) % NY).cast("int").alias("y"), (i % NX).cast("int").alias("x"))
    return spine.join(base, ["t", "lev", "y", "x"], "left").select("t", "lev", "y", "x", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.lit(0.0)).alias("q"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, lev, y, x, n, q, temp, hgts, prss, shgt); prss and shgt, of level 0, on every row of a column."""
    from pyspark.sql import Window

    g = counts(spark, sf_dir)
    ground = F.max(F.when(F.col("lev") == 0, F.col("n"))).over(Window.partitionBy("t", "y", "x"))
    g = g.withColumn("n0", ground)
    return g.select("t", "lev", "y", "x", "n", "q", (280 + F.floor(64 * F.col("q")) / 64.0).alias("temp"), (100.0 + F.col("n0") % 32 + 1000.0 * F.col("lev") + F.col("n") % 8).alias("hgts"), (1000.0 + F.col("n0") % 16).alias("prss"), (100.0 + F.col("n0") % 32).alias("shgt"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, level, variable, y, x, value) with TEMP and HGTS on all levels, PRSS and SHGT on level 0."""
    w = wide(spark, sf_dir)
    v = lambda name, col: F.struct(F.lit(name).alias("variable"), F.col(col).cast("double").alias("value"))
    upper, all_ = F.array(v("TEMP", "temp"), v("HGTS", "hgts")), F.array(v("TEMP", "temp"), v("HGTS", "hgts"), v("PRSS", "prss"), v("SHGT", "shgt"))
    rows = w.select("t", "lev", "y", "x", F.explode(F.when(F.col("lev") == 0, all_).otherwise(upper)).alias("v"))
    return rows.select(F.col("t").alias("time"), F.col("lev").alias("level"), "v.variable", "y", "x", "v.value")


Z = {"pressure": "700.0 + floor(value) % 300", "native": "(event_id % 25) / 8.0", "agl": "floor(value) * 4.0", "msl": "100.0 + floor(value) * 4.0"}


def points(spark: SparkSession, sf_dir: str, kind: str = "pressure") -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pid"), (20 + (F.col("user_id") % 160) / 8.0).alias("lon"), (-10 + (F.col("event_id") % 160) / 8.0).alias("lat"), (1996 + F.col("event_id") % 3).cast("int").alias("time"), F.expr(Z[kind]).cast("double").alias("z")
    )


_WRITTEN: dict[tuple[str, str], str] = {}


def packed_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the view as packed files, one a time (view_1996 and so on), on the pressure axis; written once a session.

    All but TEMP are packed without loss; TEMP has differences, and is right to a 1/64 but for its first value's seven digits.
    Records at level 0 have no forecast, others a multiple of 3 hours and the year's rest.
    """
    from gridloom.operators import fields as fo
    from gridloom.sources import packed
    from gridloom.sources.stores import shared_path

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        folder = shared_path(spark, "packed-view")
        order = F.when(F.col("variable") == "TEMP", 0).when(F.col("variable") == "HGTS", 1).when(F.col("variable") == "PRSS", 2).otherwise(3)
        rows = cells(spark, sf_dir).select(F.col("time").alias("year"), "level", "variable", "y", "x", "value")
        fields = fo.field_bytes(rows, NX, ["year", "level", "variable"], ny=NY)
        forecast = F.when(F.col("level") == 0, F.lit(-1)).otherwise(3 * (F.col("level") - 1) + F.col("year") % 3)
        fields = fields.select(F.concat(F.lit("view_"), F.col("year").cast("string")).alias("file"), start_of(F.col("year")).alias("time"), "level", order.alias("seq"), "variable", forecast.alias("forecast"), "data", F.when(F.col("variable") == "TEMP", F.lit("DIFT")).alias("diff_variable"))
        packed.write_packed(fields, folder, GRID, AXES[2], 2, "VIEW")
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def start_of(year):
    return F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def snapped(value):
    """A value to the nearest 1/64, the grain of the view."""
    return F.round(value.cast("double") * 64) / 64


#: The same view in SQL, as leading common table expressions.
SQL = """
base AS (SELECT year(l_shipdate)::INT AS t, (l_linenumber % 4)::INT AS lev, (l_suppkey % 20)::INT AS y, (l_partkey % 20)::INT AS x, count(*) AS n, sum(l_quantity)::DOUBLE / count(*) AS q
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL),
spine AS (SELECT t::INT AS t, lev::INT AS lev, y::INT AS y, x::INT AS x FROM range(1996, 1999) a(t), range(0, 4) b(lev), range(0, 20) c(y), range(0, 20) d(x)),
g AS (SELECT t, lev, y, x, coalesce(n, 0)::BIGINT AS n, coalesce(q, 0)::DOUBLE AS q FROM spine LEFT JOIN base USING (t, lev, y, x)),
w AS (SELECT g.t, g.lev, g.y, g.x, g.n, g.q, 280 + floor(64 * g.q)::DOUBLE / 64::DOUBLE AS temp, 100::DOUBLE + z.n % 32 + 1000::DOUBLE * g.lev + g.n % 8 AS hgts, 1000::DOUBLE + z.n % 16 AS prss, 100::DOUBLE + z.n % 32 AS shgt
  FROM g JOIN g z ON z.lev = 0 AND z.t = g.t AND z.y = g.y AND z.x = g.x),
cells AS (SELECT t AS time, lev AS level, 'TEMP' AS variable, y, x, temp::DOUBLE AS value FROM w UNION ALL SELECT t, lev, 'HGTS', y, x, hgts FROM w
  UNION ALL SELECT t, lev, 'PRSS', y, x, prss FROM w WHERE lev = 0 UNION ALL SELECT t, lev, 'SHGT', y, x, shgt FROM w WHERE lev = 0)"""
_Z_SQL = {"pressure": "700 + floor(value)::DOUBLE % 300", "native": "(event_id % 25) / 8::DOUBLE", "agl": "floor(value)::DOUBLE * 4", "msl": "100 + floor(value)::DOUBLE * 4"}


def points_sql(kind: str = "pressure") -> str:
    return f"""
pts AS (SELECT event_id AS pid, 20 + (user_id % 160) / 8::DOUBLE AS lon, -10 + (event_id % 160) / 8::DOUBLE AS lat, (1996 + event_id % 3)::INT AS time, ({_Z_SQL[kind]})::DOUBLE AS z FROM events),
fx AS (SELECT *, lon - 20 AS fx, lat + 10 AS fy FROM pts),
plan AS (SELECT *, floor(fx)::INT AS x0, floor(fy)::INT AS y0, least(floor(fx)::INT + 1, 19) AS x1, least(floor(fy)::INT + 1, 19) AS y1, fx - floor(fx) AS wx, fy - floor(fy) AS wy FROM fx WHERE fx BETWEEN 0 AND 19 AND fy BETWEEN 0 AND 19),
corner AS (SELECT pid, time, x0 AS x, y0 AS y, (1 - wx) * (1 - wy) AS wt FROM plan UNION ALL SELECT pid, time, x1, y0, wx * (1 - wy) FROM plan UNION ALL SELECT pid, time, x0, y1, (1 - wx) * wy FROM plan UNION ALL SELECT pid, time, x1, y1, wx * wy FROM plan),
prof AS (SELECT c.pid, k.variable, k.level, sum(c.wt * k.value) AS value FROM corner c JOIN cells k ON k.time = c.time AND k.y = c.y AND k.x = c.x WHERE c.wt <> 0 GROUP BY ALL)"""


#: Bracket interpolation of `rows` (pid, variable, level, coord, value) at the points' z.
BRACKET_SQL = """
br AS (SELECT r.pid, r.variable, p.z, max(coord) FILTER (coord <= p.z) AS lc, arg_max(value, coord) FILTER (coord <= p.z) AS lv, min(coord) FILTER (coord >= p.z) AS hc, arg_min(value, coord) FILTER (coord >= p.z) AS hv, count(coord) AS n
  FROM rows r JOIN pts p USING (pid) WHERE coord IS NOT NULL AND value IS NOT NULL GROUP BY r.pid, r.variable, p.z),
val AS (SELECT pid, variable, CASE WHEN n >= 2 AND lc IS NOT NULL AND hc IS NOT NULL THEN CASE WHEN hc = lc THEN lv ELSE lv + (z - lc) / (hc - lc) * (hv - lv) END END AS value FROM br)"""
