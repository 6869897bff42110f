"""Packed files: codec, text layout, reading, writing, subsets, joins and sampling against closed forms."""

import datetime
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import packing
from gridloom.functions.projection import Grid, Projection, Window
from gridloom.functions.textcodec import Header, Index, fixed, restore_year, scientific, to_letter, to_thousands
from gridloom.operators import fields as fo
from gridloom.operators import datasets, files, sampling
from gridloom.sources import archive, packed

GRID = Grid(Projection(90, 0, 1, 1, 0, 0, 0, 1, 1, -10, 20), 20, 20)
T0 = datetime.datetime(2024, 7, 18)
YY, XX = np.mgrid[0:20, 0:20].astype(np.float32)
BASE = 10 * YY + XX


def write(spark, folder, rows, heights, flag=2, grid=GRID, offset=0.0):
    """rows: (file, time, level, variable, forecast, field, diff name)."""
    data = [(f, t, lv, i, v, fc, np.asarray(a, "<f4").tobytes(), d) for i, (f, t, lv, v, fc, a, d) in enumerate(rows)]
    packed.write_packed(spark.createDataFrame(data, packed.FIELD_INPUT), str(folder), grid, heights, flag, "TEST", offset)
    return os.path.join(str(folder), rows[0][0])


def read_fields(spark, path, **kw):
    cells = files.open_cells(spark, path, **kw).collect()
    out = {}
    for c in cells:
        out.setdefault((c.time, c.level, c.variable), {})[(c.y, c.x)] = c.value
    return out


def test_golden_header_and_checksum():
    h = Header(T0, 6, 3, (0, 0), "TEMP", 7, 0.503937, 1011.406)
    raw = b"24 718 0 6 399TEMP   7 0.5039370E+00 0.1011406E+04"
    assert h.dump() == raw and Header.parse(raw).dump() == raw
    assert packing.checksum(bytes([255, 1, 255])) == 1 and packing.checksum(bytes(9)) == 0


def test_text_scalars():
    assert [to_thousands(c) for c in "ABZa1 "] == [1000, 2000, 26000, 0, 0, 0]
    assert [to_letter(v) for v in (0, 1000, 26000)] == ["9", "A", "Z"]
    assert [restore_year(y) for y in (0, 39, 40, 99, 2024)] == [2000, 2039, 1940, 1999, 2024]
    assert [fixed(v, 7) for v in (0, 90, -0.5, 38.5, 123456.0)] == [".000000", "90.0000", "-.50000", "38.5000", "123456."[:6].rjust(7)]
    assert scientific(-0.00123) == "-0.1230000E-02" and len(scientific(0)) == 14


@pytest.mark.parametrize("shape", [(1, 1), (3, 4), (1, 9), (9, 1), (20, 20), (60, 60)])
def test_codec_round_trip_and_windows(shape):
    rnd = np.random.default_rng(1)
    field = rnd.normal(100, 50, shape).astype(np.float32)
    p = packing.pack(field)
    ny, nx = shape
    back = packing.unpack(p.payload, nx, ny, p.precision, p.exponent, p.initial)
    # values near zero are zeroed before coding and after decoding: twice the precision at most
    assert np.abs(back - field).max() <= 2 * p.precision and p.payload[0] == 127
    for w in ((0, nx, 0, ny), (nx // 2, nx, ny // 3, ny)):
        assert (packing.unpack(p.payload, nx, ny, p.precision, p.exponent, p.initial, w) == back[w[2] : w[3], w[0] : w[1]]).all()
    flat = packing.pack(np.full(shape, 42, np.float32))
    assert {*flat.payload} == {127}


def test_codec_matches_a_cell_by_cell_encoder():
    rnd = np.random.default_rng(7)
    field = np.cumsum(rnd.normal(0, 3, (7, 9)), axis=1).astype(np.float32)
    p = packing.pack(field)
    v = np.where(np.abs(field) < p.precision, 0, field).astype(float)
    scale, out, left = 2.0 ** (7 - p.exponent), [], float(v[0, 0])
    for y in range(7):
        now = left
        for x in range(9):
            code = int((v[y, x] - now) * scale + 127.5)
            out.append(code)
            now += (code - 127) / scale
            if x == 0:
                left = now
    assert bytes(out) == p.payload


def test_errors_of_the_codec():
    with pytest.raises(ValueError):
        packing.unpack(b"123", 2, 2, 0.1, 1, 0)
    with pytest.raises(ValueError):
        packing.unpack(b"1234", 2, 2, 0.1, 1, 0, (0, 3, 0, 1))


@pytest.fixture(scope="module")
def sampled(spark, tmp_path_factory):
    """Two times, pressure axis, with a difference record."""
    rows = []
    for k, t in enumerate((T0, T0 + datetime.timedelta(hours=3))):
        rows += [("met", t, 0, "PRSS", 3 * k, 1000 + 2 * YY + XX + k, None), ("met", t, 0, "SHGT", 3 * k, 100 + BASE, None)]
        for lv in range(3):
            rows += [("met", t, lv, "TEMP", 3 * k, 280 + 10 * lv + BASE + 20 * k, "DIFT" if lv == 1 else None), ("met", t, lv, "HGTS", 3 * k, 100 + BASE + 1000 * lv, None)]
    return write(spark, tmp_path_factory.mktemp("met"), rows, [1000, 900, 800])


def test_file_round_trip(spark, sampled):
    index = packed.read_index(spark, sampled)
    rows = index.orderBy("time").collect()
    assert [r.time for r in rows] == [T0, T0 + datetime.timedelta(hours=3)] and [r.forecast for r in rows] == [0, 3]
    assert rows[0].source == "TEST" and rows[0].record_length == 450 and rows[0].file_size == 2 * 450 * 10
    assert packed.check_index(index).count() == 0
    loaded = packed.with_payload(packed.records(index))
    assert packed.verify_checksums(loaded).where("NOT checksum_ok").count() == 0
    assert {(r.level, r.diff_variable) for r in loaded.where("variable = 'TEMP'").collect()} == {(0, None), (1, "DIFT"), (2, None)}
    got = read_fields(spark, sampled)
    assert len(got) == 16
    t1 = got[(T0, 1, "TEMP")]
    assert max(abs(t1[(y, x)] - (290 + 10 * y + x)) for y in range(20) for x in range(20)) < 0.01
    first = packed.read_index(spark, sampled, first_only=True).collect()
    assert [r.time for r in first] == [T0]


def test_copy_is_byte_identical(spark, sampled, tmp_path):
    data = fo.decode(packed.with_payload(packed.records(packed.read_index(spark, sampled)))).collect()
    rows = [("copy", r.time, r.level, r.variable, r.forecast, np.array(r.field), r.diff_variable) for r in sorted(data, key=lambda r: (r.time, r.seq))]
    a = write(spark, tmp_path, rows, [1000, 900, 800])
    data = fo.decode(packed.with_payload(packed.records(packed.read_index(spark, a)))).collect()
    rows = [("copy2", *r[1:]) for r in [(None, r.time, r.level, r.variable, r.forecast, np.array(r.field), r.diff_variable) for r in sorted(data, key=lambda r: (r.time, r.seq))]]
    b = write(spark, tmp_path, rows, [1000, 900, 800])
    x, y = open(a, "rb").read(), open(b, "rb").read()
    assert len(x) == len(y) == os.path.getsize(sampled)
    head = Index.parse(x)
    assert head.dump()[:50] == x[:50]


def test_filters_windows_and_dataset(spark, sampled):
    got = read_fields(spark, sampled, variables=["TEMP"], levels=[2], bbox=(22, -8, 25, -5))
    assert {*got} == {(T0, 2, "TEMP"), (T0 + datetime.timedelta(hours=3), 2, "TEMP")}
    assert {*got[(T0, 2, "TEMP")]} == {(y, x) for y in range(2, 6) for x in range(2, 6)}
    upper, surface = datasets.open_dataset(spark, sampled, drop_variables=["HGTS"])
    assert {*upper.columns} >= {"TEMP"} and "HGTS" not in upper.columns
    assert upper.count() == 2 * 2 * 400 and surface.count() == 2 * 400
    for bad in ([], [3], [-1]):
        with pytest.raises(ValueError):
            fo.normalise_levels(3, bad)


def test_subset_crops_and_compacts(spark, sampled, tmp_path):
    dest = files.extract_subset(spark, sampled, str(tmp_path / "sub"), bbox=(22, -8, 37, 7), levels=[1, 2], variables="TEMP")
    index = packed.read_index(spark, dest)
    grid, heights, *_ = files.file_info(index)
    assert (grid.nx, grid.ny, heights) == (16, 16, [900, 800])
    assert (grid.projection.sync_lon, grid.projection.sync_lat, grid.projection.sync_x) == (22, -8, 1)
    got = read_fields(spark, dest)
    assert {k[1:] for k in got} == {(0, "TEMP"), (1, "TEMP")}
    assert abs(got[(T0, 0, "TEMP")][(3, 4)] - (290 + 10 * 5 + 6)) < 0.01
    assert packed.records(index).where("diff_variable = 'DIFT' AND level = 0").count() == 2
    with pytest.raises(ValueError, match="record length"):
        files.extract_subset(spark, sampled, str(tmp_path / "small"), bbox=(22, -8, 24, -6))


def test_concat_and_bins(spark, tmp_path):
    paths = []
    for k in (3, 0, 6, 30):
        t = T0 + datetime.timedelta(hours=k)
        paths.append(write(spark, tmp_path / "in", [(f"f{k:02d}", t, 0, "PRSS", 0, 1000 + BASE + k, None), (f"f{k:02d}", t, 1, "TEMP", 0, 280 + BASE, None)], [0, 1000]))
    out = files.concat(spark, paths[:3], str(tmp_path / "all"))
    assert open(out, "rb").read() == b"".join(open(p, "rb").read() for p in (paths[1], paths[0], paths[2]))
    given = files.concat(spark, paths[:2], str(tmp_path / "given"), sort=False)
    assert open(given, "rb").read() == b"".join(open(p, "rb").read() for p in paths[:2])
    done = files.concat_by_time(spark, str(tmp_path / "in"), str(tmp_path / "days"), "1 day", template="%Y%m%d_day")
    assert [os.path.basename(d) for d in done] == ["20240718_day", "20240719_day"]
    assert os.path.getsize(done[0]) == 3 * os.path.getsize(paths[0])
    with pytest.raises(TypeError):
        files.concat(spark, paths[0], str(tmp_path / "x"))
    for bad in ([], [paths[0], paths[0]], [str(tmp_path / "all"), paths[0]]):
        with pytest.raises(ValueError):
            files.concat(spark, bad, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        files.concat(spark, [paths[0]], paths[0])
    with pytest.raises(ValueError):
        files.concat_by_time(spark, str(tmp_path / "in"), str(tmp_path / "no"), pattern="zzz*")


def points(spark, rows):
    return spark.createDataFrame([(float(a), float(b), float(c), t, "kept") for a, b, c, t in rows], "lon double, lat double, z double, time timestamp_ntz, note string")


def test_sampling_on_files(spark, sampled):
    pts = points(spark, [(20.5, -9.5, 950, T0), (20.5, -9.5, 950, T0 + datetime.timedelta(hours=3)), (0, 0, 950, T0), (21, -9, 1100, T0)])
    got = {(r.lon, r.time, r.z): r for r in files.sample_files(spark, sampled, pts, ["TEMP", "PRSS", "pressure"]).collect()}
    assert got[(20.5, T0, 950.0)].TEMP == pytest.approx(280 + 5 + 5.5, abs=0.05) and got[(20.5, T0, 950.0)].note == "kept"
    assert got[(20.5, T0 + datetime.timedelta(hours=3), 950.0)].TEMP == pytest.approx(310.5, abs=0.05)
    assert got[(0.0, T0, 950.0)].TEMP is None and got[(21.0, T0, 1100.0)].TEMP is None
    assert got[(20.5, T0, 950.0)].PRSS == pytest.approx(1001.5, abs=0.05) and got[(20.5, T0, 950.0)].pressure == 950
    near = files.sample_files(spark, sampled, points(spark, [(20.4, -9.4, 900, T0)]), "TEMP", method="nearest").first()
    assert near.TEMP == pytest.approx(290 + 10, abs=0.1)
    agl = files.sample_files(spark, sampled, points(spark, [(22, -8, 1500, T0)]), ["TEMP", "pressure"], z_kind="agl").first()
    assert agl.TEMP == pytest.approx(295 + 22, abs=0.1) and agl.pressure == pytest.approx(850, abs=0.1)
    with pytest.raises(ValueError):
        files.sample_files(spark, sampled, points(spark, [(20, -9, 1, datetime.datetime(2000, 1, 1))]), "TEMP")
    with pytest.raises(KeyError):
        files.sample_files(spark, sampled, points(spark, [(20, -9, 1, T0)]), "NOPE")
    for kw in ({"method": "cubic"}, {"z_kind": "feet"}):
        with pytest.raises(ValueError):
            files.sample_files(spark, sampled, points(spark, [(20, -9, 1, T0)]), "TEMP", **kw)


@pytest.mark.parametrize(("flag", "heights"), [(1, [1.0, 0.9, 0.8]), (4, [0.995, 0.9, 0.8]), (3, [0.0, 100.0, 500.0])])
def test_sampling_on_other_axes(spark, flag, heights):
    flat = [("PRSS", 0, 1000.0), ("SHGT", 0, 200.0), *(("TEMP", lv, 280.0 + 10 * lv) for lv in range(3))]
    cells = spark.createDataFrame([(T0, lv, v, y, x, a) for v, lv, a in flat for y in range(20) for x in range(20)], "time timestamp_ntz, level int, variable string, y int, x int, value double")
    run = lambda z, kind, names=("TEMP",): sampling.sample_points(cells, points(spark, [(22.3, -8.1, z, T0)]), list(names), GRID, heights, flag, kind).first()
    assert run(1.5, "native").TEMP == pytest.approx(295)
    if flag == 3:
        assert run(50, "agl").TEMP == pytest.approx(285) and run(250, "msl").TEMP == pytest.approx(285)
        assert run(50, "agl", ("pressure",)).pressure is None
        with pytest.raises(ValueError):
            run(900, "pressure")
        return
    assert run(850, "pressure").TEMP == pytest.approx(295)
    assert run(1.5, "native", ("pressure",)).pressure == pytest.approx(850)
    z1 = 287.05 / 9.80665 * 285 * np.log(1000 / 900)
    assert run(z1, "agl").TEMP == pytest.approx(290, abs=1e-3) and run(z1 + 200, "msl").TEMP == pytest.approx(290, abs=1e-3)
    assert run(z1, "agl", ("pressure",)).pressure == pytest.approx(900, abs=1e-2)


@pytest.mark.parametrize(
    "p",
    [
        Projection(90, 0, 60, -100, 50, 0, 90, 10, 20, 40, -110),
        Projection(-90, 0, -60, 30, 50, 0, -90, 10, 20, -50, 20),
        Projection(40, -100, 40, -100, 12, 0, 90, 5, 6, 41, -101),
        Projection(0, 0, 20, 10, 30, 0, 0, 1, 1, 5, 6),
        Projection(38.5, -97.5, 38.5, -97.5, 3, 0, 38.5, 1, 1, 30, -125),
        Projection(-40, 0, -40, 140, 9, 0, -40, 1, 1, -45, 130),
        Projection(90, 0, 0.5, 0.5, 0, 0, 0, 1, 1, -90, -180),
    ],
)
def test_projections_invert_and_meet_the_sync_point(spark, p):
    g = Grid(p, 60, 40)
    x, y = g.fractional_indices(float(p.sync_lon), float(p.sync_lat))
    want = (0, 0) if p.is_latlon else (p.sync_x - 1, p.sync_y - 1)
    assert (x, y) == pytest.approx(want, abs=1e-9)
    for i, j in ((0, 0), (7.5, 3.25), (59, 39)):
        assert g.fractional_indices(*g.lon_lat(float(i), float(j))) == pytest.approx((i, j), abs=1e-6)
    df = spark.range(1).select(F.lit(7.5).alias("x"), F.lit(3.25).alias("y"))
    lon, lat = g.lon_lat(F.col("x"), F.col("y"))
    r = df.select(lon.alias("lon"), lat.alias("lat")).first()
    assert (r.lon, r.lat) == pytest.approx(g.lon_lat(7.5, 3.25), abs=1e-9)
    assert g.coords(spark).count() == 2400


def test_grid_windows():
    glob = Grid(Projection(90, 0, 1, 1, 0, 0, 0, 1, 1, -90, 0), 360, 181)
    assert glob.window_from_bbox((-120, 20, -60, 50)) == Window(240, 301, 110, 141)
    lam = Grid(Projection(38.5, -97.5, 38.5, -97.5, 3, 0, 38.5, 1, 1, 30, -125), 800, 600)
    w = lam.window_from_bbox((-115, 35, -105, 42))
    x, y = lam.fractional_indices(-115.0, 35.0)
    assert (w.x_start, w.y_start) == (int(np.floor(x + 1.5)) - 1, int(np.floor(y + 1.5)) - 1)
    for bad in ((0, 10, 5, 0), (30, 50, 40, 60)):
        with pytest.raises(ValueError):
            GRID.window_from_bbox(bad)
    with pytest.raises(ValueError):
        lam.window_from_bbox((170, 10, -170, 20))
    with pytest.raises(ValueError):
        Window(3, 3, 0, 1)
    with pytest.raises(NotImplementedError):
        Projection(90, 0, 1, 1, 0, 5, 0, 1, 1, 0, 0)


def test_writer_refuses_bad_input(spark, tmp_path):
    good = ("f", T0, 0, "TEMP", 0, BASE, None)
    for k, row in enumerate([("f", T0, 5, "TEMP", 0, BASE, None), ("f", T0, 0, "LONGNAME", 0, BASE, None), ("f", T0, 0, "DIFT", 0, BASE, None), ("f", T0, 0, "TEMP", 0, BASE[:3], None), ("f", T0, 0, "TEMP", 0, BASE * np.nan, None), ("f", T0, 0, "TEMP", 0, BASE, "BAD")]):
        with pytest.raises(Exception):  # noqa: B017
            write(spark, tmp_path / str(k), [row], [1000])
    with pytest.raises(ValueError):
        write(spark, tmp_path / "two", [(*good[:6], "DIFA"), ("f", T0, 0, "UWND", 0, BASE, "DIFA")], [1000])
    assert not any(n for n in os.listdir(tmp_path / "0") if not n.startswith(".")) if (tmp_path / "0").exists() else True


def test_archive_names(spark, tmp_path):
    keys = lambda *a: [r.key for r in archive.keys_for_range(spark, *a).collect()]
    assert keys("hrrr", "2024-07-18 05:30", "2024-07-18 06:10") == ["hrrr/2024/07/20240718_00-05_hrrr", "hrrr/2024/07/20240718_06-11_hrrr"]
    assert keys("gdas", "2024-03-29", "2024-03-29") == ["gdas1/2024/gdas1.mar24.w5"]
    assert keys("nams_ak", "2024-01-01", "2024-01-01") == ["nams/2024/01/20240101_hysplit.t00z.namsa.AK"]
    assert keys("reanalysis", "1948-02-01", "1948-01-31") == ["reanalysis/1948/RP194801.gbl", "reanalysis/1948/RP194802.gbl"]
    with pytest.raises(ValueError):
        archive.url_of("k", "gopher")
    with pytest.raises(ValueError):
        archive.product("nope")
    assert archive.cache_name("f", (-1, 2, 3, 4.5)) == "f.crop_-1.000000_2.000000_3.000000_4.500000"


def test_fetch_uses_its_cache_and_crops(spark, sampled, tmp_path):
    asked = []

    def opener(url, options):
        asked.append(url)
        return open(sampled, "rb")

    args = (spark, "nam", "2024-07-18", "2024-07-18 05:00", str(tmp_path))
    (path,) = archive.fetch(*args, opener=opener)
    assert open(path, "rb").read() == open(sampled, "rb").read() and asked == ["s3://noaa-oar-arl-hysplit-pds/nam12/2024/07/20240718_nam12"]
    archive.fetch(*args, opener=opener)
    assert len(asked) == 1
    (crop,) = archive.fetch(*args, opener=opener, bbox=(22, -8, 38, 8), overwrite=True)
    assert files.file_info(packed.read_index(spark, crop))[0].nx == 17
    assert not [n for n in os.listdir(tmp_path) if n.endswith(".tmp")]


def test_cube_and_levels(spark):
    cells = spark.createDataFrame([(1, 0, "A", 0, 0, 1.0), (2, 1, "A", 0, 0, 2.0), (1, 0, "B", 0, 0, 3.0)], "time int, level int, variable string, y int, x int, value double")
    got = {(r.time, r.level): r.value for r in fo.cube(cells, "A").collect()}
    assert got == {(1, 0): 1.0, (1, 1): None, (2, 0): None, (2, 1): 2.0}
