"""Archive naming: which archive objects cover a time range, as a table, and where they are."""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Public addresses of the archive.
S3_BUCKET, FTP_HOST, HTTP_BASE = "noaa-oar-arl-hysplit-pds", "ftp.arl.noaa.gov", "https://www.ready.noaa.gov/data/archives"
NAMS_SUFFIX = {"conus": "", "ak": ".AK", "hi": ".HI"}


def _fmt(t: Column, pattern: str) -> Column:
    return F.date_format(t, pattern)


def _six_hours(t: Column) -> Column:
    start = (F.hour(t) / 6).cast("int") * 6
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(_fmt(t, "yyyyMMdd"), F.lit("_"), two(start), F.lit("-"), two(start + 5), F.lit("_hrrr"))


def _week(t: Column) -> Column:
    return F.concat(F.lit("gdas1."), F.lower(_fmt(t, "MMM")), _fmt(t, "yy"), F.lit(".w"), ((F.dayofmonth(t) - 1) / 7).cast("int") + 1)


def _daily(name: str):
    return lambda t: F.concat(_fmt(t, "yyyyMMdd"), F.lit(name))


@dataclass(frozen=True)
class Product:
    """folder: pattern of the folder below the product's own; file: expression of the file name; start: first day in the archive (not enforced)."""

    folder: str
    pattern: str
    file: object
    start: date

    def key(self, t: Column) -> Column:
        return F.concat(F.lit(self.folder + "/"), _fmt(t, self.pattern), F.lit("/"), self.file(t))


PRODUCTS: dict[str, Product] = {
    "hrrr": Product("hrrr", "yyyy/MM", _six_hours, date(2019, 6, 12)),
    "nam": Product("nam12", "yyyy/MM", _daily("_nam12"), date(2007, 5, 1)),
    "gdas": Product("gdas1", "yyyy", _week, date(2004, 12, 1)),
    "gfs": Product("gfs0p25", "yyyy/MM", _daily("_gfs0p25"), date(2019, 6, 1)),
    **{f"nams_{d}": Product("nams", "yyyy/MM", _daily("_hysplit.t00z.namsa" + s), date(2010, 1, 1)) for d, s in NAMS_SUFFIX.items()},
    "reanalysis": Product("reanalysis", "yyyy", lambda t: F.concat(F.lit("RP"), _fmt(t, "yyyyMM"), F.lit(".gbl")), date(1948, 1, 1)),
    "hrrr_v1": Product("hrrr.v1", "yyyy/MM", lambda t: F.concat(F.lit("hysplit."), _fmt(t, "yyyyMMdd"), F.lit("."), _fmt(t, "HH"), F.lit("z.hrrra")), date(2015, 6, 1)),
    "gdas0p5": Product("gdas0p5", "yyyy/MM", _daily("_gdas0p5"), date(2007, 9, 1)),
    "narr": Product("narr", "yyyy", lambda t: F.concat(F.lit("NARR"), _fmt(t, "yyyyMM")), date(1979, 1, 1)),
}


def product(name: str) -> Product:
    if name not in PRODUCTS:
        raise ValueError(f"unknown product {name!r}; one of {sorted(PRODUCTS)}")
    return PRODUCTS[name]


def keys_of(times: DataFrame, name: str, time_col: str = "t") -> DataFrame:
    """(key, first_time): the distinct keys of a column of times, with the earliest time each covers."""
    return times.groupBy(product(name).key(F.col(time_col)).alias("key")).agg(F.min(time_col).alias("first_time"))


def keys_for_range(spark: SparkSession, name: str, start: str, end: str) -> DataFrame:
    """(key, first_time) for all hours from start to end, both floored to the hour and swapped where reversed."""
    a, b = (F.date_trunc("hour", F.lit(x).cast("timestamp_ntz")).cast("timestamp_ntz") for x in (start, end))
    if spark.range(1).select(a.isNull() | b.isNull()).first()[0]:
        raise ValueError(f"{start!r} and {end!r} must both be times")
    hours = spark.range(1).select(F.explode(F.sequence(F.least(a, b), F.greatest(a, b), F.expr("interval 1 hour"))).alias("t"))
    return keys_of(hours, name).orderBy("first_time")


def url_of(key: Column | str, backend: str = "s3") -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    base = {"s3": f"s3://{S3_BUCKET}/", "ftp": f"ftp://anonymous@{FTP_HOST}/archives/", "http": f"{HTTP_BASE}/"}
    if backend not in base:
        raise ValueError(f"unknown backend {backend!r}; one of {list(base)}")
    return F.concat(F.lit(base[backend]), key)


def storage_options(backend: str) -> dict:
    """Options of a store: public buckets are read without credentials."""
    return {"anonymous": True} if backend == "s3" else {}


def cache_name(filename: str, bbox: tuple[float, float, float, float] | None = None) -> str:
    """The name under which a file, or its crop to a box, is kept. Six decimals keep near boxes apart."""
    return filename if bbox is None else filename + ".crop_" + "_".join(f"{v:.6f}" for v in bbox)


def fetch(spark: SparkSession, name: str, start: str, end: str, local_dir: str, backend: str = "s3", bbox=None, overwrite: bool = False, opener=None) -> list[str]:
    """Paths of local copies of all archive files of a range; those that exist are used again, crops are made on the way.

    opener(url, options) returns a readable binary stream; by default pyarrow opens s3 and urllib the others. The number of
    keys is that of files to download, so the driver may hold it.
    """
    from gridloom.operators.files import extract_subset

    opener = opener or _open
    rows = keys_for_range(spark, name, start, end).withColumn("url", url_of(F.col("key"), backend)).collect()
    os.makedirs(local_dir, exist_ok=True)
    out = []
    for r in rows:
        dest = os.path.join(local_dir, cache_name(r["key"].rsplit("/", 1)[-1], bbox))
        out.append(dest)
        if os.path.exists(dest) and not overwrite:
            continue
        part = dest + ".tmp"
        try:
            with opener(r["url"], storage_options(backend)) as src, open(part, "wb") as dst:
                shutil.copyfileobj(src, dst, 8 << 20)
            if bbox is None:
                os.replace(part, dest)
            else:
                extract_subset(spark, part, dest, bbox=bbox)
        finally:
            if os.path.exists(part):
                os.remove(part)
    return out


def _open(url: str, options: dict):
    if url.startswith("s3://"):
        from pyarrow import fs

        return fs.S3FileSystem(**options).open_input_stream(url.removeprefix("s3://"))
    import urllib.request

    return urllib.request.urlopen(url)
