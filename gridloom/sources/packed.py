"""Packed files as a Spark source and sink.

Reading is in two steps. `read_index` lists the catalogue: one row per valid time with its nested manifest, one task per
file, touching only index records. `records` unfolds the manifest natively into one row per record with its byte position;
filters on time, level and variable then prune rows before `with_payload` fetches bytes, by position, for what is left.

Writing goes through a data source writer: each task writes whole files under temporary names, which the commit renames.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from gridloom.functions import packing
from gridloom.functions.projection import Grid
from gridloom.functions.textcodec import FIXED_BYTES, HEADER_BYTES, NUMBERS, Header, Index
from gridloom.sources import stores
from gridloom.sources.stores import open_input

INDEX_SCHEMA = (
    "path string, rs_position long, rs_ordinal int, time timestamp_ntz, source string, forecast int, grid struct<"
    + ",".join(f"{n}:double" for n in NUMBERS[:11])
    + ",nx:int,ny:int>, vertical_flag int, offset double, nz int, record_length long, file_size long, levels array<struct<level:int,height:double,vars:array<struct<name:string,checksum:int,reserved:string>>>>"
)
FIELD_INPUT = "file string, time timestamp_ntz, level int, seq int, variable string, forecast int, data binary, diff_variable string"


def read_index_at(f, position: int, size: int) -> Index | None:
    """The index record at a position; None at the end of the file."""
    f.seek(position)
    raw = f.read(HEADER_BYTES + FIXED_BYTES)
    if not raw:
        return None
    if len(raw) < HEADER_BYTES + FIXED_BYTES:
        raise EOFError(f"an index record ends early at {position}")
    if Header.parse(raw).variable != "INDX":
        raise ValueError(f"expected an index record at {position}")
    return Index.parse(raw + f.read(max(0, Index.used_of(raw) - FIXED_BYTES)))


def _index_row(path: str, position: int, ordinal: int, size: int, x: Index) -> tuple:
    levels = [(i, h, [(n, c, r) for n, c, r in variables]) for i, (h, variables) in enumerate(x.levels)]
    return (path, position, ordinal, x.time, x.source, x.forecast, (*(x.numbers[n] for n in NUMBERS[:11]), x.nx, x.ny), x.vertical_flag, x.numbers["offset"], len(x.levels), x.record_length, size, levels)


def scan_index(path: str, first_only: bool = False):
    """The index records of a file as rows of INDEX_SCHEMA; data records are jumped over."""
    with open_input(path) as f:
        size, position, ordinal = f.size(), 0, 0
        while position < size:
            x = read_index_at(f, position, size)
            yield _index_row(path, position, ordinal, size, x)
            if first_only:
                return
            position += x.record_length * (1 + sum(len(v) for _, v in x.levels))
            ordinal += 1


@dataclass
class FilePart(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class PackedReader(DataSourceReader):
    def __init__(self, paths: list[str], first_only: bool):
        self.paths, self.first_only = paths, first_only

    def partitions(self):
        return [FilePart(p) for p in self.paths]

    def read(self, partition: FilePart):
        yield from scan_index(partition.path, self.first_only)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PackedWriter(DataSourceWriter):
    """Rows must come in whole files, ordered by time, level and seq within a file; `write_packed` sees to that."""

    def __init__(self, path: str, options: dict, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.grid = Grid.from_dict(json.loads(options["grid"]))
        self.heights = json.loads(options["heights"])
        self.flag, self.offset, self.source = int(options["vertical_flag"]), float(options.get("offset", 0.0)), options["source"]
        if len(self.source) > 4:
            raise ValueError(f"source ids have at most 4 characters: {self.source!r}")

    def _records(self, rows: list) -> tuple[list[bytes], Index]:
        """The bytes of a valid time: index record first, then records in manifest order."""
        nx, ny = self.grid.nx, self.grid.ny
        time = rows[0].time
        levels: list[tuple[float, list]] = [(h, []) for h in self.heights]
        bodies: list[tuple[int, bytes]] = []
        seen: set[tuple[int, str]] = set()
        for r in sorted(rows, key=lambda r: (r.level, r.seq)):
            if not 0 <= r.level < len(self.heights):
                raise ValueError(f"level {r.level} is outside the vertical axis")
            if len(r.variable) > 4 or r.variable.startswith("DIF"):
                raise ValueError(f"bad variable name {r.variable!r}")
            if r.data is None:
                raise ValueError(f"{r.variable} at level {r.level} has no data" + ("" if r.forecast in (None, -1) else "; the forecast of an empty record is -1"))
            if r.forecast is None:
                raise ValueError(f"{r.variable} at level {r.level} has data but no forecast")
            if (r.level, r.variable) in seen:
                raise ValueError(f"{r.variable} appears twice at level {r.level} of {time}")
            seen.add((r.level, r.variable))
            field = np.frombuffer(r.data, "<f4")
            if len(field) != nx * ny:
                raise ValueError(f"{r.variable} has {len(field)} cells, the grid {nx * ny}")
            field = field.reshape(ny, nx)
            if not np.isfinite(field).all():
                raise ValueError(f"{r.variable} at level {r.level} has values that are not finite")
            packed = [(r.variable, packing.pack(field))]
            if r.diff_variable:
                if not r.diff_variable.startswith("DIF") or len(r.diff_variable) > 4:
                    raise ValueError(f"bad difference name {r.diff_variable!r}")
                packed.append((r.diff_variable, packing.residual(field, packed[0][1])))
            for name, p in packed:
                head = Header(time, r.forecast, r.level, (nx // 1000 * 1000, ny // 1000 * 1000), name, p.exponent, p.precision, p.initial)
                bodies.append((r.level, head.dump() + p.payload))
                levels[r.level][1].append((name, p.checksum, ""))
        known = [r.forecast for r in rows if r.forecast >= 0]
        numbers = {n: getattr(self.grid.projection, n) for n in NUMBERS[:11]} | {"offset": self.offset}
        index = Index(time, self.source, min(known) if known else -1, numbers, nx, ny, self.flag, levels)
        return [index.dump(), *(b for _, b in bodies)], index

    def write(self, iterator):
        done: list[tuple[str, str]] = []
        out, now, held, times, bound = None, None, [], set(), {}

        def flush():
            if held:
                if held[0].time in times:
                    raise ValueError(f"time {held[0].time} appears twice in {now}")
                times.add(held[0].time)
                for r in held:
                    if r.diff_variable and bound.setdefault(r.diff_variable, r.variable) != r.variable:
                        raise ValueError(f"the difference name {r.diff_variable} is bound to {bound[r.diff_variable]} and {r.variable}")
                for raw in self._records(held)[0]:
                    out.write(raw)
                held.clear()

        for r in iterator:
            if r.file != now:
                flush()
                if out:
                    out.close()
                now, times = r.file, set()
                bound.clear()
                part = f"{self.path}/.{r.file}.{uuid.uuid4().hex}.tmp"
                out = stores.open_output(part)
                done.append((part, f"{self.path}/{r.file}"))
            if held and held[0].time != r.time:
                flush()
            held.append(r)
        flush()
        if out:
            out.close()
        return Written(done)

    def commit(self, messages):
        files = [f for m in messages if m for f in m.files]
        if len({f for _, f in files}) != len(files):
            self.abort(messages)
            raise ValueError("a file was written by two tasks")
        for part, final in files:
            if not self.overwrite and stores.size_of(final) is not None:
                self.abort(messages)
                raise FileExistsError(final)
            stores.move(part, final)

    def abort(self, messages):
        for m in messages:
            for part, _ in m.files if m else []:
                stores.remove(part)


class PackedSource(DataSource):
    """`spark.read.format("packedmet").option("paths", json list)`; see read_index and write_packed."""

    @classmethod
    def name(cls) -> str:
        return "packedmet"

    def schema(self):
        return INDEX_SCHEMA

    def reader(self, schema):
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return PackedReader(paths, self.options.get("firstIndexOnly", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return PackedWriter(self.options["path"], self.options, overwrite)


def list_files(path: str | list[str], pattern: str = "*") -> list[str]:
    """Files of a path, a list of paths, or a folder (not below it), sorted."""
    import fnmatch

    from pyarrow import fs

    out = []
    for p in [path] if isinstance(path, (str, os.PathLike)) else path:
        p = os.fspath(p)
        store, name = stores.store_of(p)
        info = store.get_file_info(name)
        if info.type == fs.FileType.Directory:
            scheme = p.split(":")[0] + "://" if "://" in p else ""
            out += sorted(scheme + x.path for x in store.get_file_info(fs.FileSelector(name)) if x.is_file and fnmatch.fnmatch(x.base_name, pattern) and not x.base_name.startswith("."))
        elif info.type == fs.FileType.NotFound:
            raise FileNotFoundError(p)
        else:
            out.append(p)
    return out


def read_index(spark: SparkSession, path: str | list[str], pattern: str = "*", first_only: bool = False) -> DataFrame:
    """The catalogue of packed files: INDEX_SCHEMA. first_only stops after the first index record of each file."""
    spark.dataSource.register(PackedSource)
    files = list_files(path, pattern)
    return spark.read.format("packedmet").option("paths", json.dumps(files)).option("firstIndexOnly", str(first_only).lower()).load()


def check_index(index: DataFrame) -> DataFrame:
    """One row (path, problem) for each broken rule: one source, grid and axis a file, unique times."""
    axis = F.struct("vertical_flag", "offset", F.transform("levels", lambda v: v["height"]).alias("h"))
    per = index.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("time").alias("times"), F.countDistinct("source").alias("sources"), F.countDistinct("grid").alias("grids"), F.countDistinct(axis).alias("axes"))
    rules = [("times", F.col("times") < F.col("n")), ("sources", F.col("sources") > 1), ("grids", F.col("grids") > 1), ("axes", F.col("axes") > 1)]
    return per.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))).alias("problem"))


def records(index: DataFrame) -> DataFrame:
    """One row per record in file order, differences attached to the record before them; no payload is read.

    Neighbours in the manifest are looked at before it is exploded, so each row carries its own entry only.
    """
    flat = F.flatten(F.transform("levels", lambda v: F.transform(v["vars"], lambda x: F.struct(v["level"].alias("level"), v["height"].alias("height"), x["name"].alias("variable"), x["checksum"].alias("checksum"), x["reserved"].alias("reserved")))))
    is_diff = lambda x: F.coalesce(x["variable"].startswith("DIF"), F.lit(False))

    def entry(all_, x, i):
        before, after = F.get(all_, i - 1), F.get(all_, i + 1)
        lone = is_diff(x) & (before.isNull() | is_diff(before))
        checked = F.when(lone, F.raise_error(F.lit("a difference record has no record before it")).cast("boolean")).otherwise(is_diff(x))
        return F.struct(i.alias("seq"), x.alias("r"), checked.alias("diff"), F.when(is_diff(after), after["variable"]).alias("diff_variable"), F.when(is_diff(after), after["checksum"]).alias("diff_checksum"))

    entries = F.transform(F.array(flat), lambda all_: F.transform(all_, lambda x, i: entry(all_, x, i)))[0]
    keep = ["path", "time", "source", F.col("forecast").alias("index_forecast"), "rs_position", "rs_ordinal", "record_length", "grid", "vertical_flag", "offset"]
    rows = index.select(*keep, F.explode(entries).alias("e")).filter(~F.col("e.diff"))
    at = F.col("rs_position") + (F.col("e.seq") + 1) * F.col("record_length")
    return rows.select("path", "time", "source", "index_forecast", "rs_ordinal", F.col("e.seq").alias("seq"), "record_length", "grid", "vertical_flag", "offset", "e.r.*", at.alias("position"), "e.diff_variable", "e.diff_checksum")


def recordset(index: DataFrame, key) -> DataFrame:
    """The index row of a time (a timestamp or its text), or that with an ordinal in its file; negative ordinals count from its end."""
    if isinstance(key, int):
        if key >= 0:
            return index.where(F.col("rs_ordinal") == key)
        last = index.groupBy("path").agg(F.max("rs_ordinal").alias("_last"))
        return index.join(last, "path").where(F.col("rs_ordinal") == F.col("_last") + 1 + key).drop("_last")
    return index.where(F.col("time") == F.lit(key).cast("timestamp_ntz"))


def contains(index: DataFrame, time, level: int | None = None, variable: str | None = None) -> bool:
    """Whether a time, or a record of a level and variable in it, is there; what cannot be read as a time is not."""
    rows = index.where(F.col("time") == F.lit(str(time)).try_cast("timestamp_ntz"))
    if level is not None or variable is not None:
        rows = records(rows)
        rows = rows if level is None else rows.where(F.col("level") == level)
        rows = rows if variable is None else rows.where(F.col("variable") == variable)
    return not rows.isEmpty()


PAYLOAD = "forecast int, exponent int, precision double, initial_value double, payload binary, diff_exponent int, diff_precision double, diff_initial double, diff_payload binary"


READ_CHUNK = 64 << 20


def dealt(recs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Records by stretches of READ_CHUNK bytes of their file, so that many tasks read one large file, each in its order."""
    spark = recs.sparkSession
    tasks = tasks or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return recs.repartition(tasks, "path", F.floor(F.col("position") / READ_CHUNK)).sortWithinPartitions("path", "position")


def with_payload(recs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Fetch headers and payloads of the given records; a header that does not fit its manifest entry is an error."""
    recs = dealt(recs, tasks)
    schema = recs.select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in PAYLOAD.split(", ")]).schema

    def fetch(batches):
        name, f = None, None
        for batch in batches:
            cols: dict[str, list] = {x.split()[0]: [] for x in PAYLOAD.split(", ")}
            need = zip(*(batch.column(c).to_pylist() for c in ("path", "position", "record_length", "variable", "level", "diff_variable")), strict=True)
            for path, position, length, variable, level, diff in need:
                if path != name:
                    if f:
                        f.close()
                    name, f = path, open_input(path)
                f.seek(position)
                raw = f.read(length * (2 if diff else 1))
                heads = []
                for k, want in enumerate([variable, diff][: 2 if diff else 1]):
                    part = raw[k * length : (k + 1) * length]
                    if len(part) < length:
                        raise ValueError(f"{path} ends inside {want} at {position}")
                    h = Header.parse(part)
                    if h.variable != want or h.level != level:
                        raise ValueError(f"header {h.variable!r} level {h.level} does not match its index entry {want!r} level {level}")
                    heads.append((h, part[HEADER_BYTES:]))
                (h, p), (d, q) = heads[0], heads[1] if diff else (None, None)
                row = [h.forecast, h.exponent, h.precision, h.initial, p, d and d.exponent, d and d.precision, d and d.initial, q]
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)
            types = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
            new = [pa.array(cols[x.split()[0]], types[x.split()[1]]) for x in PAYLOAD.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *cols])
        if f:
            f.close()

    return recs.mapInArrow(fetch, schema)


def verify_checksums(loaded: DataFrame) -> DataFrame:
    """The loaded records with checksum_ok, of the record and its difference."""
    schema = loaded.withColumn("checksum_ok", F.lit(True)).schema

    def verify(batches):
        for b in batches:
            ok = [packing.checksum(p) == c and (q is None or packing.checksum(q) == d) for p, c, q, d in zip(*(b.column(x).to_pylist() for x in ("payload", "checksum", "diff_payload", "diff_checksum")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "checksum_ok"])

    return loaded.mapInArrow(verify, schema)


def write_packed(fields: DataFrame, path: str, grid: Grid, heights: list[float], vertical_flag: int, source: str, offset: float = 0.0, overwrite: bool = True) -> None:
    """Write fields (FIELD_INPUT; data: float32 little-endian rows) as packed files of a folder, one task a file."""
    spark = fields.sparkSession
    spark.dataSource.register(PackedSource)
    rows = fields.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in FIELD_INPUT.split(", ")])
    ordered = rows.repartition("file").sortWithinPartitions("file", "time", "level", "seq")
    writer = ordered.write.format("packedmet").mode("overwrite" if overwrite else "append")
    for k, v in {"grid": json.dumps(grid.to_dict()), "heights": json.dumps([float(h) for h in heights]), "vertical_flag": vertical_flag, "source": source, "offset": offset}.items():
        writer = writer.option(k, str(v))
    try:
        writer.save(path)
    except PySparkException as e:  # a broken rule of the writer is the caller's error, wherever it was found
        if found := re.search(r"ValueError: (.*)", str(e)):
            raise ValueError(found[1]) from e
        raise


