"""WARC archives: writing with revisit records, reading back, and one globally ordered capture index.

Writing: of records with equal payloads of at least `min_bytes` bytes the one with the largest page_id is a response,
the others are revisits without a payload. Groups are found by a map-side combined aggregate over digests; the pages
themselves are dealt by page, never by payload, so large groups of copies stay spread. Each task sorts its captures by
URL key and time and writes them as archives (locally sorted runs) through Spark's own file writer and its commit
protocol: lost tasks are written again, and any store that Spark can write to will do. Pages are written by size class, so
that the payloads of an archive are bounded by bytes (`FILE_BYTES`, or one page that is larger).

Reading: records are parsed by their Content-Length, one archive at a time. The runs' index entries are dealt by ranges
of (URL key, time, page, run, place in the run), `RANGE_ROWS` each on average, and in each range a loser tree merges the k
sorted runs. Ranges follow each other, so the result is the capture history in global order, and one hot host or URL, or one
page repeated, spans as many ranges as it needs. Positions and capture numbers are made global from the ranges' ends, a few numbers a range.

The URL that is written is the one that sorts: tabs, line breaks and blanks are percent-encoded before its key is made.

Cases: null html is an empty payload; a null url has an empty target. A null page_id counts as smaller than any other.
Repeated rows with the largest page_id are all responses. Very long payloads are written whole, in archives of their own.
Empty tables give empty archives and results. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_path

MIN_BYTES = 1000
FILE_BYTES = 64 << 20
RECORDS_PER_FILE = 2_000  # of at most FILE_BYTES / RECORDS_PER_FILE bytes; fewer of larger ones
RANGE_ROWS = 200_000
CRLF = "\r\n"
#: A fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = "url_key string, ts string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, run string, seq long, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels from the top down, then the rest: captures of one site stand together."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(lower, r"(?s)^.*?://([^/?#]*)", 1)
    rest = F.regexp_extract(lower, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(host == "", lower).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def target_uri(url: Column) -> Column:
    """The URL as it is written: on one line, without blanks that a header field would lose."""
    out = F.coalesce(url, F.lit(""))
    for c in "\t\n\r ":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def _record(kind: Column) -> Column:
    """A WARC record without its closing blank lines, as text."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(kind == "response", F.concat(http, F.col("html"))).otherwise(http)
    urn = lambda page: F.concat(F.lit("<urn:page:"), page, F.lit(">"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(page)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.col("ts")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", urn(F.col("refers_to").cast("string"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def _size_class(size: Column) -> Column:
    """0 for pages of up to FILE_BYTES / RECORDS_PER_FILE bytes, 1 for those of up to four times as many, and so on."""
    limit = FILE_BYTES / RECORDS_PER_FILE
    return F.greatest(F.lit(0), F.ceil(F.log(4.0, F.greatest(size, F.lit(1)) / limit))).cast("int")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None, min_bytes: int = MIN_BYTES) -> None:
    """Write every page as a WARC record. Without a column of capture times, a page's time follows from its id."""
    ts = F.col(ts_col) if ts_col else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), target_uri(F.col(url_col)).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    base = base.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html"), "full": F.sha2(F.col("html"), 256)})
    slim = base.filter(F.col("bytes") >= min_bytes).select("page_id", "full")
    classes = sorted(r[0] for r in base.select(_size_class(F.col("bytes")).alias("c")).distinct().collect()) or [0]  # at most 16
    groups = slim.groupBy("full").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL").drop("n")
    groups = materialize(groups, "payload-groups")
    revisits = slim.join(groups, "full").filter("page_id IS NULL OR page_id < refers_to").distinct()
    revisits = materialize(revisits.select(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("key"), "full", "refers_to"), "revisits")
    rows = base.withColumn("key", F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))).join(revisits, ["key", "full"], "left")
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    rows = rows.withColumn("url_key", url_key(F.col("url")))
    for c in classes:
        mine = rows.filter(_size_class(F.col("bytes")) == c).sortWithinPartitions("url_key", "ts", "page_id")
        mine.select(_record(kind).alias("value")).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, RECORDS_PER_FILE >> 2 * c)).text(path)


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields (names lower-cased), block, offset and length of each record of an uncompressed archive."""
    at = 0
    while line := stream.readline():
        start, fields = at, {}
        at += len(line)
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {start}")
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.lower()] = value.strip(" \t\r\n")
        at += len(line)
        block = stream.read(int(fields["content-length"]))
        at += len(block)
        yield fields, block, start, at - start


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records: one run a file, seq in the file's order."""

    def page(urn: str | None) -> int | None:
        x = urn[len("<urn:page:") : -1] if urn else "null"
        return None if x == "null" else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                cols: dict[str, list] = {n: [] for n in names}
                stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 16)
                for seq, (f, block, offset, length) in enumerate(parse_warc(stream)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    whole = f["warc-type"] == "response"
                    values = [None, f["warc-date"], page(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], page(f.get("warc-refers-to"))]
                    values += [len(payload) if whole else int(f["x-payload-length"]), hashlib.sha1(payload).hexdigest() if whole else f["warc-payload-digest"].partition(":")[2], name, seq, offset, length]
                    for n, v in zip(names, values, strict=True):
                        cols[n].append(v)
                longs = {x.split()[0] for x in INDEX.split(", ") if x.endswith("long")}
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], pa.int64() if n in longs else pa.string()) for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(read, INDEX).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges k sorted runs: each inner node holds the loser of its match, so a new head meets log2(k) rivals."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(len(runs))] + [None] * (self.k - len(runs))
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        return (self.key(self.runs[i][self.at[i]]), i) if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x < y)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            rival = self.tree[node]
            if rival < 0:  # the first to come waits for its rival
                self.tree[node] = winner
                return
            if self._beats(rival, winner):
                self.tree[node], winner = winner, rival
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[winner := self.tree[0]] is not None:
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self.heads[winner] = self._head(winner)
            self._play(winner)


def merge_index(entries: DataFrame) -> DataFrame:
    """The index in global order of (url_key, ts, page_id): position is the row's place in it, capture its number in its URL's history (both from 0)."""
    entries = materialize(entries, "capture-runs")
    spark = entries.sparkSession
    schema = entries.select("*", F.lit(0).alias("range"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("nth")).schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, parts = TaskContext.get().partitionId(), list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        keys = list(zip(table.column("url_key").to_pylist(), table.column("ts").to_pylist(), [-1 << 63 if p is None else p for p in table.column("page_id").to_pylist()], strict=True))
        runs: list[list[int]] = []
        last = None
        for row, run in enumerate(table.column("run").to_pylist()):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append(row)
        order = list(LoserTree(runs, keys.__getitem__))
        out = table.take(pa.array(order, pa.int64())).combine_chunks()
        out = out.append_column("range", pa.array([part] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
        captures, before = [], None
        for row in order:
            url = keys[row][0]
            captures.append(captures[-1] + 1 if captures and url == before else 0)
            before = url
        yield from out.append_column("nth", pa.array(captures, pa.int64())).to_batches()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RANGE_ROWS))
    ranged = entries.repartitionByRange(parts, "url_key", "ts", F.coalesce("page_id", F.lit(-(1 << 63))), "run", "seq").sortWithinPartitions("run", "seq")
    merged = materialize(ranged.mapInArrow(merge, schema), "merged-captures")
    discard(entries)
    # the ends of the ranges: what stands before each of them, and how often its first URL was met there
    ends = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.min("url_key").alias("first"), F.max("url_key").alias("last"), (F.max_by("nth", "place") + 1).alias("tail"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range, not a capture
    ends = ends.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    asked = ends.select("range", F.col("first").alias("url"), F.lit(0).cast("long").alias("tail"), "before", F.lit(True).alias("asks"))
    ends = asked.unionByName(ends.select("range", F.col("last").alias("url"), "tail", "before", F.lit(False).alias("asks")))
    same = Window.partitionBy("url").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("met", F.coalesce(F.sum("tail").over(same), F.lit(0))).filter("asks").select("range", "url", "met", "before")
    capture = F.col("nth") + F.when(F.col("url_key") == F.col("url_"), F.col("met")).otherwise(0)
    out = merged.join(ends.withColumnRenamed("url", "url_"), "range").withColumns({"capture": capture, "position": F.col("before") + F.col("place")})
    return out.select(*[x.split()[0] for x in INDEX.split(", ")], "capture", "position")


def warc_round_trip(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the pages to archives, read them back, and return their merged index."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, **columns)
    return merge_index(read_warc(spark, path))
