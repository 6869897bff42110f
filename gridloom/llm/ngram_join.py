"""Near-duplicate join on word shingles (five words, Jaccard 0.8) with Bayesian pruning of MinHash candidates.

Every document becomes its set of shingles. Documents with equal sets are one node with a weight, so copies are never
compared. Candidates share one of 32 bands of 4 of 128 MinHash values (a pair at 0.8 shares none with probability 5e-8).
Their values are then compared in steps; a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below `TOLERANCE` (flat prior, binomial matches). Those that remain are verified exactly.

Large groups of near copies do not become pairs. Nodes that share large buckets, directly or in steps, form a group. Of
each group a centre is made (shingles that most of a few members hold; any set is a valid centre) and every member is
compared with it exactly. 1 - Jaccard is a metric, so all members within 0.1 of the centre are within 0.2 of each other: they
are linked and counted without being compared. The other members meet all of their group in blocks of bounded size,
each pair of blocks a task of its own that prunes and verifies its pairs as matrices and returns a count of links and a spanning
forest for each node, never the pairs. No link is lost.

The result is one row per document: class_id (the smallest doc_id linked to it directly or in steps), n_links (other
documents of similarity 0.8 or more, copies included), n_shingles.

Cases: words are those of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased. A text of fewer than five words is one shingle; one
without words, or null, has none and is alone. A null doc_id comes last as class_id. Repeated rows are copies.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, as_bytes, discard, mapped, materialize, mix64, slices

SHINGLE = 5
THRESHOLD = (4, 5)  # as a fraction
HASHES, BAND = 128, 4
STEP = 16
TOLERANCE = 1e-9  # a pair at exactly the threshold is then dropped with probability 2e-9, far below that of no shared band
LARGE = 32  # nodes that share a bucket of more members than this are a group
BLOCK = 512  # members of a group that one side of a task holds, on average
BLOCK_SHINGLES = 1 << 22  # and their shingles (32 MB), so that very long texts make smaller blocks
CENTRE_SAMPLE = 64
FILTER_BITS = 1 << 27
SLICE = 1 << 18  # bytes of text that are shingled at once; a longer text stays whole
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * SLICE) - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    if n <= 2 * SLICE:  # a worker keeps no table of a longer text
        _powers[:] = made
    return made[0], made[1]


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    parts = [(t or b"").translate(WORD_BYTES) for t in texts]
    ends_at = np.cumsum([len(p) + 1 for p in parts])
    b = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    word = b != 32
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _power_table(len(b) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    w = mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.concatenate([[0], np.searchsorted(start, ends_at, side="left")])
    n = max(0, len(w) - SHINGLE + 1)
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s = s * _ODD + w[k : k + n]
    s = mix64(s)
    out = []
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if z - a >= SHINGLE:
            out.append(np.unique(s[a : z - SHINGLE + 1]))
        elif z > a:
            h = np.array([z - a], np.uint64)
            for k in range(a, z):
                h = h * _ODD + w[k : k + 1]
            out.append(mix64(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _ODD)
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def minhash(s: np.ndarray) -> np.ndarray:
    """128 values of 32 bits."""
    a, b = _parameters()
    low = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(s), 2048):
        low = np.minimum(low, (a[:, None] * s[None, i : i + 2048] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_matches(tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number of compared values, the fewest matches that keep a pair.

    With a flat prior the posterior of m matches in n is Beta(m + 1, n - m + 1); its mass above t is the chance of at most m
    successes in n + 1 trials of probability t.
    """
    t = THRESHOLD[0] / THRESHOLD[1]
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(as_bytes(part.column("text")))
            sig = np.concatenate([minhash(s) for s in sets]) if sets else np.empty(0, np.int32)
            sig = pa.ListArray.from_arrays(np.arange(0, len(sig) + 1, HASHES, dtype=np.int32), pa.array(sig))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), sig], names=["doc_id", "n", "fp", "sig"])

    return mapped(rows, sketch, f"doc_id {kind}, n long, fp binary, sig array<int>")


def _sets_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, set) of wanted nodes (node, fp), made again from the texts.

    A bit map of fixed size (16 MB) of the wanted fingerprints goes to the workers, so that few other sets leave them; the join
    on the whole fingerprint then decides.
    """
    place = F.pmod(F.conv(F.hex(F.substring("fp", 1, 7)), 16, 10).cast("long"), F.lit(FILTER_BITS))
    words = wanted.select(place.alias("p")).select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for part in slices(batches, "text", SLICE):
            fps, out = [], []
            for s in shingle_sets(as_bytes(part.column("text"))):
                fp = fingerprint(s)
                p = int.from_bytes(fp[:7]) % FILTER_BITS
                if int(held[p >> 6]) >> (p & 63) & 1:
                    fps.append(fp)
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(out, pa.binary())], names=["fp", "set"])

    made = mapped(docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL"), sets, "fp binary, set binary")
    # copies of one text give one set each: they meet in a map-side combined aggregate
    made = made.groupBy("fp").agg(F.max("set").alias("set"))
    return made.join(wanted.select("node", "fp"), "fp").select("node", "set")


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both, len(a) + len(b) - both


def _compared(rows: DataFrame, keep: list[str], numerator: int, denominator: int) -> DataFrame:
    """The `keep` columns of rows whose set_a and set_b have a Jaccard similarity of at least the fraction."""
    schema = rows.select(*keep).schema

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            good = []
            for a, b in zip(part.column("set_a"), part.column("set_b"), strict=True):
                both, union = _counts(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
                good.append(both * denominator >= numerator * union)
            yield part.select(keep).filter(pa.array(good, pa.bool_()))

    return mapped(rows.select(*keep, "set_a", "set_b"), compare, schema)


def _balls(group: DataFrame, sets: DataFrame) -> DataFrame:
    """(node) of a group (node, comp, n) that lie within half the allowed distance of their group's centre."""
    order = Window.partitionBy("comp").orderBy(F.xxhash64("node"), "node")
    # the rank alone is filtered first: Spark then limits each partition's groups before the shuffle, however large they are
    some = group.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= CENTRE_SAMPLE)
    some = some.withColumn("held", F.sum("n").over(order)).filter((F.col("nth") == 1) | (F.col("held") <= BLOCK_SHINGLES)).select("node", "comp")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        values, n = np.unique(np.concatenate([np.frombuffer(s, np.uint64) for s in pdf["set"]]), return_counts=True)
        return pd.DataFrame({"comp": [pdf["comp"].iloc[0]], "set_b": [values[2 * n > len(pdf)].tobytes()]})

    centres = materialize(some.join(sets, "node").groupBy("comp").applyInPandas(centre, "comp long, set_b binary"), "centres")
    members = group.join(sets.withColumnRenamed("set", "set_a"), "node").join(centres, "comp")
    num, den = THRESHOLD[0] + THRESHOLD[1], 2 * THRESHOLD[1]  # half way from the threshold to 1
    balls = materialize(_compared(members, ["node"], num, den), "balls")
    discard(centres)
    return balls


def linked_in_block(sig: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of left and right rows (as a matrix) are linked: pruned by their MinHash values, then verified exactly."""
    least = least_matches()
    live = left[:, None] < right[None, :] if left is right else np.ones((len(left), len(right)), bool)
    same = np.zeros(live.shape, np.int16)
    for n in range(STEP, HASHES + 1, STEP):
        for k in range(n - STEP, n):
            same += sig[left, k][:, None] == sig[right, k][None, :]
        live &= same >= least[n]
        if not live.any():
            return live
    rows, cols = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
    a, b = [sets[i] for i in left[rows]], [sets[i] for i in right[cols]]
    known = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))
    both = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(known), 8192):
        part = known[start : start + 8192]

        def incidence(side: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            out = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                s = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, s)
                out[i, at[part[at] == s]] = 1
            return out

        both += incidence(a) @ incidence(b).T
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
    out = np.zeros(live.shape, bool)
    out[np.ix_(rows, cols)] = both * THRESHOLD[1] >= union * THRESHOLD[0]
    return out & live


def _group_links(group: DataFrame, sets: DataFrame, balls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, c, label): partial sums of the weights a node is linked to within its group, outside its ball, and another node of its component."""
    placed = group.join(balls.withColumn("inner", F.lit(True)), "node", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))

    def blocks(inner: Column) -> Column:
        return F.greatest(F.ceil(F.sum(inner.cast("long")) / BLOCK), F.ceil(F.sum(inner.cast("long") * F.col("n")) / BLOCK_SHINGLES))

    sizes = placed.groupBy("comp").agg(blocks(~F.col("inner")).alias("outs"), blocks(F.col("inner")).alias("inns"))
    placed = placed.join(sizes.filter("outs > 0"), "comp")
    # blocks of outer members are numbered from 0, those of the ball from `outs` on; a task is a pair of blocks p <= q with p outer
    mine = F.when(F.col("inner"), F.col("outs") + F.pmod(F.xxhash64("node"), F.greatest("inns", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("outs")))
    placed = placed.withColumn("mine", mine)
    last = F.when(F.col("inner"), F.col("outs")).otherwise(F.col("outs") + F.col("inns")) - 1
    tasks = placed.select("comp", "node", "mine", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    tasks = tasks.select("comp", "node", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") <= F.col("other")).alias("first"), (F.col("mine") == F.col("other")).alias("alone"))
    rows = tasks.join(nodes.select("node", "weight", "sig"), "node").join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        sig = np.stack(pdf["sig"].to_numpy())
        held = [np.frombuffer(s, np.uint64) for s in pdf["set"]]
        left = np.flatnonzero(pdf["first"])
        right = left if pdf["alone"].iloc[0] else np.flatnonzero(~pdf["first"])
        n, weight = len(pdf), pdf["weight"].to_numpy()
        links = np.zeros((n, n), bool)
        if len(left) and len(right):
            links[np.ix_(left, right)] = linked_in_block(sig, held, left, right)
        links |= links.T
        label = np.arange(n)
        while True:  # the least row of each component
            near = np.where(links, label[None, :], n).min(axis=1, initial=n)
            new = np.minimum(label, near)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = links.any(axis=1)
        node = pdf["node"].to_numpy()
        return pd.DataFrame({"node": node[some], "c": (links * weight[None, :]).sum(axis=1)[some], "label": node[label[some]]})

    return materialize(rows.groupBy("comp", "p", "q").applyInPandas(compare, "node long, c long, label long"), "group-links")


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose MinHash values, compared step by step, keep the threshold possible."""
    least = least_matches()
    sig = nodes.select("node", "sig")
    both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b = (part.column(c).flatten().to_numpy().reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            live, m = np.arange(len(a)), np.zeros(len(a), np.int64)
            for n in range(STEP, HASHES + 1, STEP):
                m[live] += (a[live, n - STEP : n] == b[live, n - STEP : n]).sum(axis=1)
                live = live[m[live] >= least[n]]
            yield part.select(["a", "b"]).take(pa.array(live))

    return mapped(both, prune, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes with an edge (a, b)."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        new = materialize(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "labels")
        # jump: a label's own label
        up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = materialize(new.join(up, "label").select("node", "old", F.least("label", "up").alias("label")), "labels")
        for t in (labels, new):
            discard(t)
        labels = jumped
        if labels.filter("old <> label").isEmpty():
            discard(both)
            return labels.select("node", "label")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, fp), and nodes (fp, class_id, keep_fp, links)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketches = materialize(_sketched(docs, "doc_id", "text"), "sketches")
    nodes = sketches.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    band = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * BAND + 1, BAND)))
    banded = nodes.select("node", F.explode(band).alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1"), "buckets")
    members = materialize(banded.join(shared, "key"), "members")
    large = members.filter(F.col("n") > LARGE)
    grouped = not large.isEmpty()
    if grouped:
        group = materialize(components(large.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()).withColumnRenamed("label", "comp").join(nodes.select("node", "n"), "node"), "groups")
        sets = materialize(_sets_of(docs, "text", nodes.join(group, "node").select("node", "fp")), "group-sets")
        balls = _balls(group, sets)
        inside = _group_links(group, sets, balls, nodes)
        discard(sets)
        placed = members.filter(F.col("n") <= LARGE).join(group.select("node", "comp"), "node", "left")
    else:
        placed = members.withColumn("comp", F.lit(None).cast("long"))
    apart = F.col("l.comp").isNull() | F.col("r.comp").isNull() | (F.col("l.comp") != F.col("r.comp"))
    pairs = placed.alias("l").join(placed.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")) & apart).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    likely = materialize(_pruned(pairs.distinct(), nodes), "likely")

    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(_sets_of(docs, "text", nodes.join(ends, "node").select("node", "fp")), "sets")
    rows = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    links = materialize(_compared(rows, ["a", "b"], *THRESHOLD), "links")
    for t in (sets, likely):
        discard(t)

    edges = links
    weight = nodes.select("node", "weight")
    counted = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    counted = counted.join(weight.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum("weight").alias("c"))
    if grouped:
        held = balls.join(group, "node").join(weight, "node")
        sums = held.groupBy("comp").agg(F.sum("weight").alias("s"), F.min("node").alias("least"))
        held = materialize(held.join(sums, "comp"), "ball-sums")
        edges = links.unionByName(held.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))).unionByName(inside.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))
        counted = counted.unionByName(held.select("node", (F.col("s") - F.col("weight")).alias("c"))).unionByName(inside.select("node", "c")).groupBy("node").agg(F.sum("c").alias("c"))
    label = components(edges)
    info = nodes.select("node", "fp", "doc_id", "weight").join(label, "node", "left").join(counted, "node", "left")
    info = materialize(info.select("fp", "doc_id", "node", F.coalesce("label", "node").alias("label"), (F.col("weight") - 1 + F.coalesce("c", F.lit(0))).alias("links")), "info")
    best = info.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "fp")).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    best = materialize(best.select("label", F.col("best.doc_id").alias("keep"), F.col("best.fp").alias("keep_fp"), F.lit(True).alias("joined")), "classes")
    joined = F.coalesce("joined", F.lit(False))
    result = info.join(best, "label", "left").select("fp", F.when(joined, F.col("keep")).otherwise(F.col("doc_id")).alias("class_id"), F.when(joined, F.col("keep_fp")).otherwise(F.col("fp")).alias("keep_fp"), "links")
    result = materialize(result, "near-classes")
    for t in (nodes, shared, members, links, info, best, label, *([group, balls, inside, held] if grouped else [])):
        discard(t)
    return sketches.select("doc_id", "n", "fp"), result


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_links, n_shingles of every document."""
    rows, nodes = near_links(docs, id_col, text_col)
    out = rows.join(nodes, "fp", "left")
    return out.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def with_fingerprint(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE):
            fps = [fingerprint(s) for s in shingle_sets(as_bytes(part.column(text_col)))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps, pa.binary())], names=[*part.schema.names, out_col])

    return mapped(docs, add, docs.withColumn(out_col, F.lit(None).cast("binary")).schema)


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each class: that with the smallest doc_id. All documents without words stay."""
    rows, nodes = near_links(docs, id_col, text_col)
    rows = rows.join(nodes, "fp", "left").filter((F.col("n") == 0) | ((F.col("fp") == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("class_id"))))

    def key(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))

    kept = rows.select(key("doc_id").alias("_gl_id"), F.col("fp").alias("_gl_fp")).distinct()
    named = with_fingerprint(docs, text_col, "_gl_fp").withColumn("_gl_id", key(id_col))
    # texts without words have one fingerprint but are no copies of each other: each has a number of its own
    worded = F.col("_gl_fp") != F.lit(fingerprint(np.empty(0, np.uint64)))
    named = named.withColumn("_gl_row", F.when(worded, F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    nth = F.row_number().over(Window.partitionBy("_gl_id", "_gl_fp", "_gl_row").orderBy("_gl_id", "_gl_fp"))
    return named.join(kept, ["_gl_id", "_gl_fp"]).withColumn("_gl_nth", nth).filter("_gl_nth = 1").select(*docs.columns)
