"""Benchmark decontamination with an FM-index per training shard.

Workers gather documents into shards of a bounded number of words, build an FM-index over each shard's words and search
it backwards for all benchmark windows at once; ranks come from a wavelet matrix, positions from sampled suffixes.
Occurrences are merged into removal spans. No document leaves its task, so nothing is shuffled and a passage that many
documents share costs no more than any other.

Words that no window contains cannot be part of an occurrence: a run of them becomes one separator, and a stretch
between separators that is shorter than the shortest window is left out of the index. This changes no result.

The windows are sent as broadcast blocks of at most `BLOCK_WINDOWS` windows, each used and dropped in turn; the driver
reads the benchmark row by row. Memory is bounded by one block and one shard for any size of benchmark.

Cases: null or word-less texts have no words and are never hit; null or word-less items have no window. An item of fewer
than `WINDOW` words is one window. Items with equal windows all count; repeated items with one id count once. A null
item_id is left out. Empty tables give empty or clean results. Columns that clash with those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, slices, without, words_of

WINDOW = 10
SHARD_WORDS = 500_000
SAMPLE = 8
BLOCK_WINDOWS = 200_000
OUTPUT = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<start:bigint,stop:bigint>>"}


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence in order, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(s[sa[1:]], s[sa[:-1]], out=head[1:])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(head)
    first = np.repeat(starts, np.diff(np.append(starts, n)))  # a suffix's rank is where its group of equals begins
    rank[sa] = first
    k = 1
    while True:
        tied = np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))
        at = np.flatnonzero(tied)
        if not len(at):
            return sa
        sub = sa[at]
        after = np.where(sub + k < n, rank[np.minimum(sub + k, n - 1)] + 1, 0)
        order = np.lexsort((after, rank[sub]))
        sub, after = sub[order], after[order]
        sa[at] = sub
        group = rank[sub]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head[at] = new
        starts = np.flatnonzero(head)
        first = np.repeat(starts, np.diff(np.append(starts, n)))
        rank[sa] = first
        k *= 2


class WaveletMatrix:
    """Ranks and access over a sequence of small integers, one bit plane a level."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each place
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(s) - self.ones[-1][-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before place i."""
        begin, end = np.zeros(len(i), np.int64), i.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.bits - 1 - level)) & 1
            b1, e1 = ones[begin], ones[end]
            begin, end = np.where(bit == 1, zeros + b1, begin - b1), np.where(bit == 1, zeros + e1, end - e1)
        return end - begin

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before it."""
        begin, at, c = np.zeros(len(i), np.int64), i.astype(np.int64), np.zeros(len(i), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            a1 = ones[at]
            bit = ones[at + 1] - a1
            b1 = ones[begin]
            begin, at = np.where(bit == 1, zeros + b1, begin - b1), np.where(bit == 1, zeros + a1, at - a1)
            c = (c << 1) | bit
        return c, at - begin


class FMIndex:
    """Backward search over a sequence of integers of at least 1; patterns must not contain its separators' symbol 1."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.append(s, 0).astype(np.int64)
        sa = suffix_array(s)
        self.n = len(s)
        self.matrix = WaveletMatrix(s[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.sampled = sa % sample == 0
        self.samples = sa[self.sampled]
        self.sample_rank = np.cumsum(self.sampled) - 1

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns (rows, padded at the end). A symbol of -1 occurs nowhere."""
        lo, hi = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            c = patterns[live, lengths[live] - 1 - step]
            known = c >= 0
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live], hi[live] = (self.before[c] + self.matrix.rank(c, x[live]) for x in (lo, hi))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back to a sampled one, all rows at a time."""
        out, todo, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(todo):
            found = self.sampled[rows]
            out[todo[found]] = self.samples[self.sample_rank[rows[found]]] + steps
            todo, rows = todo[~found], rows[~found]
            c, r = self.matrix.access(rows)
            rows = self.before[c] + r
            steps += 1
        return out


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_windows: int) -> Iterator[tuple]:
    """Blocks of (word ids, windows padded with 0, their lengths, and for each window the first of its items, and items)."""

    def packed(held: dict[tuple[bytes, ...], set[str]]) -> tuple:
        ids: dict[bytes, int] = {}
        rows = np.zeros((len(held), window), np.int64)
        for k, words in enumerate(held):
            rows[k, : len(words)] = [ids.setdefault(w, len(ids) + 2) for w in words]
        each = [sorted(x) for x in held.values()]
        return ids, rows, np.array([len(w) for w in held], np.int64), np.cumsum([0, *map(len, each)]), [i for x in each for i in x]

    held: dict[tuple[bytes, ...], set[str]] = {}
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        for w in windows_of(words_of(row["t"].encode()), window):
            held.setdefault(w, set()).add(row["i"])
        if len(held) >= block_windows:
            yield packed(held)
            held = {}
    if held:
        yield packed(held)


def _stretches(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The index's sequence (stretches of known words, a separator 1 after each) and the place of each of its symbols."""
    known = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= shortest
    begin, size = begin[long], (end - begin)[long] + 1
    starts = np.cumsum(size) - size
    places = np.repeat(begin - starts, size) + np.arange(int(size.sum()))
    seq = np.where(np.arange(len(places)) == np.repeat(starts + size - 1, size), 1, ids[np.minimum(places, len(ids) - 1)] if len(ids) else 0)
    return seq, places


def scan_shard(docs: list[list[bytes]], blocks: list, shard_of=lambda b: b) -> list[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """n_words, n_hit, items in order and removal spans of each document of a shard."""
    sizes = np.array([len(d) for d in docs], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    total = int(first[-1])
    diff = np.zeros(total + 1, np.int64)
    items: list[set[str]] = [set() for _ in docs]
    for block in blocks:
        vocab, rows, lengths, item_at, item_ids = shard_of(block)
        # one 0 after each document, so that no window spans two of them
        ids = np.fromiter((vocab.get(w, 0) for d in docs for w in (*d, b" ")), np.int64, total + len(docs))
        seq, places = _stretches(ids, int(lengths.min()))
        if not len(seq):
            continue
        present = np.zeros(len(vocab) + 2, bool)
        present[seq] = True
        present[:2] = True
        small = np.where(present, np.cumsum(present) - 1, -1)
        index = FMIndex(small[seq], int(present.sum()))
        lo, hi = index.search(small[rows], lengths)
        n = hi - lo
        if not (hits := int(n.sum())):
            continue
        which = np.repeat(np.arange(len(n)), n)
        at = places[index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(hits))]
        doc = np.searchsorted(first[1:] + np.arange(1, len(docs) + 1), at, side="right")
        at = at - doc
        np.add.at(diff, at, 1)
        np.add.at(diff, at + lengths[which], -1)
        for d, w in {*zip(doc.tolist(), which.tolist(), strict=True)}:
            items[d].update(item_ids[item_at[w] : item_at[w + 1]])
    hit = np.cumsum(diff[:-1]) > 0
    out = []
    for k, d in enumerate(docs):
        mine = np.concatenate([[False], hit[first[k] : first[k + 1]], [False]])
        edge = np.flatnonzero(mine[1:] != mine[:-1])
        out.append((len(d), int(mine.sum()), sorted(items[k]), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return out


def _value(sent) -> tuple:
    """A broadcast block's value, not kept after use."""
    value = sent.value
    sent.__dict__.pop("_value", None)
    return value


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows with n_words, n_hit, items (ids as sorted strings) and spans (merged, in words, half open) added."""
    docs = without(docs, list(OUTPUT), (text_col,))
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in benchmark_blocks(benchmark, item_col, item_text_col, window, block_windows)]
    schema = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in OUTPUT.items()]).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def done() -> Iterator[pa.RecordBatch]:
            found = iter(scan_shard([d for p in words for d in p], sent, _value))
            for part in parts:
                rows = [next(found) for _ in range(part.num_rows)]
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([[{"start": a, "stop": b} for a, b in r[3]] for r in rows], span)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *OUTPUT])

        parts, words, held = [], [], 0
        for part in slices(batches, text_col, 1 << 20):
            parts.append(part)
            words.append([words_of(t) for t in as_bytes(part.column(text_col))])
            held += sum(map(len, words[-1]))
            if held >= shard_words:
                yield from done()
                parts, words, held = [], [], 0
        if parts:
            yield from done()

    return mapped(docs, scan, schema)


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
