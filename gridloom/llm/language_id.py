"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every training text (nothing is sampled): partitions count into arrays, only
(language, bucket, count) rows are shuffled, and the languages' sums come to the driver one language at a time. The model,
languages x buckets log-probabilities in float32, is bounded by `MAX_MODEL_BYTES` (checked before training) and broadcast
to the workers. They score a slice of documents at a time: its n-grams are one sparse batch of (document, bucket) entries,
gathered from each language's row and summed by document, about `ENTRIES` of them at once; texts are hashed `PART` characters at a time.

`margin` is the log-likelihood of the best language, by n-gram, above that of a background that knows nothing (every
bucket alike). It does not depend on the text's length. Below MIN_MARGIN a text looks like none of the learned languages: other
scripts and random letters are below 0, their relatives a little above.

Cases: null text or text without a letter: `und`, score and margin 0. With no training rows at all every document is `und`.
Null languages and texts are not learned from. A null doc_id is in neither fold's training and counts as not held out.
Very long texts are read whole. Repeated rows are scored alike; ties between languages go to the first in order; empty
tables give empty results; columns that clash with those added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, mapped, mix64, slices, without

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_MODEL_BYTES = 256 << 20
ENTRIES = 1 << 19
PART = 1 << 18
#: A text whose n-grams are on average less than e times as likely as against the background is in none of the learned languages.
MIN_MARGIN = 1.0
FOLDS = 5

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _code_points(text: bytes) -> Iterator[np.ndarray]:
    """The text in parts of at most PART characters: letters lower-cased, each run of anything else one blank, blanks at both ends. Nothing without letters."""
    whole, started, inside = text.decode("utf-8"), False, False
    for i in range(0, len(whole), PART):
        u = np.frombuffer(whole[i : i + PART].lower().encode("utf-32-le"), np.uint32)
        letter = _is_letter()[u]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= inside
        u = np.where(letter, u, 32)[keep]
        inside = bool(letter[-1])
        if len(u):
            yield u if started else np.concatenate([[32], u])
            started = True
    if inside:
        yield np.array([32])


def ngram_buckets(text: bytes | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, in parts of bounded size; none without letters."""
    before = np.empty(0, np.uint64)  # the last code points of the part before
    for part in _code_points(text or b""):
        u = np.concatenate([before, part.astype(np.uint64)])
        for n in ORDERS:
            v = u[max(0, len(before) - n + 1) :]
            code = np.zeros(max(0, len(v) - n + 1), np.uint64)
            for k in range(n):
                code = (code << np.uint64(21)) | v[k : k + len(code)]
            yield (mix64(code + np.uint64(n << 60)) & np.uint64(buckets - 1)).astype(np.int32)
        before = u[len(u) - max(ORDERS) + 1 :] if len(u) >= max(ORDERS) else u


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities, [languages, buckets] float32, from all rows with both columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            for text, lang in zip(as_bytes(part.column("text")), part.column("lang").to_pylist(), strict=True):
                for h in ngram_buckets(text, buckets):
                    if lang not in held:
                        held[lang] = np.zeros(buckets, np.int64)
                    held[lang] += np.bincount(h, minlength=buckets)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_MODEL_BYTES // (4 * buckets) + 1).collect())
    if len(langs) * buckets * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"more languages than a model of {MAX_MODEL_BYTES} bytes can hold")
    counts = mapped(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    table = np.zeros((len(langs), buckets), np.float32)
    table[:] = -np.log(buckets)  # a language whose texts have no letter
    at = {lang: i for i, lang in enumerate(langs)}
    for r in by_lang.toLocalIterator():  # one language at a time
        row = np.full(buckets, SMOOTHING)
        row[np.array(r["buckets"], np.int64)] += np.array(r["counts"], np.float64)
        table[at[r["lang"]]] = np.log(row / row.sum())
    return langs, table


def batch_scores(table: np.ndarray, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """[documents, languages] log-likelihoods and the n-grams of each document: sparse batches of (document, bucket) entries."""
    out, known = np.zeros((len(texts), len(table))), np.zeros(len(texts), np.int64)
    docs, parts, held = [], [], 0

    def add() -> None:
        flat, at = np.concatenate(parts), np.array(docs)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        for lang, row in enumerate(table):
            np.add.at(out[:, lang], at, np.add.reduceat(row[flat], cuts, dtype=np.float64))

    for i, text in enumerate(texts):
        for h in ngram_buckets(text, table.shape[1]):
            if len(h):
                docs.append(i)
                parts.append(h)
                held += len(h)
                known[i] += len(h)
            if held >= ENTRIES:
                add()
                docs, parts, held = [], [], 0
    if parts:
        add()
    return out, known


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The documents with lang_pred, score (the posterior of lang_pred under equal priors) and margin (see above) added."""
    langs, logp = model
    docs = without(docs, ["lang_pred", "score", "margin"], (text_col,))
    sent = docs.sparkSession.sparkContext.broadcast(logp)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "margin": F.lit(0.0)}).schema
    buckets = logp.shape[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for part in slices(batches, text_col, 1 << 20):
            texts = as_bytes(part.column(text_col))
            if langs:
                totals, known = batch_scores(table, texts)
                best = totals.argmax(axis=1)
                top = totals[np.arange(len(best)), best]
                conf = np.where(known > 0, 1 / np.exp(np.maximum(totals - top[:, None], -700)).sum(axis=1), 0.0)
                margin = np.where(known > 0, top / np.maximum(known, 1) + np.log(buckets), 0.0)
                pred = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            else:
                pred, conf, margin = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(conf, pa.float64()), pa.array(margin, pa.float64())], names=[*part.schema.names, "lang_pred", "score", "margin"])

    return mapped(docs, score, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin: learned from the rows that are not held out, predicted for all."""
    model = train(docs.filter(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score", "margin")
