"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the last token of its encoding is unique. It is found among the vocabulary tokens that end
there (matches of an Aho-Corasick automaton over the vocabulary) as the longest one that is compatible with the last
token of the prefix before it; compatible means that merging their texts together would give back just these two tokens.
Back-pointers from the whole word then spell the ids. Time is linear in the word's length for any vocabulary.

The vocabulary file is that of a word-end BPE tokenizer (see `Vocabulary`); its path is a parameter. No word reaches over
white space, so texts are cut there, and the encodings of the pieces are kept, like pair tests, in caches of bounded size
on each worker, which changes no result.

Cases: null text counts as empty (no tokens). Texts of any length are encoded whole. Equal rows get equal results, and
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_TABLES, mapped, slices, without

CACHE_WORDS = 200_000
#: Longer pieces are encoded anew each time, so that the cache stays small.
CACHE_LENGTH = 64
CACHE_PAIRS = 500_000
#: Separators that Python's split() takes for white space and the pre-tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: The pre-tokenizer pattern, special tokens and word-end mark of the tokenizer file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is a visible Latin-1 character, else the next from U+0100."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """Encodings of words or pieces of text, (ids, decoded), each joined by spaces; a missing one is made, and kept if it is short."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> tuple[str, str]:
        found = self.make(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[piece] = found
        return found


class Vocabulary:
    """A vocabulary whose last symbol of a word is a letter joined with the word end.

    Inside, such a symbol is one character: the letter shifted by END. A token is then a plain string, and a prefix of a
    word never ends between a letter and its word end.
    """

    END = 0x1000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.shown = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown.update({i: t for t, i in self.special.items()})
        self.splitter = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.letters = byte_letters()
        self.ids = {self._inner(t): i for t, i in self.vocab.items()}
        # when each token is made: rank of its merge, and the two tokens it is made of
        self.rank: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.merges: dict[tuple[str, str], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (self._inner(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges.setdefault((a, b), r)
            if a + b not in self.rank:
                self.rank[a + b], self.parts[a + b] = r, (a, b)
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.own = {t for t in self.ids if (t in self.rank or len(t) == 1) and self._own(t)}
        for token in self.own:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        self.id_text = {t: str(i) for t, i in self.ids.items()}
        self.shown_text = {t: self.shown[i] for t, i in self.ids.items()}
        self.byte_table = dict(enumerate(self.letters))
        self.words_seen, self.cache = Pieces(self._word), Pieces(self._piece)

    def _inner(self, token: str) -> str:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            token = token[: -len(WORD_END)]
            return token[:-1] + chr(ord(token[-1]) + self.END)
        return token

    def _own(self, token: str) -> bool:
        """Whether a token's text is encoded as that token: its two parts must be so and fit together but for its own merge."""
        if len(token) == 1:
            return True
        a, b = self.parts[token]
        return self.compatible(a, b, self.rank[token])

    def compatible(self, a: str, b: str, below: int | None = None) -> bool:
        """Whether no merge across the seam of a and b comes before the merges that build a and b are all done.

        Undo the later of the two outermost merges at the seam, step by step. At each moment the pieces that face each
        other must not merge earlier than the next merge that changes either of them. `below`: only merges of a smaller rank count.
        """
        limit = len(self.merges) if below is None else below
        while True:
            # ties in time: at equal rank the left occurrence merges first
            r = self.merges.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra >= rb:
                # before rank ra, a was its right part; a seam merge of the same rank lies further right, so it waits
                limit, a = min(limit, ra), self.parts[a][1]
            else:
                # before rank rb, b was its left part; a seam merge of the same rank lies further left, so it comes first
                limit, b = min(limit, rb + 1), self.parts[b][0]

    def encode_inner(self, word: str) -> list[str]:
        """The tokens of a word of inner symbols."""
        if word in self.own:
            return [word]
        fits = self.fits
        last: list[str | None] = [None] * (len(word) + 1)
        for end, token in self.automaton.iter(word):  # at each end the longest comes first
            end += 1
            if last[end] is not None:
                continue
            start = end - len(token)
            if start:
                pair = (last[start], token)
                if (fit := fits.get(pair)) is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    fit = fits[pair] = self.compatible(*pair)
                if not fit:
                    continue
            last[end] = token
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _tokens(self, word: str) -> list[str]:
        raw = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.byte_table)
        return self.encode_inner(raw[:-1] + chr(ord(raw[-1]) + self.END))

    def encode_word(self, word: str) -> list[int]:
        return [self.ids[t] for t in self._tokens(word)]

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Words of a text in order, and special tokens (True), which are found before anything is normalised."""
        for i, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if i % 2:
                yield part, True
            elif part:
                part = unicodedata.normalize("NFC", part)
                # each character by itself: the capital sigma has no final form here
                part = part.lower() if "Σ" not in part else "σ".join(x.lower() for x in part.split("Σ"))
                for word in self.words.findall(part):
                    yield word, False

    def encode(self, text: str) -> list[int]:
        return [i for piece, special in self.pieces(text) for i in ([self.special[piece]] if special else self.encode_word(piece))]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by spaces: the file names no decoder."""
        return " ".join(self.shown[i] for i in ids)

    def _word(self, word: str) -> tuple[str, str]:
        tokens = self._tokens(word)
        return " ".join(map(self.id_text.__getitem__, tokens)), " ".join(map(self.shown_text.__getitem__, tokens))

    def _piece(self, piece: str) -> tuple[str, str]:
        if piece.isascii() and piece.isalpha():
            return self.words_seen[piece.lower()]
        found = [(str(self.special[word]), word) if special else self.words_seen[word] for word, special in self.pieces(piece)]
        return found[0] if len(found) == 1 else (" ".join([ids for ids, _ in found]), " ".join([shown for _, shown in found]))

    def coded(self, text: str) -> tuple[str, str]:
        """ids joined by spaces, and their decoding, of a text."""
        both = list(map(self.cache.__getitem__, [text] if _SEPARATORS.search(text) else text.split()))
        return " ".join([ids for ids, _ in both]), " ".join([shown for _, shown in both])


_loaded: dict[str, Vocabulary] = {}
WORKER_TABLES["bpe"] = _loaded


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in slices(batches, "text"):
            n, ids_sha, text_sha = [], [], []
            for text in part.column("text").to_pylist():
                ids, shown = v.coded(text or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(shown.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(rows, digest, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """The rows with an array of token ids added."""
    docs = without(docs, [out_col], (text_col,))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in slices(batches, text_col):
            ids = [v.encode(t or "") for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, out_col])

    return mapped(docs, encode, docs.withColumn(out_col, F.lit(None).cast("array<int>")).schema, "bpe")


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the decoded text of an array of ids added; null ids decode to an empty text."""
    rows = without(rows, [out_col], (ids_col,))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in batches:
            texts = [v.decode(ids or []) for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return mapped(rows, decode, rows.withColumn(out_col, F.lit("")).schema, "bpe")
