"""Chat formatting by token-level assembly.

Each turn's segments are encoded by themselves as ordinary text; the template's marks are reserved ids spliced between
them, so that no text can ever produce a control token. In the formatted text, control strings inside texts are escaped
reversibly. Every offset of the result, the loss mask's ones too, is a prefix sum over the conversation's segments: within
chunks of turns, over the chunks' totals, and added up, so that a conversation with a third of all rows is dealt over
many tasks. The digests are read back from that sequence, in the order of its offsets.

A formatted conversation is `<s>`, then for each turn `<|turn|>` role `<|text|>` text `</s>`.

Cases: null text counts as empty, and so does a null role. Rows of a conversation are ordered by turn (null last), then
role and text, so repeated rows and tied turns have one order. A null conv_id is a conversation. Empty tables give empty
results. Texts of any length are read whole; white space beyond RUN characters on end is encoded in parts of RUN, which
decode to the same text (the tokenizer would overflow on such runs). Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

#: The template's marks first, then control strings of other well-known templates.
MARKS = ["<s>", "</s>", "<|turn|>", "<|text|>"]
CONTROLS = [*MARKS, "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
ESCAPE = "\\"
CHUNK = 256
#: Characters of white space that are encoded at once.
RUN = 1 << 16
_LONG_RUN = re.compile(rf"\s{{{RUN}}}")


def escape(text: str) -> str:
    """Break control strings: the escape sign is doubled, and put behind the first character of each control string."""
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in CONTROLS:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


class Coder:
    """A byte-level BPE whose reserved ids, for the marks, follow the vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # a fixed value: the word pattern published with this kind of vocabulary
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.bpe = tiktoken.Encoding("gridloom-chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        base = max(ranks.values()) + 1
        self.reserved = {m: base + i for i, m in enumerate(MARKS)}

    def encode(self, text: str) -> list[int]:
        if len(text) <= RUN:
            return self.bpe.encode_ordinary(text)
        ends = [*(m.end() for m in _LONG_RUN.finditer(text)), len(text)]
        return [i for a, b in zip([0, *ends[:-1]], ends, strict=True) for i in self.bpe.encode_ordinary(text[a:b])]

    def decode(self, ids: list[int]) -> str:
        return self.bpe.decode_bytes(ids).decode("utf-8")


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _ordered() -> list[Column]:
    return [F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]


def escaped(text: Column) -> Column:
    """escape() as a column."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def encode_turns(rows: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, chars (of its formatted text), ids, and lead and said: the tokens before the text, and those of the text if its role is under the loss."""
    base = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = base.select("*", F.lit(0).cast("long").alias("chars"), F.lit(None).cast("array<int>").alias("ids"), F.lit(0).alias("lead"), F.lit(0).alias("said")).schema

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        _, end, turn, body = (c.reserved[m] for m in MARKS)
        marks = sum(map(len, MARKS[1:]))
        for part in slices(batches, "text"):
            chars, ids, lead, said = [], [], [], []
            for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True):
                r, t = escape(role), escape(text)
                head, own = [turn, *c.encode(r), body], c.encode(t)
                chars.append(marks + len(r) + len(t))
                ids.append([*head, *own, end])
                lead.append(len(head))
                said.append(len(own) if role in loss_roles else 0)
            new = [pa.array(chars, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(lead, pa.int32()), pa.array(said, pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, "chars", "ids", "lead", "said"])

    return base.mapInArrow(encode, schema)


def format_chat(rows: DataFrame, path: str, **columns) -> DataFrame:
    """The turns with their formatted text (piece) and ids, and their places in the conversation: token_from, token_to, loss_from, loss_to, char_from, char_to.

    Token 0 of a conversation is <s>. Offsets are prefix sums: in chunks of turns, then over the chunks. Turns are
    encoded once; the table of their chunks is written, so that its totals need no second encoding.
    """
    conv = F.col("conv_id")
    coded = encode_turns(rows, path, **columns).select(
        "*", F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string"))).alias("_key"), F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(1 << 62)) / CHUNK).alias("_chunk"), F.size("ids").cast("long").alias("_n")
    )
    inside = Window.partitionBy("_key", "_chunk").orderBy(*_ordered()).rowsBetween(Window.unboundedPreceding, -1)
    coded = materialize(coded.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_in") for c in ("_n", "chars")]), "chat-turns")
    totals = coded.groupBy("_key", "_chunk").agg(F.sum("_n").alias("_n"), F.sum("chars").alias("chars"))
    over = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_key", "_chunk", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_before") for c in ("_n", "chars")])
    token, char = F.lit(1) + F.col("_n_before") + F.col("_n_in"), F.lit(len(MARKS[0])) + F.col("chars_before") + F.col("chars_in")
    piece = F.concat(F.lit(MARKS[2]), escaped(F.col("role")), F.lit(MARKS[3]), escaped(F.col("text")), F.lit(MARKS[1]))
    placed = coded.join(totals, ["_key", "_chunk"]).withColumns({"token_from": token, "char_from": char, "piece": piece})
    loss = F.col("token_from") + F.col("lead")
    return placed.select("conv_id", "turn", "role", "text", "piece", "ids", "token_from", (F.col("token_from") + F.col("_n")).alias("token_to"), loss.alias("loss_from"), (loss + F.col("said")).alias("loss_to"), "char_from", (F.col("char_from") + F.col("chars")).alias("char_to"))


def chat_digests(rows: DataFrame, path: str, **columns) -> DataFrame:
    """Per conversation, read back from the sequence of format_chat: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens, mask_sha256.

    The text under the mask is decoded from the ids between loss_from and loss_to; mask_sha256 digests the mask's ranges
    (`from-to;`, empty ones aside). Turns are read back where they are; then a conversation's turns are brought together, in
    the order of their offsets, and streamed through its digests one row at a time: a SHA-256 of a whole conversation can
    be taken in no other way. Turns whose offsets do not follow each other are an error.
    """
    made = format_chat(rows, path, **columns)
    id_type = made.schema["conv_id"].dataType.simpleString()
    cut = re.compile(re.escape(MARKS[2]) + "(.*?)" + re.escape(MARKS[3]) + "(.*?)" + re.escape(MARKS[1]), re.DOTALL)
    places = ["token_from", "token_to", "loss_from", "loss_to", "char_from", "char_to"]
    sent = [*places, "role", "text", "loss"]

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for part in slices(batches, "piece"):
            out: list[list] = [[], [], []]
            for piece, ids, at, a, b in zip(*(part.column(x).to_pylist() for x in ("piece", "ids", "token_from", "loss_from", "loss_to")), strict=True):
                role, text = map(unescape, cut.fullmatch(piece).groups())
                loss = unescape(c.decode(ids[a - at : b - at]))
                # null: the text under the mask is the turn's text
                for column, v in zip(out, (role, text, None if loss == text else loss), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), *(part.column(x) for x in places), *(pa.array(v, pa.string()) for v in out)], names=["conv_id", *sent])

    back = made.select("conv_id", "piece", "ids", *places).mapInArrow(read_back, f"conv_id {id_type}, {', '.join(f'{p} long' for p in places)}, role string, text string, loss string")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens", "mask_sha256"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_arrow, now, turns, held = None, None, None, []

        def batch() -> pa.RecordBatch:
            types = [id_arrow] + [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names=["conv_id", *names])

        def row() -> tuple:
            return now, n, turns.hexdigest(), loss_chars, loss_sha.hexdigest(), char_end, token_end, masked, mask.hexdigest()

        for part in batches:
            id_arrow = part.schema.field("conv_id").type
            for conv, token, token_to, a, b, char, char_to, role, text, loss in zip(*(part.column(x).to_pylist() for x in ("conv_id", *sent)), strict=True):
                if turns is None or conv != now:
                    if turns is not None:
                        held.append(row())
                    now, n, loss_chars, masked, token_end, char_end = conv, 0, 0, 0, 1, len(MARKS[0])
                    turns, loss_sha, mask = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                if (token, char) != (token_end, char_end):
                    raise ValueError(f"the turns of conversation {conv} do not follow each other")
                loss = text if loss is None else loss
                n, token_end, char_end = n + 1, token_to, char_to
                turns.update(f"{role}\n{text}\n".encode())
                if b > a:
                    loss_chars, masked = loss_chars + len(loss), masked + b - a
                    loss_sha.update(loss.encode())
                    mask.update(f"{a}-{b};".encode())
            if len(held) > 2000:
                yield batch()
                held = []
        if turns is not None:
            held.append(row())
        if held:
            yield batch()

    ordered = back.repartition("conv_id").sortWithinPartitions("conv_id", "token_from")
    longs = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return ordered.mapInArrow(digest, f"conv_id {id_type}, {longs}")
