"""Exact deduplication by deterministic block naming.

A normalised text is cut into fixed-size blocks. Distinct blocks are sorted into integer names; then adjacent names are
paired, distinct pairs sorted into names again, and so on until each document is one name. Two documents get one
(level, name) exactly if their normalised texts are equal: naming is injective at every level.

The block texts cross the network once, as distinct blocks after a map-side combine. Occurrences find their block's name
by a 128-bit key; the distinct blocks themselves prove that each key stands for one block, and where one does not the
join is made on the block text instead. A third of all rows in one group only meets map-side combined aggregates and
splittable joins.

Cases: null text counts as empty; all empty texts are one group. A null doc_id loses ties. Repeated rows are separate
rows of one group, of which one stays. Texts of any length are read whole, as many blocks. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

BLOCK = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def block_keys(block: Column) -> list[Column]:
    """128 bits that stand for a block in shuffles; whether they do is checked against the blocks."""
    return [F.xxhash64(block), F.xxhash64(F.lit("block"), block)]


def _blocks(norm: Column, size: int) -> Column:
    parts = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(parts)


def _named(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows, sorted within their partition, numbered: equal rows share one integer, others never do."""
    return rows.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keys: Callable[[Column], list[Column]] = block_keys, rid: Column | None = None) -> DataFrame:
    """One row per document: rid (of the row; numbered here if not given), doc_id, chars (code points), text_sha256, level and name (its identity)."""
    rid = F.monotonically_increasing_id() if rid is None else rid
    base = docs.select(rid.alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("norm", normalised(F.col("text")))
    distinct = _named(base.select(F.explode(_blocks(F.col("norm"), block)).alias("block")), ["block"])
    n_keys = len(keys(F.lit("")))
    on = [f"k{i}" for i in range(n_keys)]
    names = materialize(distinct.select(*[k.alias(c) for c, k in zip(on, keys(F.col("block")), strict=True)], "name"), "block-names")
    whole = not names.groupBy(*on).count().filter("count > 1").isEmpty()
    if whole:  # some key stands for two blocks: name by the blocks themselves
        discard(names)
        names, on = materialize(distinct, "block-names"), ["block"]

    occ = base.select(
        "rid", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.sha2(F.col("norm"), 256).alias("text_sha256"), _blocks(F.col("norm"), block).alias("blocks")
    )
    first = F.col("pos") == 0
    occ = occ.select("rid", "doc_id", "chars", "text_sha256", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    occ = occ.select("rid", "pos", "n", *[F.when(first, F.col(c)).alias(c) for c in ("doc_id", "chars", "text_sha256")], *([k.alias(c) for c, k in zip(on, keys(F.col("block")), strict=True)] if not whole else ["block"]))
    named = materialize(occ.join(names, on).drop(*on), "blocks")
    discard(names)

    meta = ["rid", "doc_id", "chars", "text_sha256"]
    done = [named.filter("n = 1").select(*meta, F.lit(0).alias("level"), "name")]
    cur = named.filter("n > 1").select("rid", "pos", "n", "name")
    longest, level, old = named.agg(F.max("n")).first()[0] or 1, 0, None
    heads = named.filter("n > 1 AND pos = 0").select(*meta)
    while longest > 1:
        half = F.col("pos").bitwiseAND(1)
        pairs = cur.groupBy("rid", (F.col("pos") / 2).cast("int").alias("half"), "n").agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        # the pair names are read once here and once by the next level, so each level ends in a written table
        pairs = materialize(pairs, "pairs")
        names = materialize(_named(pairs, ["a", "b"]), "pair-names")
        new = materialize(pairs.join(names, ["a", "b"]).select("rid", F.col("half").alias("pos"), F.expr("cast((n + 1) / 2 as int)").alias("n"), "name"), "level")
        for t in [pairs, names, *([old] if old is not None and level > 1 else [])]:
            discard(t)
        longest, level, old = (longest + 1) // 2, level + 1, new
        ended = new.filter("n = 1").select("rid", F.lit(level).alias("level"), "name")
        done.append(materialize(heads.join(ended, "rid").select(*meta, "level", "name"), "ended"))
        cur = new.filter("n > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _judged(ident: DataFrame) -> DataFrame:
    """The rows of identities() with keep_id, group_size and kept."""
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))).alias("best")
    groups = ident.groupBy("level", "name").agg(F.count(F.lit(1)).alias("size"), best).filter("size > 1")
    groups = materialize(groups.select("level", "name", "size", F.col("best.d").alias("keep"), F.col("best.r").alias("keep_rid")), "groups")
    out = ident.join(groups, ["level", "name"], "left")
    alone = F.col("size").isNull()
    return out.select(
        "rid",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"),
        "text_sha256",
        "chars",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keys: Callable[[Column], list[Column]] = block_keys) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chars.

    Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id.
    """
    return _judged(identities(docs, id_col, text_col, block, keys)).drop("rid")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: the rows are numbered and written once, so that those that stay are found by their number."""
    rid = "_gl_rid"
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    kept = _judged(identities(rows, id_col, text_col, rid=F.col(rid))).filter("kept").select(F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").select(*docs.columns)
