"""Sharding by k-d tree partitioning: splits at distributed weighted medians along the widest metadata dimension (operator 3)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, parts_for

SHARDS = 24
#: Bits of a dimension's values and of the tie-break behind them; together a position on the axis.
VALUE_BITS, TIE_BITS = 20, 42
#: Bits by which one pass narrows a cut; a pass brings at most SHARDS * 2 ** PASS_BITS sums to the driver.
PASS_BITS = 10
#: A cut is exact enough when the bin that it falls into has less than this share of a shard's bytes.
CUT_SHARE = 1 / 2048
SLOT_ROWS = 20_000
#: The metadata that a box can be wide in; the id only where it is wide in none of them.
DIMENSIONS, LAST = ("by_lang", "by_source", "by_size", "by_length"), "by_id"


@dataclass
class Node:
    """A box of the tree: its first shard, the shards that it is to become, and how its next cut is being narrowed."""

    first: int
    shards: int
    total: int = 0
    dim: str = ""
    low: int = 0
    width: int = VALUE_BITS + TIE_BITS
    below: int = 0
    goal: float = 0.0
    done: bool = False


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as numbers below 2 ** VALUE_BITS and a tie-break; the text is read once."""
    top = 1 << VALUE_BITS
    text = docs["text"].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    spread = lambda c: F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(top))
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        spread(docs["lang"]).alias("by_lang"),
        spread(docs["source"]).alias("by_source"),
        F.least(F.lit(top - 1), F.floor(F.log2(size.cast("double")) / 40 * top)).cast("long").alias("by_size"),
        F.least(F.lit(top - 1), F.floor(F.log2(F.coalesce(F.char_length(text), F.lit(0)) + 1.0) / 40 * top)).cast("long").alias("by_length"),
        spread(docs["doc_id"]).alias("by_id"),
        F.pmod(F.xxhash64(F.lit("tie"), docs["doc_id"], F.crc32(F.coalesce(text, F.lit("")).cast("binary"))), F.lit(1 << TIE_BITS)).alias("tie"),
    )


def _case(node: Column, values: dict[int, Column]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(node == k, v).otherwise(out)
    return out


def _position(dim: str) -> Column:
    return F.shiftleft(F.col(dim), TIE_BITS) + F.col("tie")


def _cuts(rows: DataFrame, open_nodes: dict[int, Node], total: int, shards: int) -> None:
    """Narrow each open node's interval until its weighted median is known; every pass sums bytes by node and bin."""
    while busy := {k: n for k, n in open_nodes.items() if not n.done}:
        node = F.col("node")
        shift = {k: max(n.width - PASS_BITS, 0) for k, n in busy.items()}
        inside = _case(node, {k: (_position(n.dim) >= n.low) & (_position(n.dim) < n.low + (1 << n.width)) for k, n in busy.items()})
        bins = _case(node, {k: F.shiftright(_position(n.dim) - F.lit(n.low), shift[k]) for k, n in busy.items()})
        sums = rows.where(F.coalesce(inside, F.lit(False))).groupBy("node", bins.alias("bin")).agg(F.sum("size").alias("bytes"))
        found: dict[int, list[tuple[int, int]]] = {}
        for r in sums.collect():
            found.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for k, n in busy.items():
            run = n.below
            for b, size in sorted(found.get(k, [])):
                if run + size >= n.goal:
                    break
                run += size
            else:
                n.done = True  # nothing left to narrow
                n.low += 1 << n.width
                continue
            at = n.low + (b << shift[k])
            if size <= total / shards * CUT_SHARE or shift[k] == 0 or size <= 8:
                n.low = at if n.goal - run < run + size - n.goal else at + (1 << shift[k])
                n.done = True
            else:
                n.low, n.width, n.below = at, shift[k], run


def tree(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """metadata() with `shard`: a box that is to become k shards is cut in floor(k / 2) and the rest, at that share of its
    bytes, along the dimension in which it is widest, measured by the whole table's width in it (ties: the first); equal values
    of the dimension are cut by the tie-break."""
    nodes = {0: Node(0, shards)}
    rows = rows.withColumn("node", F.lit(0))
    whole = rows.agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).first()
    total = whole["bytes"] or 0
    while any(n.shards > 1 for n in nodes.values()) and total:
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()}
        cut = {}
        for k, n in nodes.items():
            if n.shards > 1 and k in stats:
                width = {d: stats[k][d] / max(whole[d], 1) for d in DIMENSIONS}
                widest = max(width, key=width.get) if any(width.values()) else LAST
                cut[k] = Node(n.first, n.shards, stats[k]["bytes"], widest, goal=stats[k]["bytes"] * (n.shards // 2) / n.shards)
        _cuts(rows, cut, total, shards)
        # a node is named by its first shard, so the left part keeps the name
        right = {k: F.when(_position(n.dim) >= F.lit(n.low), F.lit(k + n.shards // 2)).otherwise(F.lit(k)) for k, n in cut.items()}
        rows = durable(rows.withColumn("node", F.coalesce(_case(F.col("node"), right), F.col("node")).cast("int")))
        halves = {}
        for k, n in nodes.items():
            if n.shards > 1:
                halves[k], halves[k + n.shards // 2] = Node(k, n.shards // 2), Node(k + n.shards // 2, n.shards - n.shards // 2)
            else:
                halves[k] = n
        nodes = halves
    return rows.withColumnRenamed("node", "shard")


def with_slots(rows: DataFrame, total: int, shards: int = SHARDS) -> DataFrame:
    """rows with `slot`, gapless from 0 in each shard: numbered in chunks of about SLOT_ROWS rows, with the chunks' offsets."""
    chunks = parts_for(total // shards, SLOT_ROWS, 1)
    rows = rows.withColumn("chunk", F.pmod(F.shiftright(F.xxhash64("doc_id", "text_crc32", "size"), 8), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("inner", inner).join(offsets, ["shard", "chunk"]).withColumn("slot", F.col("offset") + F.col("inner") - 1)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents in shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The size is the text's bytes in UTF-8 plus 8 (null text: 8). Dimensions are language, source, size and length in
    code points, and the id where a box is wide in none of them; a null lang or source counts as an empty one. Copies of a text or rows of a hot source are cut by a hash of id and text, so no
    group outgrows a shard; repeated rows with one doc_id and text stay together. A shard may stay empty when there are
    fewer documents than shards; an empty table gives no rows; other columns are ignored.
    """
    rows = durable(metadata(docs))
    out = with_slots(tree(rows, shards), rows.count(), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
