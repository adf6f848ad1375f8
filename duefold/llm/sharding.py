"""Shards by a hierarchical weighted hash tree.

A document's key descends region, rack and shard. At each level every child draws
-ln(u) / weight, u being a uniform hash of (key, child), and the smallest draw wins, so a child gets
a share in proportion to its weight. A draw depends on that child alone: if a weight grows, keys
move into that child only, and subtrees whose weights stay keep their keys in place. A shard is added
as a region of its own, so every moved row goes to the new shard.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duefold.llm.common import column, written

#: Region -> rack -> shard number -> weight.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]

ROWS_PER_CELL = 100_000


def even_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """Shards 0, 1, ... of weight 1."""
    return {
        f"region{a}": {
            f"rack{b}": {(a * racks + b) * shards + c: 1.0 for c in range(shards)}
            for b in range(racks)
        }
        for a in range(regions)
    }


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own."""
    shards = [s for racks in tree.values() for rack in racks.values() for s in rack]
    return {**tree, f"region{len(tree)}": {"rack0": {max(shards) + 1: weight}}}


def _draw(key: Column, child: str, weight: float) -> Column:
    """The child's draw for a key; 52 bits of a hash, never 0 or 1."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 12)
    uniform = (bits.cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / F.lit(float(weight))


def _descend(key: Column, path: str, node, level: int) -> Column:
    """The shard below a node: the child with the smallest draw, then on from there."""
    if level == 3:
        return F.lit(int(node))
    children = [
        (f"{path}/{name}", below if level < 2 else name, _weight(below))
        for name, below in node.items()
        if _weight(below) > 0
    ]
    if len(children) == 1:
        return _descend(key, children[0][0], children[0][1], level + 1)
    best = F.least(*[_draw(key, child, weight) for child, _, weight in children])
    chosen = F.lit(None).cast("int")
    for child, below, weight in children:
        chosen = F.when(
            _draw(key, child, weight) == best, _descend(key, child, below, level + 1)
        ).otherwise(chosen)
    return chosen


def _weight(below) -> float:
    return sum(map(_weight, below.values())) if isinstance(below, Mapping) else float(below)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a key (a string; null counts as empty)."""
    return _descend(F.coalesce(key.cast("string"), F.lit("")), "", tree, 0)


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, without bringing a shard into one task.

    Rows are ranked within cells of a shard, by a hash of ``order``, and a cell starts where the
    ones before it end. The number of cells grows with the rows, so a cell stays small.
    """
    cells = max(16, -(-rows.count() // ROWS_PER_CELL))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64(*order), F.lit(cells)))
    sizes = rows.groupBy(shard, "cell").agg(F.count("*").alias("n"))
    before = W.partitionBy(shard).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        shard, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    within = W.partitionBy(shard, "cell").orderBy(*order)
    return (
        rows.withColumn("at", F.row_number().over(within))
        .join(starts, [shard, "cell"])
        .withColumn("slot", F.col("start") + F.col("at") - 1)
        .drop("cell", "at", "start")
    )


def shard_documents(
    docs: DataFrame,
    tree: Tree | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the tree decide, copies of a text included. A null id counts as an empty
    key. Rows that repeat an id share its shard and take slots in the order of their size
    and checksum. A null text has size 1 and the checksum of an empty one. Other columns are
    ignored; texts never leave the scan.
    """
    tree = tree or even_tree()
    utf8 = F.coalesce(column(text_column), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            column(id_column).alias("doc_id"),
            (F.octet_length(utf8) + 1).cast("long").alias("size"),
            F.crc32(utf8).alias("text_crc32"),
        )
        .withColumn("shard", shard_of(F.col("doc_id"), tree))
        .withColumn("grown_shard", shard_of(F.col("doc_id"), grown(tree))),
        "shards",
    )
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select(
        F.col("doc_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
