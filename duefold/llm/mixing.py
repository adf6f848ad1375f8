"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected target / size of the source times. The expected
copies are added up along the documents, one random offset is added, and a document is
taken once for each whole number that the sum crosses. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duefold.llm.common import column, written

#: Expected copies are whole multiples of 2^-FRACTION, so that prefix sums are exact.
FRACTION = 24
ROWS_PER_CELL = 1_000_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    return F.when(F.coalesce(bare, F.lit("")) == "", 0).otherwise(words).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int], share: tuple[int, int], most: int
) -> DataFrame:
    """Targets of sources, from (source, source_size): one row per source.

    Weights repeat along the sources by code point, null last. A target is the smaller of ``most``
    times the source's size and weight times a common level; the level is the one at which targets
    add up to ``share`` of all sizes. It is found from running sums along the sources by the level that
    fills them up, which gives what resharing the excess again and again converges to.
    """
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(int(w)) for w in weights]),
            F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1,
                   F.lit(len(weights))) + 1,
        ).cast("long"),
    )
    up, down = share
    whole = W.partitionBy()
    filled = W.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(W.unboundedPreceding, -1)
    steps = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * up).alias("wanted"),
        F.coalesce(F.sum(F.col("source_size") * most).over(filled), F.lit(0)).alias("capped"),
        (
            F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
        ).alias("open_weight"),
    ).select(
        "*",
        (F.col("wanted") - F.col("capped") * down).alias("left"),
        (F.col("open_weight") * down).alias("parts"),
    )
    # The first source, by filling level, that the common level does not fill up gives the level.
    fits = F.col("left") * F.col("weight") <= F.col("parts") * F.col("source_size") * most
    by_filling = F.struct(
        F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")
    )
    capped = (F.col("source_size") * most).cast("double")
    shared = (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.parts").cast(
        "double"
    )
    return steps.withColumn(
        "level", F.min_by(F.struct("left", "parts"), F.when(fits, by_filling)).over(whole)
    ).select(
        "source",
        "source_size",
        F.coalesce(F.least(capped, shared), capped).alias("target"),
    )


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _source_key(source: Column) -> Column:
    """A key without nulls: the null source is the empty text, others start with a plus."""
    return F.coalesce(F.concat(F.lit("+"), source), F.lit(""))


def _band(size: Column) -> Column:
    """The size to five binary digits, as a number that rises with it."""
    shift = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    top = size
    for step in (16, 8, 4, 2, 1):
        top = F.when(shift.bitwiseAND(step) != 0, F.shiftright(top, step)).otherwise(top)
    return (shift * 32 + top).cast("long")


def _cell(doc_id: Column, source: Column, size: Column, salts: int) -> list[Column]:
    """Size and cell of a document: source, band of sizes, and a salt.

    The size is bound once, for counting words is dear and the band uses it often.
    """
    sized = F.transform(
        F.array(size), lambda s: F.struct(s.alias("size"), _band(s).alias("band"))
    )
    salt = F.pmod(_hex_number(F.coalesce(doc_id.cast("string"), F.lit("")), 8), F.lit(salts))
    return [
        _source_key(source).alias("source_key"),
        F.inline(sized),
        salt.alias("salt"),
    ]


def mixing_plan(
    sizes: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: int = 7,
) -> tuple[DataFrame, int]:
    """(one row per cell, number of salts) from a stored frame of (doc_id, source, size).

    A cell knows how many documents of its source come before it, and its source's size, target,
    rate (expected copies in 2^-FRACTION) and random offset. Cells are some hundreds per source and
    salt. Salts grow with the rows, so that neither a hot source nor a group of copies of one text
    meets in one task. The table of sources is the only thing that is ordered as a whole.
    """
    salts = max(16, -(-sizes.count() // ROWS_PER_CELL))
    cells = (
        sizes.select("source", *_cell(F.col("doc_id"), F.col("source"), F.col("size"), salts))
        .groupBy("source_key", "band", "salt")
        .agg(F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words"))
    )
    sources = cells.groupBy("source_key").agg(
        F.first("source").alias("source"), F.sum("words").alias("source_size")
    )
    rate = F.when(F.col("source_size") == 0, 0).otherwise(
        F.floor(F.col("target") / F.col("source_size") * float(1 << FRACTION))
    )
    targets = source_targets(sources.drop("source_key"), weights, share, most).select(
        _source_key(F.col("source")).alias("source_key"),
        "source_size",
        "target",
        rate.cast("long").alias("rate"),
        _hex_number(F.concat(F.lit(f"{seed}:"), _source_key(F.col("source"))), FRACTION // 4).alias(
            "offset"
        ),
    )
    before = W.partitionBy("source_key").orderBy("band", "salt").rowsBetween(
        W.unboundedPreceding, -1
    )
    return (
        cells.select(
            "source_key", "band", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
        ).join(targets, "source_key"),
        salts,
    )


def with_copies(docs: DataFrame, plan: tuple[DataFrame, int], size: Column) -> DataFrame:
    """(doc, size, source_size, target, copies): ``doc`` is the whole row of ``docs``.

    Documents are ordered by cell, and within it by size and id, so that the copies spread over
    all sizes. Rows are shuffled once, with their columns.
    """
    cells, salts = plan
    rows = docs.select(
        F.struct("*").alias("doc"), *_cell(F.col("doc_id"), F.col("source"), size, salts)
    )
    within = W.partitionBy("source_key", "band", "salt").orderBy(
        "size", F.col("doc.doc_id").asc_nulls_first()
    )
    upto = (F.col("start") + F.col("at")) * F.col("rate") + F.col("offset")
    return (
        rows.withColumn("at", F.row_number().over(within))
        .join(cells, ["source_key", "band", "salt"])
        .select(
            "doc",
            "size",
            "source_size",
            "target",
            (F.shiftright(upto, FRACTION) - F.shiftright(upto - F.col("rate"), FRACTION)).alias(
                "copies"
            ),
        )
    )


def _sizes(docs: DataFrame) -> DataFrame:
    return written(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes"
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    The null source is a source of its own. A source without words has target 0, and
    its documents are not taken. Null and empty texts have size 0. Null ids and repeated rows are rows
    like any other. With ``most`` = 2 no document is taken more than twice. An empty table
    returns no rows. Extra columns are ignored.
    """
    sizes = _sizes(docs)
    return with_copies(sizes, mixing_plan(sizes, **options), F.col("size")).select(
        "doc.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    taken = with_copies(docs, mixing_plan(_sizes(docs), **options), word_count(F.col("text")))
    return (
        taken.where("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .select("doc.*")
    )
