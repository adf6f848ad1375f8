"""One document of each group of near copies: SimHash search, then exact similarity.

Search. Each text has ``PRINTS`` SimHash fingerprints of its single words, which light edits hardly move,
and one of word pairs, by which texts of one language that merely use the same words differ. Two
documents meet if a word fingerprint differs in at most three bits, found by the Golay keys of ``simhash``, and the
pair fingerprints in at most ``WIDE``. Documents that meet any other are members; all else stays.

Check. Members are compared as sets of hashed five-word shingles, made once and stored. Sets alike by
``similarity`` t share one of the |S| - ceil(t |S|) + 1 rarest shingles of each, whatever the order of rarity, so
members are listed under those only, and members under one shingle are a class. In a class all meet its
centre, the member whose shingles most others have; a group of edited copies is linked to its
original at once. Members that stay apart become centres in later rounds until every class is
connected or all members outside the part of its centre have been one. Pairs whose sizes, pair fingerprints,
numbers of rarer shingles or hash tables rule out the bound are never compared. Pairs are compared in tiles of
some ``TILE`` shingles, so a set is sent to few tasks however many pairs it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duefold.llm.common import connected, long_array, new_path, stored, text_slices, without, written
from duefold.llm.simhash import fingerprint, fuzzy_keys, rehashed, shingle_hashes

PRINTS = 5
WIDE = 14
WORDS = 5
SIMILARITY = 0.8
#: Documents that a block of one key holds on average at most, unless the key has more than ``BLOCKS`` such blocks.
BLOCK = 4096
#: Blocks of a key, while these hold no more than ``MOST_BLOCK`` documents.
BLOCKS = 16
MOST_BLOCK = 1 << 15
#: Documents of a key that are compared all at once, at most.
SMALL = 192
#: Documents of one fingerprint that are compared with each other under one key alone, at least.
CROWD = 64
#: Pairs whose fingerprints are compared at once.
PAIRS = 1 << 18
#: What of a key is not the number of its fingerprint.
KEY_BITS = (1 << 30) - 1
#: Words of 64 bits of the hash table that rules out unlike sets before they are compared.
MARKS = 8
MARK = [f"mark{k}" for k in range(MARKS)]
#: Shingles of the sets of a tile, on average.
TILE = 1 << 17
#: By so much the centres of a class grow with every round.
GROWTH = 8


def prints_of(text: bytes) -> tuple[int, list[int]]:
    """(pair fingerprint, word fingerprints)."""
    single = shingle_hashes(text, 1)
    return fingerprint(shingle_hashes(text, 2)), [fingerprint(rehashed(single, k)) for k in range(PRINTS)]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide, single = [], []
        for _, texts in text_slices(batch.column(2)):
            for text in texts:
                pair, own = prints_of(text)
                wide.append(pair)
                single.append(own)
        flat = long_array(np.array(single, np.uint64).reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), long_array(np.array(wide, np.uint64)),
                pa.FixedSizeListArray.from_arrays(flat, PRINTS).cast(pa.list_(pa.int64())),
            ],
            ["id", "digest", "wide", "prints"],
        )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, wide = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        prints = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, PRINTS)
        for salt in range(PRINTS):
            fps = np.ascontiguousarray(prints[:, salt])
            at, keys = fuzzy_keys(fps)
            keys |= salt << 30
            for k in range(0, len(at), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[part]), long_array(fps[at[part]]),
                        pa.array(wide[at[part]]), pa.array(nodes[at[part]]),
                    ],
                    ["key", "fp", "wide", "node"],
                )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lo, hi) and the lists own, fp, wide, node of two blocks of the key -> (node): who has another near.

    Lists are of numbers and stay so; none becomes Python objects.
    """
    for batch in batches:
        offsets = batch.column(3).offsets.to_numpy()
        own, fps, wides, nodes = (batch.column(k).flatten().to_numpy() for k in range(3, 7))
        fps, wides = fps.view(np.uint64), wides.view(np.uint64)
        offsets = offsets - offsets[0] if len(offsets) else offsets
        met = np.zeros(len(fps), bool)
        for k, (key, lo, hi) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            part = slice(offsets[k], offsets[k + 1])
            met[part] = near_others(fps[part], wides[part], key, None if lo == hi else own[part] == lo)
        found = np.unique(nodes[met])
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["node"])


def near_others(fps: np.ndarray, wides: np.ndarray, key: int, first: np.ndarray | None = None) -> np.ndarray:
    """Which documents of ``key`` have another near; only pairs with one of ``first`` and one of the rest, if given.

    Equal fingerprints have all keys in common. Where many documents have one, these are compared with each other
    under its lowest key alone. Who has met another need not look for more, but is there for others to meet.
    """
    if first is None and len(fps) <= SMALL:
        # Most keys are small: no more than needed for each.
        near = np.bitwise_count(wides[:, None] ^ wides) <= WIDE
        if np.count_nonzero(near) > len(fps):
            near &= np.bitwise_count(fps[:, None] ^ fps) <= 3
        return near.sum(axis=1) > 1
    met, asked = np.zeros(len(fps), bool), np.zeros(len(fps), bool)
    values, runs, copies = np.unique(fps, return_inverse=True, return_counts=True)
    crowds = [r for r in np.flatnonzero(copies >= CROWD) if fuzzy_keys(values[r : r + 1])[1].min() != key & KEY_BITS]
    crowded = np.isin(runs, crowds)
    for side in [None] if first is None else [first, ~first]:
        for mine, others in [(~crowded, None), *((runs == r, runs != r) for r in crowds)]:
            if side is not None:
                mine, others = mine & side, ~side if others is None else others & ~side
            while len(rows := np.flatnonzero(mine & ~asked & ~met)):
                # Who has asked before has met these or is not near.
                columns = np.flatnonzero(~asked if others is None else others & ~asked)
                if not len(columns):
                    break
                rows = rows[: max(1, PAIRS // len(columns))]
                asked[rows] = True
                spots = np.flatnonzero(np.bitwise_count(wides[rows, None] ^ wides[None, columns]) <= WIDE)
                a, b = rows[spots // len(columns)], columns[spots % len(columns)]
                near = (a != b) & (np.bitwise_count(fps[a] ^ fps[b]) <= 3)
                met[a[near]] = met[b[near]] = True
    return met


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_nodes(prints: DataFrame) -> DataFrame:
    """(node): the documents of ``prints`` (node, wide, prints) that meet another one."""
    keyed = stored(
        prints.select("node", "wide", "prints").mapInArrow(
            _keyed, "key long, fp long, wide long, node long"
        ),
        "keys",
    )
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    # A large key is dealt into blocks and every two meet. Its blocks grow with it up to a bound, so that a document
    # is sent to few pairs of blocks however many share the key.
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(MOST_BLOCK), F.col("n") / BLOCKS))
    blocks = F.ceil(F.col("n") / size).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (
        keyed.join(sizes, "key")
        .select(
            "key", "fp", "wide", "node", own.alias("own"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
        )
        .groupBy("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
        .agg(F.collect_list(F.struct("own", "fp", "wide", "node")).alias("members"))
    )
    # Most keys hold two documents; those that are not near never reach Python.
    one, two = F.element_at("members", 1), F.element_at("members", 2)
    near = (_apart(one["fp"], two["fp"]) <= 3) & (_apart(one["wide"], two["wide"]) <= WIDE)
    dealt = dealt.where((F.size("members") > 2) | ((F.size("members") == 2) & near))
    met = dealt.select(
        "key", "lo", "hi", "members.own", "members.fp", "members.wide", "members.node"
    ).mapInArrow(_met, "node long")
    return stored(met.distinct(), "met")


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(2)):
                # Texts without words are alike: they have one shingle, that of nothing.
                sets = [
                    np.unique(found).view(np.int64) if len(found := shingle_hashes(t, words)) else [0]
                    for t in texts
                ]
                part = slice(first, first + len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(sets, pa.list_(pa.int64()))],
                    ["node", "wide", "hashes"],
                )

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes) -> (node, bits): which of the bits of a hash table an odd number of hashes falls on."""
    for batch in batches:
        hashes = batch.column(1)
        sizes = np.diff(hashes.offsets.to_numpy())
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = (hashes.flatten().to_numpy().view(np.uint64) >> np.uint64(40)).astype(np.int64) % (64 * MARKS)
        odd = np.bincount(rows * 64 * MARKS + at, minlength=len(sizes) * 64 * MARKS) & 1
        bits = np.packbits(odd.astype(np.uint8).reshape(-1, 64 * MARKS), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(MARKS))],
            ["node", *MARK],
        )


def listed(sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, node, wide, n, common, at, marks): each set under its rarest shingles that others have.

    ``at`` is how many shingles of the set are rarer, ``common`` how many sets have one of its shingles, on average.
    """
    each = sets.select("node", F.explode("hashes").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        each.join(held, "shingle")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    )
    n = F.size("hashes")
    # Shingles that no other set has come first in the order of rarity.
    alone = n - F.size("shared")
    needed = n - F.ceil(n * F.lit(similarity) - 1e-9) + 1 - alone
    common = F.aggregate("shared", F.lit(0).cast("long"), lambda t, x: t + x["df"]) / n
    marks = sets.select("node", "hashes").mapInArrow(_marks, "node long, " + ", ".join(f"{m} long" for m in MARK))
    return (
        sets.join(ranked, "node")
        .select(
            "node", "wide", n.alias("n"), common.alias("common"), alone.alias("alone"), "shared",
            needed.cast("int").alias("needed"),
        )
        .where("needed > 0")
        .join(marks, "node")
        .select(
            "node", "wide", "n", "common", "alone", *MARK,
            F.posexplode(F.slice("shared", F.lit(1), F.col("needed"))).alias("k", "entry"),
        )
        .select(
            F.col("entry.shingle").alias("shingle"), "node", "wide", "n", "common",
            (F.col("alone") + F.col("k")).alias("at"), *MARK,
        )
    )


def _can_be_alike(similarity: float) -> Column:
    """What two sets of the bound's similarity fulfil under the rarest shingle that both have."""
    size, n, m = F.col("n") + F.col("head_n"), F.col("n"), F.col("head_n")
    close = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    # Neither has a shared shingle before this one, so no more than the rest can be shared.
    rest = F.least(n - F.col("at"), m - F.col("head_at")) >= similarity / (1 + similarity) * size - 1e-9
    # Each odd bit that only one has stands for at least one shingle that only one has.
    apart = sum((_apart(F.col(m), F.col(f"head_{m}")) for m in MARK), F.lit(0))
    return (
        close
        & rest
        & (_apart(F.col("wide"), F.col("head_wide")) <= WIDE)
        & (apart <= (1 - similarity) / (1 + similarity) * size + 1e-9)
    )


def tiles_of(classes: DataFrame) -> DataFrame:
    """(node, tile): members of large classes side by side, some ``TILE`` shingles to a tile."""
    homes = written(
        classes.groupBy("node").agg(
            F.max(F.struct("size", "centre")).getField("centre").alias("home"), F.max("n").alias("n")
        ),
        "homes",
    )
    parts = homes.groupBy("home").agg(F.ceil(F.sum("n") / TILE).alias("parts"))
    tile = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
    return written(homes.join(parts, "home").select("node", tile.alias("tile")), "tiles")


def _compared(similarity: float):
    def run(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        if not len(pairs) or not len(sets):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sizes = np.array([len(h) for h in sets["hashes"]])
        values, ids = np.unique(np.concatenate(list(sets["hashes"])), return_inverse=True)
        at = dict(zip(sets["node"], np.split(ids, np.cumsum(sizes)[:-1])))
        has, kept = np.zeros(len(values), bool), []
        for a, others in pairs.groupby("a")["b"]:
            has[at[a]] = True
            for b in others:
                both = np.count_nonzero(has[at[b]])
                if both >= similarity * (len(at[a]) + len(at[b]) - both) - 1e-9:
                    kept.append((a, b))
            has[at[a]] = False
        return pd.DataFrame(kept, columns=["a", "b"], dtype="int64")

    return run


def alike(pairs: DataFrame, sets: DataFrame, tiles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``similarity``.

    Pairs meet by the tiles of both ends, so a set is sent once to a pair of tiles, not to every pair of its own.
    """
    by_a, by_b = (tiles.select(F.col("node").alias(x), F.col("tile").alias(f"t{x}")) for x in "ab")
    tiled = written(pairs.join(by_a, "a").join(by_b, "b").select("ta", "tb", "a", "b"), "tiled")
    ends = tiled.select(
        F.col("ta").alias("sa"), F.col("tb").alias("sb"), F.explode(F.array("a", "b")).alias("node")
    ).distinct()
    held = ends.join(sets.select("node", "hashes"), "node")
    return (
        tiled.groupBy("ta", "tb")
        .cogroup(held.groupBy("sa", "sb"))
        .applyInPandas(_compared(similarity), "a long, b long")
    )


def links_of(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what all alike pairs of ``sets`` (node, wide, hashes) connect.

    Pairs whose fingerprints ``wide`` are more than ``WIDE`` bits apart do not count.
    """
    return linked(sets, similarity)[0]


def linked(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(``links_of``, what they connect as (node, component))."""
    spark = sets.sparkSession
    rows = stored(listed(sets, similarity), "listed")
    centres = rows.groupBy("shingle").agg(
        F.max(F.struct("common", F.negative("node").alias("last"))).alias("c"), F.count("*").alias("size")
    )
    centres = centres.where("size > 1").select("shingle", "size", F.negative("c.last").alias("centre"))
    waiting = classes = stored(rows.join(centres, "shingle"), "classes")
    tiles = tiles_of(classes)
    tried = new_path(spark, "tried-pairs")
    # Rows made by the JVM; an empty list would start Python workers of another kind on every executor.
    links = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    links.write.parquet(tried)
    parts = links.toDF("node", "component")
    heads = classes.where("node = centre").select("shingle", "node")
    waiting = waiting.withColumns({"part": F.col("node"), "main": F.col("centre")})
    most = 1
    while not heads.isEmpty():
        asked = heads.join(waiting, ["shingle", "node"]).select(
            "shingle",
            *(F.col(c).alias(f"head_{c}") for c in ("node", "wide", "n", "at", "part", *MARK)),
        )
        pairs = written(
            waiting.join(asked, "shingle")
            .where(F.col("part") != F.col("head_part"))
            .where(_can_be_alike(similarity))
            .select(F.greatest("node", "head_node").alias("a"), F.least("node", "head_node").alias("b"))
            .distinct()
            .join(spark.read.parquet(tried), ["a", "b"], "left_anti"),
            "candidates",
        )
        fresh = stored(alike(pairs, sets, tiles, similarity), "links")
        pairs.write.mode("append").parquet(tried)
        if not fresh.isEmpty():
            # Components of earlier rounds stand for the links that made them.
            links, parts = links.unionByName(fresh), connected(parts.toDF("a", "b").unionByName(fresh))
        mine = parts.select("node", F.col("component").alias("part"))
        # Who has been a head has met all of its class. A class is done when the others belong to its centre.
        now = stored(
            waiting.drop("part", "main")
            .join(heads, ["shingle", "node"], "left_anti")
            .join(mine, "node", "left")
            .join(mine.select(F.col("node").alias("centre"), F.col("part").alias("main")), "centre", "left")
            .withColumns({"part": F.coalesce("part", "node"), "main": F.coalesce("main", "centre")}),
            "members-now",
        )
        apart = now.where("part != main")
        most *= GROWTH
        heads = written(
            apart.groupBy("shingle", F.pmod(F.xxhash64("node"), F.lit(most)))
            .agg(F.max(F.struct("common", F.negative("node").alias("last"))).alias("c"))
            .select("shingle", F.negative("c.last").alias("node")),
            "centres",
        )
        waiting = stored(now.join(apart.select("shingle").distinct(), "shingle", "left_semi"), "waiting")
    return links, parts


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are no near copy of a row with a smaller id, with their columns.

    A link needs a meeting of both documents with any others in the search, and a Jaccard similarity of at
    least ``similarity`` over shingles of ``words`` words. Of a group that links connect the smallest id
    stays, with all rows that repeat it and its text.

    * Different texts under one id are documents of their own, each judged by itself; if they are near
      copies one of them stays.
    * A null text counts as empty; texts without words are alike. Texts with fewer than ``words`` words are
      one shingle. Rows with a null id stay, for nothing tells them apart.
    * Texts of any length are taken whole. An empty table gives no rows; extra columns are kept.
    """
    id_, digest = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(id_.alias("id"), digest.alias("digest"), "text").where("id IS NOT NULL")
    prints = written(
        rows.mapInArrow(_prints, "id long, digest long, wide long, prints array<long>")
        .dropDuplicates(["id", "digest"])
        .select(F.monotonically_increasing_id().alias("node"), "*"),
        "prints",
    )
    members = written(
        prints.join(near_nodes(prints), "node").select("node", "id", "digest", "wide"), "members"
    )
    texts = (
        rows.join(members.hint("merge"), ["id", "digest"])
        # The join has dealt rows by these already.
        .dropDuplicates(["id", "digest"])
        .select("node", "wide", "text")
        .mapInArrow(_sets(words), "node long, wide long, hashes array<long>")
    )
    sets = stored(texts, "sets")
    _, parts = linked(sets, similarity)
    parts = parts.unionByName(parts.select(F.col("component").alias("node"), "component")).distinct()
    named = written(parts.join(members.select("node", "id", "digest"), "node"), "near-copies")
    first = named.groupBy("component").agg(F.min(F.struct("id", "digest")).alias("first"))
    gone = named.join(first, "component").where(
        (F.col("id") != F.col("first.id")) | (F.col("digest") != F.col("first.digest"))
    )
    gone = written(gone.select("id", "digest"), "gone")
    held = docs.select(F.struct("*").alias("doc"), id_.alias("id"), digest.alias("digest"))
    return without(held, gone, ["id", "digest"]).select("doc.*")
