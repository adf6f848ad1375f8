"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprints of 64 bits are cut into four segments of 16. If two differ in at most three bits,
then some segment agrees and the next one (the first follows the last) differs in at most one bit:
with one segment free of errors the others have one each; with two such segments that are not
neighbours, the two between them cannot both have two errors.

The fuzzy segment is decoded with the perfect (23, 12) Golay code: every 23-bit word lies within three bits
of exactly one codeword. A segment of even parity has one key, the index of its codeword. One of odd
parity has the indices of its own codeword and those its one-bit neighbours decode to (one to six
in all). Segments one bit apart differ in parity, so they share a key; equal ones share all.
A full key is the segment's number, the equal segment and the codeword index: 30 bits, about 13
keys a fingerprint.

Fingerprints are made distinct before keys are made, so copies cost nothing. Fingerprints under
one key are compared in blocks of bounded size, and each block pair returns a
spanning forest of its links, never all pairs. Components are joined up by rounds of Spark jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.llm.common import column, connected, long_array, text_slices, written

SEGMENTS = 4
WIDTH = 16
#: Rows that a block of fingerprints under one key holds on average at most.
BLOCK = 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included.

    A text with fewer words gives its whole sequence, one without words gives nothing.
    """
    found = text.translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(found))
    one = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - span + 1].tolist(), ends[span - 1 :].tolist())
    return np.fromiter((one(joined[a:b], 42) for a, b in pairs), np.uint64)


#: Each byte with its eight bits spread over eight bytes, the lowest bit in the lowest byte.
_SPREAD = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    .view("<u8")
    .ravel()
)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in more than half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        spread = _SPREAD[hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)]
        # Bytes cannot overflow within 255 rows.
        sums = np.add.reduceat(spread, np.arange(0, len(spread), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def rehashed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes of the same shingles; salt 0 leaves them as they are."""
    if not salt:
        return hashes
    mixed = (hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(29))


def _fingerprints(words: int, prints: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[] for _ in range(prints)]
            for _, texts in text_slices(batch.column(1)):
                for text in texts:
                    hashes = shingle_hashes(text, words)
                    for salt in range(prints):
                        found[salt].append(fingerprint(rehashed(hashes, salt)))
            for salt in range(prints):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(batch.num_rows, salt, np.int64)),
                        long_array(np.array(found[salt], np.uint64)),
                    ],
                    ["id", "salt", "fp"],
                )

    return run


def fingerprints(
    docs: DataFrame,
    words: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    prints: int = 1,
) -> DataFrame:
    """(id, salt, fp): ``prints`` rows per row of ``docs``; fp is a fingerprint's 64 bits as a long.

    Salt 0 has the fingerprint of the shingles' XXH64, others are made from those hashes mixed anew.
    """
    return docs.select(
        column(id_column).cast("long").alias("id"), column(text_column).alias("text")
    ).mapInArrow(_fingerprints(words, prints), "id long, salt long, fp long")


def _golay_leaders() -> np.ndarray:
    """Syndrome -> error pattern of weight three or less, for the code of x^11+x^9+x^7+x^6+x^5+x+1."""
    syndromes = np.array([_syndrome(1 << b) for b in range(23)])
    leaders = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                bits = {a, b, c}
                error = sum(1 << x for x in bits)
                leaders[np.bitwise_xor.reduce([syndromes[x] for x in bits])] = error
    return leaders


def _syndrome(word: int) -> int:
    """Remainder of the word by the generator polynomial."""
    for b in range(22, 10, -1):
        if word >> b & 1:
            word ^= 0b101011100011 << (b - 11)
    return word


@lru_cache(maxsize=1)
def codeword_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment its codeword indices, padded to six, and their number."""
    values = np.arange(1 << WIDTH)
    bits = np.array([_syndrome(1 << b) for b in range(WIDTH)])
    syndrome = np.zeros(1 << WIDTH, np.int64)
    for b in range(WIDTH):
        syndrome ^= np.where(values >> b & 1, bits[b], 0)
    # The twelve high bits of a codeword determine it.
    index = (values ^ _golay_leaders()[syndrome]) >> 11
    near = np.stack([index] + [index[values ^ (1 << b)] for b in range(WIDTH)], axis=1)
    even = np.bitwise_count(values.astype(np.uint64)) % 2 == 0
    near[even] = index[even, None]
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    count = first.sum(axis=1)
    keys = np.full((1 << WIDTH, int(count.max())), -1, np.int64)
    row, _ = np.nonzero(first)
    keys[row, (np.cumsum(first, axis=1) - 1)[first]] = near[first]
    return keys, count


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): every key of every fingerprint."""
    keys, count = codeword_keys()
    segments = [((fps >> np.uint64(WIDTH * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(SEGMENTS)]
    at, out = [], []
    for k in range(SEGMENTS):
        fuzzy = segments[(k + 1) % SEGMENTS]
        position = np.repeat(np.arange(len(fps)), count[fuzzy])
        index = keys[fuzzy]
        at.append(position)
        out.append((k << 28) | (segments[k][position] << 12) | index[index >= 0])
    return np.concatenate(at), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        nodes = batch.column(1).to_numpy(zero_copy_only=False)
        at, keys = fuzzy_keys(fps)
        keys |= batch.column(2).to_numpy(zero_copy_only=False)[at] << 30
        for k in range(0, len(at), 1 << 16):
            part = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part]), long_array(fps[at[part]]), pa.array(nodes[at[part]])],
                ["key", "fp", "node"],
            )


def spanning_links(fps: np.ndarray, nodes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints.

    Each tree starts at the fingerprint with the most links, which is the original of a group of edited
    copies rather than one of them; every entry of the forest is a link itself.
    """
    degree = np.array([np.count_nonzero(np.bitwise_count(fps ^ one) <= most) for one in fps])
    left = np.lexsort((nodes, -degree))
    links = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for one in front:
                near = np.bitwise_count(fps[left] ^ fps[one]) <= most
                links += [(int(nodes[x]), int(nodes[one])) for x in left[near]]
                reached.append(left[near])
                left = left[~near]
            front = np.concatenate(reached)
    return links


def _linked(most: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            links: list[tuple[int, int]] = []
            for members in frame["members"]:
                fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
                links += spanning_links(fps, np.array([m["node"] for m in members]), most)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def linked_fingerprints(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links (a, b) that connect what fingerprints at ``most`` or fewer differing bits connect.

    ``nodes`` is a stored frame of distinct (fp, node), or (salt, fp, node): then only fingerprints of
    one salt are compared.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys find fingerprints that differ in at most three bits")
    salt = F.col("salt") if "salt" in nodes.columns else F.lit(0).cast("long")
    keyed = written(
        nodes.select("fp", "node", salt).mapInArrow(_keyed, "key long, fp long, node long"), "keys"
    )
    # Stored, so that adaptive execution can split a key that many fingerprints share.
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    # A full key is dealt into blocks; every two blocks meet, so that a key of any size is
    # compared whole by tasks of bounded size.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    paired = keyed.join(sizes, "key").select(
        "key", "fp", "node", own.alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    )
    met = paired.groupBy(
        "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    ).agg(F.collect_list(F.struct("fp", "node")).alias("members"))
    two = F.bit_count(
        F.element_at("members", 1)["fp"].bitwiseXOR(F.element_at("members", 2)["fp"])
    )
    # Most keys hold two fingerprints; those that are not alike never reach Python.
    met = met.where((F.size("members") > 2) | ((F.size("members") == 2) & (two <= most)))
    return met.select("members").mapInPandas(_linked(most), "a long, b long")


def near_groups(
    docs: DataFrame,
    words: int = 3,
    most: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint (16 hex digits), component_id.

    * component_id is the smallest id that links can reach from the document, its own included.
    * A null or empty text, or one of white space, has fingerprint zero and links like any other.
    * A null id never names a component; a fingerprint that only null ids have is not linked, and
      its component is null.
    * Rows that repeat an id are each fingerprinted by their own text; ids are compared as longs.
    * An empty table returns no rows. Other columns are ignored.
    """
    rows = written(fingerprints(docs, words, id_column, text_column), "fingerprints")
    # The node of a fingerprint is its smallest id.
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    named = nodes.where("node IS NOT NULL")
    parts = connected(linked_fingerprints(named, most))
    labels = written(
        nodes.join(parts, "node", "left").select(
            "fp", F.coalesce("component", "node").alias("component_id")
        ),
        "components",
    )
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_column),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
