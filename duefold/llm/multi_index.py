"""Approximate nearest neighbours by an inverted multi-index, nearness being the inner product.

Vectors are cut into two halves, and each half is quantised by its own centroids; a pair of centroids is
a cell. A query's inner products with the centroids of both halves add up to the score of a cell. Cells
are visited from the best down: a heap holds the next pair of each row of centroids, and entries of the
visited cells are compared by their original vectors.

Where a query stops is decided in two steps. First it visits cells that hold ``FIRST`` of the entries
(``FEWEST`` at least); the k-th score found there is a floor for the true one. Around the score of
its cell an entry's score spreads with the residuals of its two centroids, which gives the number of entries that each
cell may hold above the floor. The query then visits all cells down to the score below which at most
``MISSED`` of k such entries are expected. So the effort follows the data, not a fixed share of it.

Equal vectors are one entry with the k + 1 smallest ids, since no others of them can be an answer. Entries
are dealt into parts by the first centroid; a centroid with many entries has several parts. Queries
go to the parts that hold a cell of theirs and are compared in blocks as matrix products. The fit uses a
sample of at most about ``SAMPLE`` entries; every entry is indexed. What goes to every task is the
centroids and a count for each cell, at most ``CENTROIDS`` squared.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duefold.llm.common import column, written

K = 20
EVERY = 20
#: Entries that centroids are fitted on, about.
SAMPLE = 50_000
#: Most centroids of a half; fewer where a cell would hold less than ``PER_CELL`` entries.
CENTROIDS = 1024
PER_CELL = 3
ROUNDS = 12
#: Share of entries that a query visits at first, and least number of them for each answer.
FIRST = 0.02
FEWEST = 20
#: Share of the answers that may be missed, by expectation.
MISSED = 0.05
#: Entries of a part at most, and parts at least where there are enough entries.
PART = 65_536
PARTS = 16
#: Queries that are compared at a time.
BLOCK = 256

_STEP = 1 / 256
_TAIL = np.array([0.5 * math.erfc(x * _STEP / math.sqrt(2)) for x in range(-2048, 2049)])


def tail(z: np.ndarray) -> np.ndarray:
    """The share of a normal distribution above ``z``."""
    return _TAIL[np.clip(np.rint(z / _STEP), -2048, 2048).astype(np.int64) + 2048]


def fitted(sample: np.ndarray, centroids: int) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds; their start is spread evenly over the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.linspace(0, len(sample) - 1, min(centroids, len(sample))).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = assigned(sample, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def assigned(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    out = np.empty(len(vectors), np.int64)
    half = (centres**2).sum(axis=1) / 2
    for k in range(0, len(vectors), 4096):
        out[k : k + 4096] = (half - vectors[k : k + 4096] @ centres.T).argmin(axis=1)
    return out


def pairs_from_best(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of a[i] + b[j] from the largest sum down, by a heap."""
    rows, columns = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(a[rows[0]] + b[columns[0]]), 0, 0)]
    while heap:
        total, x, y = heapq.heappop(heap)
        yield -total, rows[x], columns[y]
        if y + 1 < len(columns):
            heapq.heappush(heap, (-(a[rows[x]] + b[columns[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(rows):
            heapq.heappush(heap, (-(a[rows[x + 1]] + b[columns[0]]), x + 1, 0))


class Model:
    """Centroids of both halves, entries of each cell and the spread around its score."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.cut = first.shape[1]
        self.counts = np.zeros((len(first), len(second)), np.int64)
        self.spread = [np.zeros(len(first)), np.zeros(len(second))]
        self.starts = self.shares = None

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.cut], vectors[:, self.cut :]

    def codes(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [assigned(x, book) for x, book in zip(self.halves(vectors), self.books)]

    def learn(self, cells: list[tuple[int, int, int, float, float]], part: int) -> None:
        """Take in (first, second, entries, squared residuals of each half) and deal out the parts."""
        sums = [np.zeros(len(b)) for b in self.books]
        for i, j, n, one, two in cells:
            self.counts[i, j] = n
            sums[0][i] += one
            sums[1][j] += two
        for half, axis in ((0, 1), (1, 0)):
            n = np.maximum(self.counts.sum(axis=axis), 1)
            self.spread[half] = sums[half] / n / max(self.books[half].shape[1], 1)
        # Parts in the order of the first centroid; a large one has ``shares`` parts of its own.
        self.starts, self.shares = [], []
        at = held = 0
        for n in self.counts.sum(axis=1).tolist():
            shares = max(1, math.ceil(n / part))
            if held and (held + n > part):
                at, held = at + 1, 0
            self.starts.append(at)
            self.shares.append(shares)
            held += n
            if shares > 1:
                at, held = at + shares, 0

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ book.T for x, book in zip(self.halves(queries), self.books))

    def first_floor(self, a: np.ndarray, b: np.ndarray, entries: int) -> float:
        """The score of the last cell visited until ``entries`` entries are met."""
        met, score = 0, -math.inf
        for score, i, j in pairs_from_best(a, b):
            met += int(self.counts[i, j])
            if met >= entries:
                return score
        return -math.inf

    def last_floor(self, query: np.ndarray, a: np.ndarray, b: np.ndarray, kth: float, missed: float) -> float:
        """The score below which at most ``missed`` entries above ``kth`` are expected."""
        squares = [(x**2).sum() for x in (query[: self.cut], query[self.cut :])]
        spread = np.sqrt(
            (squares[0] * self.spread[0])[:, None] + (squares[1] * self.spread[1])[None, :]
        )
        scores = a[:, None] + b[None, :]
        held = self.counts > 0
        if kth == -math.inf:
            return -math.inf
        scores, spread, counts = scores[held], spread[held], self.counts[held]
        z = np.divide(kth - scores, spread, out=np.where(scores >= kth, -8.0, 8.0), where=spread > 0)
        expected = counts * tail(z)
        order = np.argsort(scores)
        below = np.searchsorted(np.cumsum(expected[order]), missed, "right")
        return float(scores[order[below]]) if below < len(order) else math.inf


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A column of vectors of one length, as doubles."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _indexed(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            codes = model.codes(vectors)
            off = [
                ((x - book[c]) ** 2).sum(axis=1)
                for x, book, c in zip(model.halves(vectors), model.books, codes)
            ]
            columns = [pa.array(c) for c in (*codes, *off)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("entry"), *columns, batch.column("vector")],
                ["entry", "first", "second", "off_first", "off_second", "vector"],
            )

    return run


_QUERY = "part long, kind int, name long, vector array<double>, floor double, least double"


def _asking(model: Model, entries: int, missed: float, again: bool):
    """Queries (name, vector, kth) -> a row for each part that has cells they visit.

    Down to the cell at which ``entries`` entries are met; ``again``, also all in which more than ``missed``
    entries above kth are expected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.counts > 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            names = batch.column("name").to_pylist()
            kths = batch.column("kth").to_pylist()
            at, parts, floors = [], [], []
            for k, (a, b) in enumerate(zip(*model.scores(vectors))):
                floor = model.first_floor(a, b, entries)
                if again:
                    # Fewer than k found so far: all cells.
                    kth = -math.inf if kths[k] is None else kths[k]
                    floor = min(floor, model.last_floor(vectors[k], a, b, kth, missed))
                best = np.where(held, b[None, :], -math.inf).max(axis=1) + a
                found = {
                    model.starts[i] + share
                    for i in np.flatnonzero(best >= floor).tolist()
                    for share in range(model.shares[i])
                    if best[i] > -math.inf
                }
                at += [k] * len(found)
                parts += sorted(found)
                floors += [floor] * len(found)
            kth = [kths[k] if kths[k] is not None else -math.inf for k in at]
            for lo in range(0, len(at), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts[part], pa.int64()),
                        pa.array([1] * len(at[part]), pa.int32()),
                        pa.array([names[k] for k in at[part]], pa.int64()),
                        pa.array(list(vectors[at[part]]), pa.list_(pa.float64())),
                        pa.array(floors[part], pa.float64()),
                        pa.array(kth[part], pa.float64()),
                    ],
                    ["part", "kind", "name", "vector", "floor", "least"],
                )

    return run


def _compared(model: Model, k: int):
    """Entries of a part, then its queries -> (name, entry, score) of the best of each query."""

    def answers(part, queries) -> pa.RecordBatch:
        names, vectors, floors, least = queries
        seconds, entries, matrix, slabs = part
        a, b = model.scores(vectors)
        rows, found, scores = [], [], []
        for i, lo, hi in slabs:
            asking = np.flatnonzero(a[:, i] + b[:, seconds[lo:hi]].max(axis=1) >= floors)
            if not len(asking):
                continue
            near = vectors[asking] @ matrix[lo:hi].T
            wanted = (a[asking, i][:, None] + b[asking][:, seconds[lo:hi]]) >= floors[asking][:, None]
            wanted &= near >= least[asking][:, None]
            x, y = np.nonzero(wanted)
            rows.append(asking[x])
            found.append(y + lo)
            scores.append(near[x, y])
        if not rows:
            return None
        rows, found, scores = map(np.concatenate, (rows, found, scores))
        if not len(rows):
            return None
        order = np.lexsort((-scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        starts = np.searchsorted(rows, np.arange(len(names)))
        place = np.arange(len(rows)) - starts[rows]
        # The k best, and what equals the last of them up to rounding.
        ends = np.append(starts[1:], len(rows))
        last = np.minimum(starts + k, ends) - 1
        room = 1e-9 * (1 + np.abs(scores))
        kept = (place < k) | (scores >= scores[np.maximum(last, 0)][rows] - room)
        rows, found = rows[kept], found[kept]
        # Sums rounded once, so that they do not depend on how entries are dealt.
        exact = [math.fsum(p) for p in (vectors[rows] * matrix[found]).tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array(names[rows]), pa.array(entries[found]), pa.array(exact, pa.float64())],
            ["name", "entry", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part, asked = None, [], None, []

        def closed():
            columns = [np.concatenate(c) for c in zip(*held)]
            codes = model.codes(columns[1])
            order = np.lexsort((columns[0], codes[1], codes[0]))
            firsts, seconds = codes[0][order], codes[1][order]
            cuts = np.flatnonzero(np.diff(firsts)) + 1
            edges = [0, *cuts.tolist(), len(firsts)]
            slabs = [(int(firsts[lo]), lo, hi) for lo, hi in zip(edges, edges[1:])]
            return seconds, columns[0][order], columns[1][order], slabs

        def asked_now():
            queries = [np.concatenate(c) for c in zip(*asked)]
            for lo in range(0, len(queries[0]), BLOCK):
                block = answers(part, [c[lo : lo + BLOCK] for c in queries])
                if block is not None:
                    yield block

        for batch in batches:
            parts, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
            names = batch.column("name").to_numpy()
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            least = batch.column("least").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if parts[lo] != now:
                    if asked:
                        yield from asked_now()
                    now, held, part, asked = parts[lo], [], None, []
                vectors = _matrix(batch.column("vector").slice(lo, hi - lo))
                if kinds[lo] == 0:
                    held.append((names[lo:hi], vectors))
                    continue
                if part is None:
                    part, held = closed(), []
                asked.append((names[lo:hi], vectors, floors[lo:hi], least[lo:hi]))
                if sum(len(x[0]) for x in asked) >= BLOCK:
                    yield from asked_now()
                    asked = []
        if asked:
            yield from asked_now()

    return run


def nearest(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    first: float = FIRST,
    missed: float = MISSED,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest to each row whose id ``every`` divides.

    Nearness is the inner product of the original vectors in doubles, summed with one rounding; ties
    go to the smaller id. A row is not its own neighbour.

    * Vectors that are null, empty, zero or hold null, NaN or infinite numbers take no part, nor do null ids, nor
      vectors of another length than most have (of equally common lengths the largest).
    * A row that repeats an id counts once, with its smallest vector. Equal vectors under
      different ids are each other's neighbours.
    * With fewer than ``k`` other rows all are found. An empty table gives no rows.
    * Other columns are ignored.
    """
    spark = vectors.sparkSession
    answer = "query_id long, rank int, vec_id long, score double"
    double = F.transform(column(vector_column), lambda x: x.cast("double"))
    rows = vectors.select(column(id_column).cast("long").alias("id"), double.alias("vector")).where(
        F.col("id").isNotNull()
        & F.coalesce(
            F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
        )
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    length = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if length is None:
        return spark.createDataFrame([], answer)
    rows = written(
        rows.where(F.size("vector") == length["length"]).groupBy("id").agg(F.min("vector").alias("vector")),
        "vectors",
    )
    # A limit by rank comes before the shuffle, too, so a common vector sends k + 1 ids a task.
    at = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    entries = written(
        rows.withColumn("at", at)
        .where(F.col("at") <= k + 1)
        .groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("entry"), "ids", "vector"),
        "entries",
    )
    total = entries.count()
    model = _fit(entries, total, sample)
    index = written(
        entries.select("entry", "vector").mapInArrow(
            _indexed(model),
            "entry long, first long, second long, off_first double, off_second double, vector array<double>",
        ),
        "multi-index",
    )
    cells = index.groupBy("first", "second").agg(
        F.count("*"), F.sum("off_first"), F.sum("off_second")
    )
    part = min(PART, max(1024, math.ceil(total / PARTS)))
    model.learn([tuple(r) for r in cells.collect()], part)
    places = spark.createDataFrame(
        [(i, s, n) for i, (s, n) in enumerate(zip(model.starts, model.shares))],
        "first long, start long, shares long",
    )
    # At most CENTROIDS rows.
    dealt = (
        index.join(F.broadcast(places), "first")
        .select(
            (F.col("start") + F.pmod(F.xxhash64("entry"), F.col("shares"))).alias("part"),
            F.lit(0).alias("kind"), F.col("entry").alias("name"), "vector",
            F.lit(0.0).alias("floor"), F.lit(0.0).alias("least"),
        )
    )
    asked = rows.where(F.col("id") % every == 0)
    # Queries of one vector share one search, under their smallest id.
    queries = written(
        asked.groupBy("vector").agg(F.min("id").alias("name")).select("name", "vector"), "queries"
    )

    start = max(FEWEST * k, math.ceil(first * total))

    def searched(queries: DataFrame, again: bool) -> DataFrame:
        asking = queries.mapInArrow(_asking(model, start, missed * k, again), _QUERY)
        ready = dealt.unionByName(asking).repartition("part").sortWithinPartitions("part", "kind", "name")
        return ready.mapInArrow(_compared(model, k + 1), "name long, entry long, score double")

    def best(found: DataFrame) -> DataFrame:
        # Entries first, then ids: at most k + 1 of each can be an answer.
        order = W.partitionBy("name").orderBy(F.desc("score"), "id")
        near = found.join(entries.select("entry", "ids"), "entry").select(
            "name", "score", F.explode("ids").alias("id")
        )
        return near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)

    opened = best(searched(queries.withColumn("kth", F.lit(None).cast("double")), False))
    kth = opened.where(F.col("at") == k + 1).select("name", F.col("score").alias("kth"))
    # A hair below, for the sums of the comparison are rounded otherwise.
    lower = F.col("kth") - F.lit(1e-9) * (1 + F.abs("kth"))
    again = written(
        queries.join(kth, "name", "left").select("name", "vector", lower.alias("kth")), "queries-again"
    )
    found = written(best(searched(again, True)), "found")
    own = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "vector")
    named = own.join(queries, "vector").select("query_id", "name")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        named.join(found, "name")
        .where("query_id != id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )


def _fit(entries: DataFrame, total: int, sample: int) -> Model:
    """Centroids from at most about ``sample`` entries, chosen by a hash of the vector."""
    share = F.lit(int(min(1.0, sample / max(total, 1)) * (1 << 30)))
    chosen = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < share
    found = entries.where(chosen).orderBy(F.xxhash64("vector"), "entry").select("vector").toArrow()
    vectors = _matrix(found.column(0).combine_chunks())
    cut = vectors.shape[1] // 2
    centroids = max(1, min(CENTROIDS, math.isqrt(total // PER_CELL)))
    return Model(fitted(vectors[:, :cut], centroids), fitted(vectors[:, cut:], centroids))
