"""Ranked lexical search over a length-stratified index.

The index has one row per document: its length and its terms with their counts. Documents of equal
normaliser m are a stratum. In a stratum the postings of a term are grouped by tf, and a group's impact
(weight times saturated tf) is computed once; every document of the group takes it. The largest impact
of each term bounds what any document of the stratum can score for an item. Strata are visited from the
largest bound down, and an item skips those whose bound is below its k-th score so far, so the answer
is exact. All arithmetic is on whole numbers.

Rows are dealt to tasks by ranges of length, so a stratum is together, and one with a third of all
documents is split. Items go to the tasks as (item, term, times), at most ``ITEM_TERMS`` of them in a job.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duefold.llm.common import column, text_slices, written

#: Different terms that an index can be restricted to; with more it holds all.
VOCABULARY = 200_000
#: Rows (item, term, times) that one job ships to its tasks.
ITEM_TERMS = 1_000_000
#: Documents that a task holds at a time, and numbers in one of its matrices.
SHELF = 32_768
CELLS = 4 << 20

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and anything beyond ASCII, only A-Z lowered."""
    return text.translate(_LETTERS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def normaliser(n: int, documents: int, terms: int) -> int:
    return 100 - 75 + (75 * n * documents) // terms


def _counted(vocabulary: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                lengths, ends, terms, tfs = [], [0], [], []
                for text in texts:
                    found = terms_of(text)
                    lengths.append(len(found))
                    counts = Counter(found)
                    kept = counts.keys() if vocabulary is None else counts.keys() & vocabulary
                    terms += kept
                    tfs += [counts[t] for t in kept]
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first : first + len(texts)],
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary()).cast(pa.string())),
                        pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64())),
                    ],
                    ["id", "n", "terms", "tfs"],
                )

    return run


def build_index(
    docs: DataFrame,
    vocabulary: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A stored table (row, id, n, terms, tfs): a document's length, different terms and their counts.

    ``vocabulary``, a frame of one column of terms, restricts the terms that are kept if it has at
    most ``VOCABULARY`` of them; lengths count all terms. ``row`` numbers the rows, repeated ids too.
    """
    kept = None
    if vocabulary is not None:
        found = vocabulary.distinct().limit(VOCABULARY + 1).toArrow().column(0).to_pylist()
        if len(found) <= VOCABULARY:
            kept = frozenset(t.encode() for t in found if t is not None)
    rows = docs.select(column(id_column).cast("long").alias("id"), column(text_column).alias("text"))
    counted = rows.mapInArrow(
        _counted(kept), "id long, n long, terms array<string>, tfs array<long>"
    )
    return written(
        counted.select(F.monotonically_increasing_id().alias("row"), "*"), "lexical-index"
    )


class _Items:
    """Some items as a matrix of the times that each holds each of their terms."""

    def __init__(self, items: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray):
        self.names, of = np.unique(items, return_inverse=True)
        self.terms, at = np.unique(terms, return_inverse=True)
        #: Place of each term of the job, or -1.
        self.place = np.full(len(weights), -1, np.int64)
        self.place[self.terms] = np.arange(len(self.terms))
        self.weights = weights[self.terms]
        counts = np.zeros((len(self.terms), len(self.names)), np.int64)
        np.add.at(counts, (at, of), times)
        # An impact is at most a million times a weight. Sums that doubles hold exactly are taken in
        # doubles, which is quicker.
        most = (counts.T @ self.weights).max(initial=0) * 1_000_000
        self.counts = counts.astype(np.float64) if most < 1 << 53 else counts


def _blocks(items: np.ndarray, terms: np.ndarray) -> list[slice]:
    """Cuts of rows sorted by item, such that a matrix of items and terms has at most ``CELLS`` numbers."""
    out, start, held, met = [], 0, 0, set()
    edges = [*np.flatnonzero(np.diff(items)).tolist(), len(items) - 1]
    at = 0
    for edge in edges:
        own = set(terms[at : edge + 1].tolist())
        if held and (held + 1) * len(met | own) > CELLS:
            out.append(slice(start, at))
            start, held, met = at, 0, set()
        held, met, at = held + 1, met | own, edge + 1
    return out + [slice(start, len(items))]


class _Best:
    """The best documents of some items so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)

    def take(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        for at in np.flatnonzero((scores >= self.floor[items]).any(axis=0)).tolist():
            item = int(items[at])
            found = np.flatnonzero(scores[:, at] >= self.floor[item])
            # The k best of them by score, then id, nulls last.
            order = np.lexsort((ids[found], absent[found], -scores[found, at]))[: self.k]
            found = found[order]
            rows = self.rows[item]
            rows += zip((-scores[found, at]).tolist(), absent[found].tolist(), ids[found].tolist())
            rows.sort()
            del rows[self.k :]
            if len(rows) == self.k:
                self.floor[item] = -rows[-1][0]


class _Shelf:
    """Documents as arrays: ids, lengths, and the postings of terms that the job asks for."""

    def __init__(self, batches: list[pa.RecordBatch], terms: pa.Array):
        ids, lengths, sizes, places, tfs = [], [], [], [], []
        for batch in batches:
            held = batch.column("terms")
            at = pc.index_in(held.flatten(), value_set=terms)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy())[known]
            ids.append(batch.column("id"))
            lengths.append(batch.column("n").to_numpy())
            sizes.append(np.bincount(of, minlength=len(held)))
            places.append(at.drop_null().to_numpy().astype(np.int64))
            tfs.append(batch.column("tfs").flatten().to_numpy()[known])
        whole = pa.chunked_array(ids, pa.int64())
        self.absent = whole.is_null().to_numpy()
        self.ids = whole.fill_null(0).to_numpy()
        self.n, self.sizes = np.concatenate(lengths), np.concatenate(sizes)
        self.terms, self.tfs = np.concatenate(places), np.concatenate(tfs)


def _visited(items: _Items, best: _Best, shelf: _Shelf, documents: int, total: int) -> None:
    """All documents of a shelf against some items, stratum by stratum."""
    terms = items.place[shelf.terms]
    docs = np.repeat(np.arange(len(shelf.n)), shelf.sizes)[terms >= 0]
    tfs, terms = shelf.tfs[terms >= 0], terms[terms >= 0]
    if not len(terms):
        return
    lengths, at = np.unique(shelf.n, return_inverse=True)
    each = np.array([normaliser(n, documents, total) for n in lengths.tolist()], np.int64)
    normalisers, stratum = np.unique(each[at], return_inverse=True)
    # Postings of a stratum grouped by term and tf: one impact a group.
    order = np.lexsort((tfs, terms, stratum[docs]))
    keys = np.stack([stratum[docs[order]], terms[order], tfs[order]])
    opens = np.ones(len(order), bool)
    opens[1:] = (np.diff(keys) != 0).any(axis=0)
    of, term, tf = keys[:, opens]
    group = (1_000_000_000 * tf) // (1000 * tf + 8 * normalisers[of]) * items.weights[term]
    impact = np.empty(len(order), np.int64)
    impact[order] = group[np.cumsum(opens) - 1]
    # The last group of a term has its largest tf, hence its largest impact in the stratum.
    last = np.ones(len(of), bool)
    last[:-1] = (np.diff(of) != 0) | (np.diff(term) != 0)
    of, term, group = of[last], term[last], group[last]
    found, starts = np.unique(of, return_index=True)
    bounds = []
    for lo, hi in zip(starts, [*starts[1:], len(of)]):
        counts = items.counts[term[lo:hi]]
        bounds.append((group[lo:hi].astype(counts.dtype) @ counts).astype(np.int64))
    # Documents and postings by stratum.
    members = np.argsort(stratum, kind="stable")
    firsts = np.searchsorted(stratum[members], np.arange(len(normalisers) + 1))
    place = np.empty(len(members), np.int64)
    place[members] = np.arange(len(members)) - firsts[stratum[members]]
    listed = np.lexsort((place[docs], stratum[docs]))
    edges = np.searchsorted(stratum[docs[listed]], np.arange(len(normalisers) + 1))
    for x in sorted(range(len(found)), key=lambda x: -int(bounds[x].max())):
        k = found[x]
        own = members[firsts[k] : firsts[k + 1]]
        postings = listed[edges[k] : edges[k + 1]]
        used = term[starts[x] : starts[x + 1] if x + 1 < len(starts) else len(term)]
        rows, columns = place[docs[postings]], np.searchsorted(used, terms[postings])
        step = max(1, CELLS // len(used))
        for lo in range(0, len(own), step):
            wanted = np.flatnonzero(bounds[x] >= best.floor)
            if not len(wanted):
                break
            part = slice(*np.searchsorted(rows, [lo, lo + step]))
            ids = own[lo : lo + step]
            counts = items.counts[np.ix_(used, wanted)] if len(wanted) < len(best.floor) else items.counts[used]
            matrix = np.zeros((len(ids), len(used)), counts.dtype)
            matrix[rows[part] - lo, columns[part]] = impact[postings[part]]
            best.take(wanted, (matrix @ counts).astype(np.int64), shelf.ids[ids], shelf.absent[ids])


def _scored(asked: pa.Table, documents: int, total: int, k: int):
    """Documents -> the best of this task for each item; ``asked`` is sorted by item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.column("item").to_numpy()
        names = pc.unique(asked.column("term")).sort()
        terms = pc.index_in(asked.column("term"), value_set=names).to_numpy().astype(np.int64)
        weights = np.zeros(len(names), np.int64)
        weights[terms] = [weight(documents, df) for df in asked.column("df").to_pylist()]
        times = asked.column("times").to_numpy()
        blocks = [(items[b], terms[b], times[b]) for b in _blocks(items, terms)]
        kept = [_Best(len(np.unique(b[0])), k) for b in blocks]

        def visit(held):
            shelf = _Shelf(held, names)
            for block, best in zip(blocks, kept):
                _visited(_Items(*block, weights), best, shelf, documents, total)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SHELF:
                visit(held)
                held, size = [], 0
        if size:
            visit(held)
        out: list[tuple] = []
        for block, best in zip(blocks, kept):
            for item, found in zip(np.unique(block[0]).tolist(), best.rows):
                out += [(item, None if absent else doc, -score) for score, absent, doc in found]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``index`` for each item, score above 0.

    ``items`` has (item_id, term, times). Equal scores are ranked by id, nulls last. Rows that repeat an id
    are documents of their own.
    """
    spark = index.sparkSession
    named = written(
        items.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item-terms"
    )
    documents, total = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = (
        index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    )
    # Items by number, so that any type of id and null ones do.
    numbers = written(
        named.groupBy("item_id")
        .agg(F.count("*").alias("size"))
        .select("item_id", "size", F.monotonically_increasing_id().alias("item")),
        "item-numbers",
    )
    asked = named.join(
        numbers, named["item_id"].eqNullSafe(numbers["item_id"])
    ).select("item", "term", "times")
    asked = written(asked.join(holding, "term").select("item", "term", "times", "df"), "asked")
    jobs = math.ceil(asked.count() / ITEM_TERMS)
    found = None
    for job in range(jobs):
        # By hash of the item, so a few more than the bound at most; one item is never cut.
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(jobs)) == job).orderBy("item", "term")
        scored = (
            index.where("size(terms) > 0")
            .select("id", "n", "terms", "tfs", "row")
            .repartitionByRange("n", "row")
            .mapInArrow(
                _scored(part.toArrow(), documents, total, k), "item long, id long, score long"
            )
        )
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbers, "item").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score"
    )


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    query_column: str = "text",
) -> DataFrame:
    """The ``k`` best documents for each item, both given as texts; see ``search`` for the columns.

    * A null text has no term, nor has one of white space and signs; such documents are never found, and
      such items have no rows. Texts of any length are taken whole.
    * Rows that repeat an item's id, a null one too, are one item with all their terms. Documents with
      a null id count and can be found. An empty table on either side gives no rows.
    * Ties go to the smaller id. Other columns are ignored.
    """
    asked = items.select(column(item_column).alias("item_id"), column(query_column).alias("text"))
    texts = asked.select(
        "item_id",
        F.explode(
            F.expr(
                r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                r"'abcdefghijklmnopqrstuvwxyz'), '([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)', 1)"
            )
        ).alias("term"),
    )
    terms = written(texts.groupBy("item_id", "term").agg(F.count("*").alias("times")), "queries")
    index = build_index(docs, terms.select("term"), id_column, text_column)
    return search(index, terms, k)
