import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from duefold.llm import hamming_topk, multi_index, ranked_search
from duefold.llm.queries import QUERIES
from tests.conftest import SMALL

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def lists(rows, key):
    out = {}
    for r in sorted(rows, key=lambda r: (r[key] is None, r[key] or 0, r.rank)):
        out.setdefault(r[key], []).append(r)
    assert all([r.rank for r in x] == list(range(1, len(x) + 1)) for x in out.values())
    return out


def nearest_by_force(rows, k, every=20):
    """{query: [(score, id)]} over plain (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], np.float64)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        exact = [math.fsum(p) for p in (matrix * matrix[at]).tolist()]
        order = sorted((-s, i) for s, i in zip(exact, ids.tolist()) if i != ids[at])
        out[int(ids[at])] = [(-s, i) for s, i in order[:k]]
    return out


@pytest.mark.parametrize("folder", [MIDDLE, LARGE])
def test_recall_of_neighbours(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = nearest_by_force(table, 20)
    found = lists(QUERIES["op12_nearest_neighbours"](spark, folder).collect(), "query_id")
    assert found.keys() == expected.keys()
    vectors = {i: np.array(v, np.float64) for i, v in table}
    met = 0
    for query, rows in found.items():
        assert len(rows) == 20 and query not in {r.vec_id for r in rows}
        met += len({r.vec_id for r in rows} & {i for _, i in expected[query]})
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        for r in rows:
            assert r.score == math.fsum((vectors[query] * vectors[r.vec_id]).tolist())
    assert met >= 0.93 * 20 * len(expected)


def test_neighbours_in_tight_groups_need_few_cells(spark):
    """Clustered vectors: recall stays, and the second floor spares most of the entries."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + rng.normal(size=32) * 0.05).tolist()) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = nearest_by_force(rows, 20)
    found = lists(multi_index.nearest(table).collect(), "query_id")
    met = sum(len({r.vec_id for r in x} & {i for _, i in expected[q]}) for q, x in found.items())
    assert met >= 0.9 * 20 * len(expected)
    matrix = np.array([v for _, v in rows])
    model = multi_index.Model(multi_index.fitted(matrix[:, :16], 31), multi_index.fitted(matrix[:, 16:], 31))
    cells = Counter(zip(*(c.tolist() for c in model.codes(matrix))))
    off = {}
    for key, x in zip(zip(*(c.tolist() for c in model.codes(matrix))), matrix):
        own = [((h - b[c]) ** 2).sum() for h, b, c in zip((x[:16], x[16:]), model.books, key)]
        off[key] = np.add(off.get(key, 0.0), own)
    model.learn([(*key, n, *off[key]) for key, n in cells.items()], 1024)
    a, b = (x[0] for x in model.scores(matrix[:1]))
    kth = expected[0][-1][0]
    floor = model.last_floor(matrix[0], a, b, kth, 1.0)
    visited = model.counts[(a[:, None] + b[None, :]) >= floor].sum()
    assert visited < len(rows) / 4


def test_pairs_come_from_the_best():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=7), rng.normal(size=11)
    found = list(multi_index.pairs_from_best(a, b))
    assert [s for s, _, _ in found] == sorted((a[:, None] + b[None, :]).ravel().tolist(), reverse=True)
    assert len({(i, j) for _, i, j in found}) == 77


def test_a_common_vector_and_parts(spark, monkeypatch):
    """Half of the rows share one vector; many small parts, one centroid split over several."""
    monkeypatch.setattr(multi_index, "PARTS", 40)
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(3000)]
    rows += [(i, rng.normal(size=3).tolist()) for i in range(3000, 6000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    found = lists(multi_index.nearest(table, missed=0.0).collect(), "query_id")
    expected = nearest_by_force(rows, 20)
    same = sum([(r.score, r.vec_id) for r in found[q]] == expected[q] for q in expected)
    assert same >= 0.95 * len(expected)
    assert found[0][0].vec_id in (1, expected[0][0][1])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]),
        (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [3.0, 3.0]),
        (20, [-1.0, -1.0]), (20, [-1.0, -1.0]), (20, [5.0, 5.0]), (40, None), (60, [0.0, 0.0]),
    ]
    full = [r + (1, "x", 2.0) for r in rows]
    table = spark.createDataFrame(
        full, "vec_id long, embedding array<double>, rank int, name string, score double"
    )
    found = {(r.query_id, r.rank, r.vec_id, r.score) for r in multi_index.nearest(table).collect()}
    assert found == {
        (0, 1, 1, 4.0), (0, 2, 2, 4.0), (0, 3, 20, -3.0),
        (20, 1, 0, -3.0), (20, 2, 1, -3.0), (20, 3, 2, -3.0),
    }
    assert multi_index.nearest(table.limit(0)).count() == 0
    assert multi_index.nearest(table.where("vec_id = 0")).count() == 0
    one = spark.createDataFrame([(i, [float(i - 3)]) for i in range(0, 9)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in multi_index.nearest(one, k=2).orderBy("rank").collect()] == [1, 2]


def ranked_by_force(docs, items, k=10):
    """{item: [(score, doc)]} by plain dictionaries; docs and items are (id, text)."""

    def terms(text):
        low = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)

    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [c for c in counted if c[2]]
    total = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, text in items:
        for t in terms(text):
            out.setdefault(item, Counter())[t] += 1
    for item, asked in out.items():
        scores = []
        for doc, counts, n in held:
            m = 100 - 75 + (75 * n * len(held)) // total
            score = 0
            for t, times in asked.items():
                tf = counts.get(t, 0)
                if tf:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                    score += times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out[item] = [(-s, None if absent else d) for s, absent, d in sorted(scores)[:k]]
    return {i: x for i, x in out.items() if x}


def test_ranks_by_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text")
    found = lists(QUERIES["op13_ranked_search"](spark, SMALL).collect(), "item_id")
    expected = ranked_by_force(docs.collect(), items.collect())
    assert {i: [(r.score, r.doc_id) for r in x] for i, x in found.items()} == expected


def test_odd_documents_and_items(spark, odd_docs, no_docs):
    rows = [(1, "Hello, WORLD!"), (1, "there é"), (None, "no id word"), (2, None), (3, "?!"), (4, "unknown"), (5, "12345 two")]
    items = spark.createDataFrame([r + (9,) for r in rows], "item_id long, text string, doc_id int")
    found = lists(ranked_search.ranked_search(odd_docs, items).collect(), "item_id")
    docs = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    assert {i: [(r.score, r.doc_id) for r in x] for i, x in found.items()} == ranked_by_force(docs, rows)
    assert ranked_search.ranked_search(no_docs, items).count() == 0
    assert ranked_search.ranked_search(odd_docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(odd_docs.where("text IS NULL"), items).count() == 0


def test_one_stratum_several_jobs_and_shelves(spark, monkeypatch):
    """Most documents have one length; items come in several jobs and small matrices."""
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 40)
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(60)]
    docs = [(i, " ".join(rng.choice(words, 12))) for i in range(1500)]
    docs += [(i, " ".join(rng.choice(words, 1 + i % 50))) for i in range(1500, 2200)]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = lists(ranked_search.ranked_search(frame, asked).collect(), "item_id")
    assert {i: [(r.score, r.doc_id) for r in x] for i, x in found.items()} == ranked_by_force(docs, items)
    whole = ranked_search.build_index(frame)
    assert whole.selectExpr("sum(aggregate(tfs, 0L, (a, b) -> a + b)) = sum(n) AS whole").first().whole


def test_large_sums_stay_exact():
    names = pa.array([f"t{k:02}" for k in range(50)])
    items, terms = np.array([0] * 50 + [1]), np.array([*range(50), 0])
    times, weights = np.array([10**6] * 50 + [1]), np.full(50, 25000)
    assert ranked_search._blocks(items, terms) == [slice(0, 51)]
    block = ranked_search._Items(items, terms, times, weights)
    assert block.counts.dtype == np.int64
    best = ranked_search._Best(2, 3)
    batch = pa.RecordBatch.from_pydict(
        {
            "id": pa.array(range(5), pa.int64()), "n": pa.array([50] * 5, pa.int64()),
            "terms": pa.array([names.to_pylist()] * 5), "tfs": pa.array([[1 + d] * 50 for d in range(5)]),
        }
    )
    ranked_search._visited(block, best, ranked_search._Shelf([batch], names), 5, 250)
    m = ranked_search.normaliser(50, 5, 250)
    expected = sorted(
        ((-50 * 10**6 * 25000 * (10**9 * tf // (1000 * tf + 8 * m)), False, tf - 1) for tf in range(1, 6))
    )[:3]
    assert best.rows[0] == expected


def test_blocks_hold_whole_items(monkeypatch):
    monkeypatch.setattr(ranked_search, "CELLS", 12)
    items = np.array([0, 0, 0, 1, 1, 2, 3, 3, 3, 3])
    terms = np.array([0, 1, 2, 2, 3, 3, 4, 5, 6, 7])
    cuts = ranked_search._blocks(items, terms)
    assert [set(items[c].tolist()) for c in cuts] == [{0, 1, 2}, {3}]


def test_odd_sign_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, -1.0]), (20, [1.0, -1.0]), (1, None), (2, []), (3, [nan, 1.0]), (4, [None, 1.0]), (None, [1.0])]
    table = spark.createDataFrame([r + (1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, code string")
    found = {(r.query_id, r.rank): (r.neighbor_id, r.distance) for r in hamming_topk.nearest_signs(table, 3).collect()}
    assert found == {
        (0, 1): (20, 0), (0, 2): (1, 1), (0, 3): (2, 1), (20, 1): (0, 0), (20, 2): (1, 1), (20, 3): (2, 1),
    }
    assert hamming_topk.nearest_signs(table.limit(0)).count() == 0
    longer = spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="more than 64"):
        hamming_topk.nearest_signs(longer).collect()
