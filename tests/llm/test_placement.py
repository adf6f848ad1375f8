import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from duefold.llm import hamming_topk, mixing, packing, sharding
from duefold.llm.settings import TOKENIZER
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def test_shards(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0 < sum(r.grown_shard == 16 for r in rows) < 3 * len(rows) / 17
    # Id and tree decide: another frame, other rows beside them.
    part = sharding.shard_documents(docs.where("doc_id % 7 = 0").repartition(5)).collect()
    assert {r.doc_id: r.shard for r in part}.items() <= {r.doc_id: r.shard for r in rows}.items()


def test_weights_move_only_what_they_must(spark):
    tree = sharding.even_tree()
    heavier = {**tree, "region1": {**tree["region1"], "rack1": {**tree["region1"]["rack1"], 15: 3.0}}}
    keys = spark.range(20000).selectExpr("cast(id AS string) AS k")
    moved = keys.select(
        sharding.shard_of(keys.k, tree).alias("a"), sharding.shard_of(keys.k, heavier).alias("b")
    ).collect()
    # Region 0 gains nothing; inside the changed rack rows only move to the heavier shard.
    assert all(r.b == r.a or r.b >= 8 for r in moved)
    assert all(r.b in (r.a, 15) for r in moved if r.a >= 12)
    share = Counter(r.b for r in moved)
    assert abs(share[15] / len(moved) - 3 / 18) < 0.02


def test_packing_round_trip(spark, odd_docs):
    library = Tokenizer.from_file(TOKENIZER)
    odd = ["it's don't I'LL", "Å éX İI ΣΑΣ ßẞ ﬁ", "<|endoftext|> a<|startoftext|>b <|x", "1234 a1b2 ½x", "",
           "日本語 текст İstanbul ŉ", None, "!!!'s'' --- a-b_c. ~`{}[]<>| a<b", "x" * 5000, "é b\x1cc\r\nd"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.union(
        spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    )
    ids = {
        r.doc_id: np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for r in docs.collect()
    }
    rows = packing.pack(docs, TOKENIZER).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(piece.tobytes()))
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for pieces, total in [(by_doc[i], len(ids[i])) for i in ids]:
        assert gapless(pieces) == total
    lengths = [gapless(p) for p in by_sequence.values()]
    assert max(lengths) <= 2048 and all(n & (n - 1) == 0 for n in lengths)


def gapless(pieces):
    at = 0
    for start, length in sorted(pieces):
        assert start == at
        at += length
    return at


def test_pieces_go_where_the_sum_of_squares_gets_smallest():
    packer = packing.Packer(10, 0)
    levels = Counter()
    random = np.random.default_rng(4)
    for k in range(300):
        size = int(random.integers(1, 10))
        before = {h: len(x) for h, x in enumerate(packer.open) if x}
        list(packer.add(k, b"abcd" * size))
        after = {h: len(x) for h, x in enumerate(packer.open) if x}
        best = None
        for h in [0, *before]:
            if h + size > 10:
                continue
            trial = Counter(before)
            if h:
                trial[h] -= 1
            if h + size < 10:
                trial[h + size] += 1
            total = sum(n * n for n in trial.values())
            best = total if best is None else min(best, total)
        assert sum(n * n for n in after.values()) == best
        levels.update(after)
    assert levels


def test_packing_refills_when_too_many_windows_are_open(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 5)
    packer = packing.Packer(16, 0)
    rows = [r for k in range(200) for r in packer.add(k, bytes(4 * 11))]
    rows += packer.refill(last=True)
    assert sum(r[2] for r in rows) == 200 * 11
    sequences = defaultdict(list)
    for r in rows:
        sequences[r[5]].append((r[6], r[2]))
    assert all(gapless(p) in (1, 2, 4, 8, 16) for p in sequences.values())


def test_mixing_targets_and_copies(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rows = mixing.mix_report(docs).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        size[s] += r.size
        target[s] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest and target[s] <= 2 * size[s] for s in size)
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in rows)


def test_excess_is_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 500), (None, 490)], "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(sizes, (3, 1, 2), (3, 2), 2).collect()}
    # a stops at 20; the other 1,480 are shared one to two, the null source stops at 980.
    assert found == {"a": 20.0, "b": 500.0, None: 980.0}
    zero = spark.createDataFrame([("a", 0), ("b", 0)], "source string, source_size long")
    assert {r.target for r in mixing.source_targets(zero, (3, 1, 2), (3, 2), 2).collect()} == {0.0}


def test_top_k_with_ties_nulls_and_few_rows(spark):
    random = np.random.default_rng(3)
    codes = [(int(i), int(random.integers(0, 1 << 16))) for i in range(300)] + [(1000 + i, 77) for i in range(50)]
    frame = spark.createDataFrame(codes + [(None, 5), (3, 1 << 15)], "id long, code long")
    queries = frame.where("id % 10 = 0 OR id IS NULL")
    kept = {}
    for i, c in codes + [(3, 1 << 15)]:
        kept[i] = min(c, kept.get(i, c))
    found = defaultdict(list)
    for r in hamming_topk.top_k(frame, queries, 4, bits=16).orderBy("rank").collect():
        found[r.query_id].append((r.distance, r.neighbor_id))
    for q in [i for i in kept if i % 10 == 0]:
        expected = sorted(((kept[q] ^ c).bit_count(), i) for i, c in kept.items() if i != q)[:4]
        assert found[q] == expected
    few = spark.createDataFrame([(0, 1), (1, 2)], "id long, code long")
    assert [r.neighbor_id for r in hamming_topk.top_k(few, few, 5, bits=16).orderBy("query_id").collect()] == [1, 0]
    assert hamming_topk.top_k(few.where("false"), few, 5, bits=16).count() == 0


def test_a_word_is_tokenized_once_for_its_capitals_and_marks():
    library, ours, asked = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER), []

    class Counting:
        def tokenize(self, part, model=ours.model):
            asked.append(part)
            return model.tokenize(part)

    ours.model = Counting()
    text = "Zorblique zorblique, ZORBLIQUE! zorblique\nZorblique, été, Été ÉTÉ! İx, ŉa. l'été, <|x|>"
    assert ours.ids(text) == np.array(
        library.encode(text, add_special_tokens=False).ids, "<u4"
    ).tobytes()
    assert asked.count("zorblique") == 1
    # A new cache takes over what is asked for again.
    ours.older, ours.known = ours.known, {"": b""}
    asked.clear()
    assert ours.ids("zorblique, été") and not asked
