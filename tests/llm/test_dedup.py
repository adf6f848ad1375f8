import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from duefold.llm import exact_dedup, near_copies, passages, simhash
from duefold.llm.common import connected, new_path, without, written
from tests.conftest import SMALL

from .conftest import lower


def test_exact_dedup_of_odd_rows(odd_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].keep_id == by_id[2].keep_id == 2 and by_id[1].group_size == 2
    assert by_id[4].keep_id == 5 and by_id[5].group_size == 3 and by_id[6].keep_id == 6
    assert [r.kept for r in rows if r.doc_id == 5] == [True, True]
    assert all(r.kept and r.group_size == 2 for r in rows if r.doc_id is None)
    assert by_id[4].text_sha256 == hashlib.sha256("hello there world é".encode()).hexdigest()
    kept = exact_dedup.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 6, 7, 8, 9]


def test_index_persists_and_appends(spark):
    index = exact_dedup.open_index(spark, new_path(spark, "index"), 4)
    day1 = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(day1, index).collect()} == {
        (1, 2, False), (2, 2, True), (3, 3, True)}
    # Under another name, as in a later session; what was seen before loses, a replay does not.
    again = exact_dedup.open_index(spark, index.path, 4)
    day2 = spark.createDataFrame([(9, "B"), (3, "b"), (8, "c")], "doc_id long, text string")
    found = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(day2, again).collect()}
    assert found == {(9, 3, False), (3, 3, True), (8, 8, True)}
    third = exact_dedup.open_index(spark, index.path, 4)
    assert third.read(spark).count() == 3


def test_the_index_side_is_not_shuffled(spark):
    index = exact_dedup.open_index(spark, new_path(spark, "index"), 4)
    docs = spark.createDataFrame([(i, str(i)) for i in range(50)], "doc_id long, text string")
    exact_dedup.deduplicate(docs, index).count()
    batch = docs.select(exact_dedup.digest(docs.text).alias("digest")).repartition(4, "digest")
    plan = batch.hint("merge").join(index.read(spark), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in text


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    spans = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: by_hand(t) for i, t in texts.items()}
    links = [
        (a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3
    ]
    expected = components(prints, links)
    for r in simhash.near_groups(docs).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", expected[r.doc_id])


def test_near_copies_go_and_looser_ones_stay(spark):
    """Copies with one word in 60 changed are close; with one in 12 they fall under 0.8."""
    rows, near, loose = [], set(), set()
    for k in range(12):
        base = words(240, 100 + k)
        rows.append((k, " ".join(base)))
        for kind, every in ((100, 60), (200, 12)):
            edited = [f"new{j}" if j % every == 5 else w for j, w in enumerate(base)]
            rows.append((kind + k, " ".join(edited)))
            (near if kind == 100 else loose).add(kind + k)
    # A large group: light edits of one original, whose id is not the smallest.
    base = words(300, 1)
    group = {i: [f"e{i}" if j == i * 7 % 300 else w for j, w in enumerate(base)] for i in range(1000, 1300)}
    rows += [(i, " ".join(w)) for i, w in group.items()] + [(1500, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    assert loose <= kept and set(range(12)) <= kept
    assert kept & {*group, 1500} == {1000}
    assert len(near - kept) >= 10


def test_empty_texts_have_fingerprint_zero(odd_docs):
    rows = {r.doc_id: r for r in simhash.near_groups(odd_docs).collect()}
    assert {rows[i].fingerprint for i in (1, 2, 3)} == {"0" * 16}
    assert {rows[i].component_id for i in (1, 2, 3)} == {1}
    assert rows[None].component_id is None


def test_fuzzy_keys_meet_at_three_bits():
    """Fingerprints at every pattern of up to three flipped bits share a key."""
    random.seed(1)
    for _ in range(3000):
        x = random.getrandbits(64)
        y = x
        for b in random.sample(range(64), random.randrange(4)):
            y ^= 1 << b
        at, keys = simhash.fuzzy_keys(np.array([x, y], np.uint64))
        assert set(keys[at == 0]) & set(keys[at == 1])


def test_golay_code_is_perfect():
    leaders = simhash._golay_leaders()
    assert len(set(leaders.tolist())) == 2048 and max(x.bit_count() for x in leaders.tolist()) == 3
    assert all(simhash._syndrome(int(e)) == s for s, e in enumerate(leaders))


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    random.seed(2)
    centre = random.getrandbits(64)
    prints = set()
    while len(prints) < 300:
        x = centre
        for b in random.sample(range(64), random.randrange(6)):
            x ^= 1 << b
        prints.add(x)
    nodes = dict(enumerate(sorted(prints)))
    frame = spark.createDataFrame(
        [(x - (1 << 64) if x >> 63 else x, i) for i, x in nodes.items()], "fp long, node long"
    )
    links = simhash.linked_fingerprints(frame)
    found = components(nodes, [(r.a, r.b) for r in links.collect()])
    assert found == components(
        nodes, [(a, b) for a in nodes for b in nodes if a < b and (nodes[a] ^ nodes[b]).bit_count() <= 3]
    )
    with pytest.raises(ValueError):
        simhash.linked_fingerprints(frame, 4)


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}


def test_compact_windows_by_definition():
    random.seed(3)
    for _ in range(60):
        values = np.array([random.randrange(40) for _ in range(random.randrange(1, 60))], np.uint64)
        least = random.choice([1, 2, 5, 9])
        expected = set()
        for k, v in enumerate(values.tolist()):
            left = right = k
            while left and values[left - 1] > v:
                left -= 1
            while right + 1 < len(values) and values[right + 1] >= v:
                right += 1
            if right - left + 1 >= least:
                expected.add((k, left, right))
        assert set(passages.compact_windows(values, least)) == expected


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_passages(spark):
    shared = words(60, 1)
    edited = shared[:30] + ["changed"] + shared[31:]
    rows = [
        (1, " ".join(words(100, 2) + shared + words(50, 3))),
        (2, " ".join(shared).upper()),
        (3, " ".join(words(20, 4) + edited * 1 + words(90, 5))),
        (4, " ".join(words(300, 6))),
        (5, " ".join(words(100, 7) + shared[:40] + words(100, 8))),
        (6, " ".join(words(70, 9) * 2)),
    ]
    rows += [(i, "x " + " ".join(shared[:55]) + f" {i}") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(found) == {1, 2, 3, *range(10, 60)}
    assert (found[1].first_word, found[1].last_word) == (100, 159)
    assert (found[2].first_word, found[2].last_word, found[2].similarity) == (0, 59, 1.0)
    assert {r.class_id for r in found.values()} == {1}


def test_passages_miss_no_shared_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: lower(r.text).encode().split() for r in docs.collect()}
    where = {}
    for i, w in texts.items():
        for k in range(len(w) - 50):
            where.setdefault(tuple(w[k : k + 51]), set()).add(i)
    spans = {}
    for r in passages.repeated_passages(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.first_word, r.last_word))
        assert r.similarity >= 0.8
    for i, w in texts.items():
        for k in range(len(w) - 50):
            if len(where[tuple(w[k : k + 51])]) > 1:
                assert any(a <= k and k + 50 <= b for a, b in spans[i])


def test_passages_do_not_depend_on_the_first_window(spark):
    """The smallest id shares only a frequent line with the others, but holds the minima."""

    def lows(found):
        base = passages.shingles(" ".join(found).encode())
        return [int(passages.hashed(base, f).min()) for f in range(2)]

    # Its shingles are the smallest of all under both functions.
    line = min((words(20, k) for k in range(1000, 1400)), key=lambda w: max(lows(w)))
    around = (words(25, k) + line + words(25, k + 1) for k in range(2000, 4000, 2))
    texts = [w for w in (next(around) for _ in range(40)) if lows(w) == lows(line)][:4]
    shared = texts[1]
    edited = shared[:2] + ["changed"] + shared[3:]
    rows = [(1, texts[0]), (2, shared), (3, shared + ["end"]), (4, texts[2]), (5, edited), (6, texts[3])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert set(found) == {2, 3, 5}
    assert {r.class_id for r in found.values()} == {2}
    assert (found[3].first_word, found[3].last_word) == (0, 69)


def test_later_windows_of_the_first_document(spark):
    shared = words(60, 21)
    rows = [
        (1, words(30, 22) + shared + words(200, 23) + shared + words(30, 24)),
        (2, words(10, 25) + shared),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r.doc_id, r.first_word, r.last_word) for r in passages.repeated_passages(docs).collect()}
    assert found == {(1, 30, 89), (1, 290, 349), (2, 10, 69)}


def spans_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.first_word, r.last_word))
    return out


def overlap_by_force(texts, least=46, similarity=0.8):
    """{(a, b): spans in a} of alike passages, all documents that share enough shingles compared."""
    arrays = {i: passages.shingles(t.encode()) for i, t in texts.items()}
    where = {}
    for i, values in arrays.items():
        for v in set(values.tolist()):
            where.setdefault(v, []).append(i)
    common = Counter()
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a != b:
                    common[a, b] += 1
    return {
        (a, b): passages.alike_spans(arrays[a], arrays[b], least, similarity)
        for (a, b), n in common.items()
        if n >= similarity * least
    }


def test_recall_of_passages_by_band(spark):
    """Every document with a passage by brute force is found, in each band of similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = spans_of(passages.repeated_passages(docs).collect())
    met, all_ = Counter(), Counter()
    for (a, _), spans in overlap_by_force(texts).items():
        for first, last, _, _, jaccard in spans:
            band = 1.0 if jaccard == 1.0 else 0.9 if jaccard >= 0.9 else 0.8
            all_[band] += 1
            covered = max((min(last + 4, y) - max(first, x) + 1 for x, y in found.get(a, [])), default=0)
            met[band] += covered >= 0.9 * (last + 5 - first)
    assert all_[0.8] >= 10 and all(met[k] >= 0.9 * all_[k] for k in all_), (met, all_)


def test_recall_of_planted_passages(spark):
    """Passages of 60 to 120 words with words changed, put in or left out, in unlike documents."""
    r = random.Random(11)
    rows, planted = [], {}
    for k in range(150):
        base = words(r.randrange(60, 121), 5000 + k)
        copy = list(base)
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([["edit"], [], [copy[at], "more"]])
        spans = [set(passages.shingles(" ".join(x).encode()).tolist()) for x in (base, copy)]
        jaccard = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
        rows.append((k, " ".join(words(r.randrange(200), 7000 + k) + base + words(30, 8000 + k))))
        rows.append((1000 + k, " ".join(words(20, 9000 + k) + copy + words(r.randrange(200), 10000 + k))))
        planted[k] = jaccard
    found = spans_of(passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    for lo, hi in ((0.8, 0.9), (0.9, 1.01)):
        band = [k for k, j in planted.items() if lo <= j < hi]
        met = sum(k in found and 1000 + k in found for k in band)
        assert len(band) >= 15 and met >= 0.9 * len(band), (met, len(band))
    # What is found is alike: no document of a pair below 0.7.
    assert not [k for k, j in planted.items() if j < 0.5 and k in found]


def test_passages_of_odd_rows(spark):
    shared = words(60, 61)
    lesser, larger = "a " + " ".join(shared), "zz " + " ".join(words(80, 62))
    rows = [
        (1, " ".join(shared) + " end"), (2, "start " + " ".join(shared)), (None, " ".join(shared)),
        (5, lesser), (5, larger), (6, " ".join(shared)), (6, " ".join(shared)), (7, None), (8, ""),
    ]
    full = [r + ("x", 1, 2.0, "y") for r in rows]
    schema = "doc_id long, text string, value string, doc int, similarity double, class_id string"
    docs = spark.createDataFrame(full, schema)
    found = sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    # Of the texts under 5 the larger one counts, which has no partner.
    assert found == [(1, 0, 59, 1, 2, 1.0), (2, 1, 60, 1, 1, 1.0), (6, 0, 59, 1, 1, 1.0)]


def test_equal_fingerprints_of_unlike_texts_are_all_compared(spark):
    """A line repeated most often rules all fingerprints; the smallest id is alike none of the others."""
    line = " ".join(words(3, 31) * 2000)
    body = words(60, 32)
    rows = [(1, f"{line} {' '.join(words(60, 33))}"), (2, f"{line} {' '.join(body)}")]
    rows += [(3, f"{line} {' '.join(body[:-1])} new"), (4, f"{line} {' '.join(words(60, 34))}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [near_copies.prints_of(text.encode()) for _, text in rows]
    assert len({tuple(single) for _, single in prints}) == 1
    assert max((a ^ b).bit_count() for a, _ in prints for b, _ in prints) <= near_copies.WIDE
    assert {r.doc_id for r in near_copies.one_of_each(docs).collect()} == {1, 2, 4}


def near_by_force(texts, similarity=0.8):
    """Links (a, b) of alike texts that both meet another one in the search, everything compared."""
    prints = {i: near_copies.prints_of(t.encode()) for i, t in texts.items()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) or {0} for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for v in s:
            where.setdefault(v, []).append(i)
    common = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    alike = {
        (a, b): n / (len(sets[a]) + len(sets[b]) - n)
        for (a, b), n in common.items()
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n)
    }
    meets = {
        (a, b)
        for a in texts
        for b in texts
        if a < b
        and (prints[a][0] ^ prints[b][0]).bit_count() <= near_copies.WIDE
        and any((x ^ y).bit_count() <= 3 for x, y in zip(prints[a][1], prints[b][1]))
    }
    members = {i for pair in meets for i in pair}
    wide = {p for p in alike if (prints[p[0]][0] ^ prints[p[1]][0]).bit_count() <= near_copies.WIDE}
    return alike, [p for p in wide if set(p) <= members]


def test_near_copies_equal_brute_force(spark, monkeypatch):
    """Groups of edited copies, chains of edits, unlike texts; keys in several blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    r = random.Random(5)
    texts = {}
    for group in range(6):
        base = words(120, 40 + group)
        for k in range(12):
            texts[100 * group + k] = " ".join(base)
            # A chain drifts away from its start, a star comes back to it.
            copy = base if group % 2 else list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(120)] = f"e{group}x{k}"
            texts[100 * group + k] = " ".join(copy)
    for k in range(40):
        texts[1000 + k] = " ".join(words(r.randrange(1, 200), 500 + k))
    texts |= {2000: "", 2001: " \n", 2002: "one", 2003: "one two", 2004: "one"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    _, links = near_by_force(texts)
    kept = {x.doc_id for x in near_copies.one_of_each(docs).collect()}
    assert kept == set(components(texts, links).values()) and len(kept) < len(texts) - 40


def test_every_meeting_in_large_keys_is_found(spark, monkeypatch):
    """Fingerprints crowded around two centres, keys in many blocks: the members equal brute force."""
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    r = random.Random(3)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    centres = [[r.getrandbits(64) for _ in range(near_copies.PRINTS)] for _ in range(2)]
    rows = []
    for node in range(240):
        prints = [c ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for c in centres[node % 2]]
        rows.append((node, r.getrandbits(3) << 40 if node % 5 else r.getrandbits(63), prints))
    expected = {
        a for a, wide, x in rows for b, other, y in rows
        if a != b and (wide ^ other).bit_count() <= near_copies.WIDE
        and any((p ^ q).bit_count() <= 3 for p, q in zip(x, y))
    }
    frame = spark.createDataFrame(
        [(n, w, [signed(p) for p in x]) for n, w, x in rows], "node long, wide long, prints array<long>"
    )
    assert {x.node for x in near_copies.near_nodes(frame.repartition(3)).collect()} == expected
    assert len(expected) > 50


def test_a_crowd_of_equal_fingerprints_meets_under_one_key(spark, monkeypatch):
    """Many documents of one fingerprint and some around it: all meetings are found, and few pairs compared."""
    monkeypatch.setattr(near_copies, "BLOCK", 40)
    r = random.Random(9)
    centre = [r.getrandbits(64) for _ in range(near_copies.PRINTS)]
    rows = []
    for node in range(360):
        flips = 0 if node < 260 else r.randrange(1, 6)
        prints = [c ^ sum(1 << b for b in r.sample(range(64), flips)) for c in centre]
        wide = r.getrandbits(64) if node % 9 else rows[-3][1] ^ 7 if rows else 0
        rows.append((node, wide, prints))
    expected = {
        a for a, wide, x in rows for b, other, y in rows
        if a != b and (wide ^ other).bit_count() <= near_copies.WIDE
        and any((p ^ q).bit_count() <= 3 for p, q in zip(x, y))
    }
    assert 20 < len(expected) < 200
    signed = [(n, *(v - (1 << 64) if v >> 63 else v for v in (w, *x))) for n, w, x in rows]
    frame = spark.createDataFrame([(n, w, x) for n, w, *x in signed], "node long, wide long, prints array<long>")
    assert {x.node for x in near_copies.near_nodes(frame.repartition(3)).collect()} == expected

    # The same with the pairs counted, keys not dealt.
    fps, wides = np.array([x[0] for *_, x in rows], np.uint64), np.array([w for _, w, _ in rows], np.uint64)
    at, keys = simhash.fuzzy_keys(fps)
    compared, bit_count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(x.size), bit_count(x))[1])
    met = np.zeros(len(rows), bool)
    for key in np.unique(keys):
        under = at[keys == key]
        met[under] |= near_copies.near_others(fps[under], wides[under], int(key))
    near = bit_count(wides[:, None] ^ wides) <= near_copies.WIDE
    near &= bit_count(fps[:, None] ^ fps) <= 3
    assert (met == (near.sum(axis=1) > 1)).all()
    # At least four keys hold all of the crowd.
    assert sum(compared) < 2 * 260**2 + 260 * sum((keys == k).sum() for k in np.unique(keys[at < 260])) / 2


def test_links_equal_brute_force_where_keys_are_common(spark):
    """Sets of few different shingles, so that classes are large and unlike sets share them."""
    r = random.Random(7)
    sets = {i: sorted(r.sample(range(14), r.randrange(3, 13))) for i in range(90)}
    frame = spark.createDataFrame([(i, 0, s) for i, s in sets.items()], "node long, wide long, hashes array<long>")
    found = [(x.a, x.b) for x in near_copies.links_of(frame, 0.8).collect()]
    expected = [
        (a, b) for a in sets for b in sets
        if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    ]
    assert {tuple(sorted(x)) for x in found} <= set(expected)
    assert components(sets, found) == components(sets, expected)


def test_links_of_a_group_around_the_bound(spark, monkeypatch):
    """Copies whose similarities lie on both sides of the bound, compared in small tiles."""
    monkeypatch.setattr(near_copies, "TILE", 256)
    r = random.Random(11)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(100)]
    spare = [r.getrandbits(64) - (1 << 63) for _ in range(300)]
    sets = {}
    for i in range(120):
        edits = r.randrange(0, 22)
        sets[i] = sorted(r.sample(base, 100 - edits) + r.sample(spare, edits))
    frame = spark.createDataFrame([(i, 0, s) for i, s in sets.items()], "node long, wide long, hashes array<long>")
    asked, compare = [], near_copies.alike

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(near_copies, "alike", counted)
    found = [(x.a, x.b) for x in near_copies.links_of(frame, 0.8).collect()]
    expected = [
        (a, b) for a in sets for b in sets
        if a < b and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))
    ]
    assert {tuple(sorted(x)) for x in found} <= set(expected)
    assert components(sets, found) == components(sets, expected)
    assert sum(asked) < 120 * 119 / 2 / 4


def test_components_go_on_from_those_of_earlier_rounds(spark, monkeypatch):
    """A round's components are made of those before it and its own links, not of all links again."""
    r = random.Random(5)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(60)]
    sets = {i: sorted(base[:46] + base[46 + i % 12 : 48 + i % 12] + [10**6 + i] * (i % 3)) for i in range(150)}
    sets = {i: sorted(set(s)) for i, s in sets.items()}
    # Half shares only some of the base, so its members stay apart from the centre and come later.
    sets |= {i: sorted({*base[30:], *(10**7 + i % 5 + k for k in range(2))}) for i in range(150, 200)}
    frame = spark.createDataFrame([(i, 0, s) for i, s in sets.items()], "node long, wide long, hashes array<long>")
    given, compare, connect, new = [], near_copies.alike, near_copies.connected, []

    def counted(*args):
        out = compare(*args)
        new.append(out.count())
        return out

    def seen(links):
        given.append(links.count())
        return connect(links)

    monkeypatch.setattr(near_copies, "alike", counted)
    monkeypatch.setattr(near_copies, "connected", seen)
    links, parts = near_copies.linked(frame, 0.8)
    assert len(new) > 1 and links.count() == sum(new)
    assert len(given) == sum(n > 0 for n in new)
    found = components(sets, [(x.a, x.b) for x in links.collect()])
    assert found == components(sets, [(x.node, x.component) for x in parts.collect()])


def test_shared_windows_come_in_parts(spark, monkeypatch):
    """Every row whose value comes again is there once, whatever part its value is in; no part takes all."""
    r = random.Random(3)
    values = [r.getrandbits(64) - (1 << 63) for _ in range(900)]
    rows = [(r.choice(values), doc, r.randrange(9), 0, 9) for doc in range(60) for _ in range(20)]
    windows = written(spark.createDataFrame(rows, "value long, doc long, at int, left int, right int"), "windows")
    sizes, store = [], passages.stored

    def seen(df, name):
        out = store(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(passages, "stored", seen)
    times = Counter(x[0] for x in rows)
    found = sorted(tuple(x) for x in passages._shared(windows).collect())
    assert found == sorted((*x, times[x[0]]) for x in rows if times[x[0]] > 1)
    several = sum(n > 1 for n in times.values())
    assert sum(sizes) == several and len(sizes) > 1 and max(sizes) < several / 3
    # A value that only one document has, twice, brings it together with no one.
    alone = spark.createDataFrame([(8, 1, 3, 0, 9), (8, 1, 20, 15, 29)], windows.schema)
    assert passages._facing(written(alone, "windows")).count() == 0


def test_windows_go_when_they_have_been_read(spark):
    """Every part of the stored windows is deleted after its last use; rows that are needed later stay."""
    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).iterdir())
    shared = words(60, 81)
    rows = [(k, " ".join(words(40, 82 + k) + shared)) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(x) for x in passages.repeated_passages(docs).collect())
    assert found == [(k, 40, 99, 0, int(k == 0), 1.0) for k in range(6)]
    made = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).iterdir()) - before
    windows = [x for x in made if x.name.startswith("windows-")]
    assert windows and not [f for x in windows for f in x.rglob("*.parquet")]


def test_a_set_is_sent_once_for_many_pairs(spark, monkeypatch):
    """All pairs of a group need few copies of a set, and the pairs of a hub are in many slots."""
    monkeypatch.setattr(passages, "SIDE", 8)
    group = [(a, b) for a in range(60) for b in range(a)]
    star = [(1000 + k, 999) for k in range(1000)]
    pairs = written(spark.createDataFrame(group + star, "a long, b long"), "pairs")
    found = passages._slots(pairs).collect()
    assert sorted((x.a, x.b) for x in found) == sorted(group + star)
    held = {(x.slot, doc) for x in found for doc in (x.a, x.b)}
    assert len([1 for _, doc in held if doc < 60]) < 60 * 20
    assert len([1 for _, doc in held if doc >= 1000]) == 1000
    of_hub = Counter(x.slot for x in found if x.b == 999)
    assert len(of_hub) > 20 and max(of_hub.values()) < 100


def test_without_equals_anti_join(spark, monkeypatch):
    """Full and nearly empty maps, null keys, rows that repeat, keys that fall on a set bit by chance."""
    rows = spark.range(5000).selectExpr("if(id % 97 = 0, null, id % 4000) AS id", "id % 3 AS digest", "id AS doc")
    for bits, step in ((1 << 15, 2), (1 << 23, 50), (1 << 23, 10**6)):
        monkeypatch.setattr("duefold.llm.common.MAP_BITS", bits)
        gone = written(
            spark.range(1, 4000, step).selectExpr("if(id % 11 = 0, null, id) AS id", "id % 3 AS digest"), "gone"
        )
        expected = rows.join(gone, ["id", "digest"], "left_anti")
        found = without(rows, gone, ["id", "digest"])
        assert found.columns == rows.columns
        assert sorted(x.doc for x in found.collect()) == sorted(x.doc for x in expected.collect())
    nothing = written(gone.where("false"), "gone")
    assert without(rows, nothing, ["id", "digest"]).count() == 5000


def test_recall_of_the_search_by_band(spark):
    """Of all pairs at 0.8 or more, found without any search, at least 0.9 in each band are linked."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {}
    for x in docs.collect():
        key = lower(x.text)
        texts[key] = max(texts.get(key, -1), x.doc_id)
    texts = {i: t for t, i in texts.items()}
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t in texts.items()}
    where = {}
    for i, s in sets.items():
        for v in sorted(s)[: len(s) - int(0.8 * len(s)) + 1]:
            where.setdefault(v, []).append(i)
    pairs = {(a, b) for ids in where.values() if len(ids) < 3000 for a in ids for b in ids if a < b}
    prints = {}
    met, all_ = Counter(), Counter()
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        jaccard = n / max(1, len(sets[a]) + len(sets[b]) - n)
        if jaccard >= 0.8:
            band = 0.9 if jaccard >= 0.9 else 0.85 if jaccard >= 0.85 else 0.8
            for i in (a, b):
                prints.setdefault(i, near_copies.prints_of(texts[i].encode()))
            (wide_a, x), (wide_b, y) = prints[a], prints[b]
            all_[band] += 1
            met[band] += (wide_a ^ wide_b).bit_count() <= near_copies.WIDE and any(
                (p ^ q).bit_count() <= 3 for p, q in zip(x, y)
            )
    assert all_[0.8] > 20 and all(met[k] >= 0.9 * all_[k] for k in all_), (met, all_)


def test_texts_under_one_id_are_judged_each(spark):
    base = words(240, 51)
    copy = " ".join(["new"] + base[1:])
    clean = {"a": "zz " + " ".join(words(50, 52)), "b": "aa " + " ".join(words(50, 53))}
    rows = [(1, " ".join(base)), (5, copy), (5, clean["a"]), (5, clean["b"]), (5, clean["b"]), (None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in near_copies.one_of_each(docs).collect())
    assert kept == sorted([(0, copy), rows[0], rows[2], rows[3], rows[4]])


def test_no_alike_pair_of_passages_is_missed(spark):
    """A group of edited copies of one passage, in unlike documents: classes by all pairs, each span covered."""
    r = random.Random(5)
    base = words(70, 71)
    rows = []
    for k in range(90):
        copy = list(base)
        for at in r.sample(range(70), r.randrange(0, 4)):
            copy[at] = f"edit{k}x{at}"
        rows.append((k, " ".join(words(r.randrange(60), 20000 + k) + copy + words(r.randrange(60), 30000 + k))))
    # A line that all have, a chain of halves, and copies of one text.
    rows = [(i, t + " " + " ".join(words(12, 72))) for i, t in rows]
    chain = [words(60, 40000 + k) for k in range(6)]
    rows += [(200 + k, " ".join(chain[k] + words(9, 50000 + k) + chain[k + 1])) for k in range(5)]
    rows += [(300, rows[3][1].upper()), (301, rows[3][1])]
    rows += [(400 + k, ("ha " * 60) + " ".join(words(30, 60000 + k))) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    linked = overlap_by_force({i: t.lower() for i, t in texts.items()}, least=1)
    arrays = {i: passages.shingles(t.encode()) for i, t in texts.items()}
    linked = {(a, b): passages.alike_spans(arrays[a], arrays[b], 46, 0.8) for a, b in linked}
    linked = {k: v for k, v in linked.items() if v}
    classes = components(texts, linked)
    for few in (passages.FEW, 4):
        found = passages.repeated_passages(docs, few=few).collect()
        assert {r.doc_id: r.class_id for r in found} == {i: classes[i] for pair in linked for i in pair}
        spans = spans_of(found)
        for (a, _), held in linked.items():
            for first, last, *_ in held:
                covered = max(min(last + 4, y) - max(first, x) + 1 for x, y in spans[a])
                assert covered >= 0.9 * (last + 5 - first)


def test_thin_stretches_by_definition():
    r = random.Random(3)
    for _ in range(200):
        weights = [r.choice([0.8, 0.0, -0.2]) for _ in range(r.randrange(0, 30))]
        least, most = r.randrange(1, 8), r.choice([-1, 0, 2])
        expected = [False] * len(weights)
        for x in range(len(weights)):
            for y in range(x + least, len(weights) + 1):
                if sum(weights[x:y]) <= most + 1e-6:
                    expected[x:y] = [True] * (y - x)
        assert passages.thin_stretches(np.array(weights), least, most).tolist() == expected
