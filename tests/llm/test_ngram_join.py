import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from boscage.llm import ngram_join as nj

from .helpers import awkward, empty


def brute_sets(texts):
    out = {}
    for i, t in texts:
        if i is None or t is None:
            continue
        folded = bytes(nj.FOLD[list(t.encode())].tolist()) if t else b""
        w = folded.split()
        if w:
            out[i] = frozenset(tuple(w[k : k + nj.WORDS]) for k in range(max(1, len(w) - nj.WORDS + 1)))
    return out


def brute_pairs(texts, threshold):
    sets = brute_sets(texts)
    out = {}
    for a, b in combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= threshold - 1e-12:
            out[a, b] = j
    return out


def expand(rows):
    out = {}
    for r in rows:
        for a in r.left_ids:
            for b in r.right_ids:
                if a != b:
                    out[min(a, b), max(a, b)] = r.jaccard
    return out


def corpus(seed, n=60):
    """Originals, exact copies, near copies by degrees, shared passages."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + [f"rare{k}" for k in range(400)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out)[1].split()
            for _ in range(r.choice([0, 0, 1, 2, 5, 15])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = [r.choice(words)]
            t = " ".join(w)
        else:
            t = " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 5, 40, 150]))) + (" " + passage if r.random() < 0.3 else "")
        out.append((len(out), t.upper() if r.random() < 0.1 else t))
    return out


@pytest.mark.parametrize("seed,threshold", [(1, 0.6), (2, 0.3), (3, 0.85), (4, 1.0)])
def test_equals_brute_force(spark, monkeypatch, seed, threshold):
    monkeypatch.setattr(nj, "FREQUENT", 3)
    texts = corpus(seed)
    got = nj.similar(spark.createDataFrame(texts, "doc_id long, text string"), threshold).collect()
    have, want = expand(got), brute_pairs(texts, threshold)
    assert have.keys() == want.keys()
    assert all(abs(have[k] - want[k]) < 1e-9 for k in want)
    covered = [(min(a, b), max(a, b)) for r in got for a in r.left_ids for b in r.right_ids if a != b and (r.left_ids != r.right_ids or a < b)]
    assert len(covered) == len(set(covered))


def components(pairs, nodes):
    first = {n: n for n in nodes}

    def root(x):
        while first[x] != x:
            x = first[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        first[y] = x
    return {n: root(n) for n in nodes}


def test_keep_one(spark):
    texts = corpus(9) + [(None, "null id"), (None, "null id"), (500, None), (501, ""), (502, "...")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, extra int")
    got = nj.keep_one(docs).collect()
    first = components(brute_pairs(texts, nj.THRESHOLD), [i for i, _ in texts if i is not None])
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i, f in first.items() if i == f)
    assert sum(r.doc_id is None for r in got) == 2
    assert got[0].asDict().keys() == {"doc_id", "text", "extra"}


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(3, 9), (9, 5), (7, 7)]
    got = {r.node: r.first for r in nj.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, 5: 3, 9: 3}


def test_awkward_rows(spark):
    docs = awkward(spark)
    pairs = expand(nj.similar(docs).collect())
    assert {(0, 1), (0, 50), (1, 50)} <= pairs.keys()
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 50 not in ids and ids.count(None) == 1 and {2, 3, 4, 5} <= set(ids)
    assert nj.similar(empty(spark)).collect() == [] and nj.keep_one(empty(spark)).collect() == []


def test_gram_sets():
    texts = ["", None, "a", "a b", "a b c", "A  b, C!", "a b c d", "b c d", "x " * 50, "é à"]
    grams, edges = nj.gram_sets(pa.array(texts, pa.string()))
    sets = [grams[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 1, 1, 2, 1, 1, 1]
    assert sets[4] == sets[5] and set(sets[7]) < set(sets[6]) and sets[2] != sets[3]
    assert all(s == sorted(set(s)) for s in sets)


def test_meetings_count_every_pair():
    groups = np.array([256, 512, 768, 256, 1024] + list(range(256, 256 * 1300, 256)), np.uint64)
    starts = np.array([0, 3, 5])
    pairs, times = nj._added_up(list(nj._meetings(groups, starts, 9)))
    want = defaultdict(int)
    for a, b in ((0, 3), (3, 5), (5, len(groups))):
        for x, y in combinations(groups[a:b].tolist(), 2):
            want[x, y] += 1
    assert dict(zip(map(tuple, pairs.tolist()), times.tolist())) == want


def brute_classes(rows, threshold):
    """{doc_id: (class, copies, links)} of rows (doc_id, text), by comparing all sets."""
    sets = defaultdict(set)
    ids = {i for i, _ in rows if i is not None}
    for i, t in rows:
        found = brute_sets([(i, t)])
        if found:
            sets[found[i]].add(i)
    near = [(a, b) for a, b in combinations(sets, 2) if len(a & b) / len(a | b) >= threshold - 1e-12]
    edges = [(min(sets[a]), min(sets[b])) for a, b in near] + [(i, min(own)) for own in sets.values() for i in own]
    first = components(edges, ids)
    links = defaultdict(int)
    for pair in near:
        for x in pair:
            links[x] += 1
    return {i: (first[i], sum(len(own) - 1 for own in sets.values() if i in own), sum(links[s] for s, own in sets.items() if i in own)) for i in ids}


@pytest.mark.parametrize("seed,threshold", [(11, 0.6), (12, 0.35), (13, 1.0)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, threshold):
    monkeypatch.setattr(nj, "BLOCK", 2)
    rows = corpus(seed) + [(1, "a b c d"), (1, "x y z w"), (2, "a b c d"), (300, "x y z w"), (3, None), (400, ""), (401, None), (None, "a b c d"), (402, "a b c d"), (402, "a b c d")]
    got = nj.classes(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in got} == brute_classes(rows, threshold)


def test_classes_of_sets_with_one_prefix(spark, monkeypatch):
    """Sets that differ only behind their prefix are one group, and meet in tiles."""
    monkeypatch.setattr(nj, "BLOCK", 2)
    often = [f"c{k}" for k in range(40)]
    rare = " ".join(f"r{k}" for k in range(30))
    rows = [(k, " ".join(often[j : j + 12])) for j in range(28) for k in range(1000 + 40 * j, 1040 + 40 * j)]
    rows += [(k, f"{rare} . " + " ".join(often[k : k + 12])) for k in range(25)]
    got = nj.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 0.5).collect()
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in got} == brute_classes(rows, 0.5)


def test_classes_of_awkward_rows(spark):
    got = {r.doc_id: r for r in nj.classes(awkward(spark)).collect()}
    assert None not in got and got[0].class_id == got[1].class_id == got[50].class_id == 0 and got[0].copies == 2
    assert all((got[i].class_id, got[i].copies, got[i].links) == (i, 0, 0) for i in (2, 3, 4, 5))
    assert nj.classes(empty(spark)).collect() == []


def test_blocks_of_a_long_list_meet_as_the_list_does(monkeypatch):
    monkeypatch.setattr(nj, "LIST", 7)
    r = np.random.default_rng(3)
    members = np.unique(r.integers(1, 1 << 40, 60, dtype=np.uint64) << np.uint64(8) | r.integers(0, 60, 60, dtype=np.uint64))
    want = {tuple(p) for p in np.concatenate(list(nj._meetings(members, np.array([0]), 9))).tolist()}
    got = []
    for x, y in nj._blocks(members, 9):
        found = nj._across(x, y, 9) if len(y) else nj._meetings(np.sort(x), np.array([0]), 9)
        got += [tuple(p) for part in found for p in part.tolist()]
    assert len(got) == len(set(got)) and set(got) == want


def near_copies(seed, n):
    """A text of 70 words and copies with some words changed, of which some are alike and some aren't; ids from 2000."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(70)]
    return [(2000 + k, " ".join(f"x{r.randrange(500)}" if r.random() < share else w for w in base[: r.randint(60, 70)])) for k in range(n) for share in [r.choice([0, 0.02, 0.05, 0.1])]]


def test_near_copies_of_one_text_meet_in_tiles(spark, monkeypatch):
    """Pairs of a large cluster are neither meetings nor rows of candidates, and none is lost or counted twice."""
    monkeypatch.setattr(nj, "BLOCK", 4)
    monkeypatch.setattr(nj, "CROWD", 2)
    rows = near_copies(5, 90) + corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    placed, stored = [], nj.stored
    monkeypatch.setattr(nj, "stored", lambda df, name: placed.append(df.count()) or stored(df, name) if name == "ngram-candidates" else stored(df, name))
    got = nj.classes(docs).collect()
    want = brute_classes(rows, nj.THRESHOLD)
    assert {r.doc_id: (r.class_id, r.copies, r.links) for r in got} == want
    assert sum(v[2] for k, v in want.items() if k >= 2000) > 10 * placed[0]
    assert expand(nj.similar(docs).collect()).keys() == brute_pairs(rows, nj.THRESHOLD).keys()


def test_overlaps_and_forests_of_tiles():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(40)]
    assert nj._overlaps(sets[:15], sets[15:]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]
    near = np.triu(r.random((40, 40)) < 0.03, 1)
    one, all_at_once = nj._Forest(), nj._Forest()
    for i, j in np.argwhere(near).tolist():
        one.add(i, j)
    all_at_once.add_all(np.arange(40), np.arange(40), near)
    assert one.links == all_at_once.links and all(one.root(x) == all_at_once.root(x) for x in one.links)


def test_all_frequent_grams_go_behind_the_rare_ones(spark, monkeypatch):
    """Also those that aren't among the most frequent."""
    monkeypatch.setattr(nj, "FREQUENT", 3)
    monkeypatch.setattr(nj, "ORDERED", 2)
    texts = [f"often is this and {'also that' if k < 9 else 'never'} but own{k} and own{k} alone" for k in range(12)]
    order = nj.frequent(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2), 4)
    grams, _ = nj.gram_sets(pa.array(texts))
    every, times = np.unique(grams, return_counts=True)
    assert len(order.keys) == 2 and np.count_nonzero(times > 3) > 4
    assert (order.ranks(every[times > 3]) > 0).all() and np.count_nonzero(order.ranks(every[times > 3]) > 1) == 2
    assert np.count_nonzero(order.ranks(every[times == 1])) < 2
