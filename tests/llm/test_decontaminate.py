import random

from boscage.llm import decontaminate as dc

from .helpers import awkward, empty


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = dc.fold(*dc.utf8_buffer(dc.pa.array([t])))[0].split() if t else []
        for i, s in items:
            v = dc.fold(*dc.utf8_buffer(dc.pa.array([s])))[0].split() if s else []
            n = min(len(v), dc.WORDS)
            runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "x", "é", "42"]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 5, 13, 14, 30])))) for k in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, "alpha-BETA; x")]
    docs = []
    for k in range(150):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        if r.random() < 0.4:
            s = r.choice(items)[1] or ""
            t = f"{t}, {s.upper()}. {t}"
        docs.append((k, t))
    docs += [(200, None), (201, ""), (202, "alphabeta"), (203, "delta " * 20_000 + items[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(d, b).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert sorted(r.doc_id for r in dc.keep(d, b).collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})


def test_awkward_rows(spark):
    docs = awkward(spark)
    b = spark.createDataFrame([(1, "sentence of several"), (1, "sentence of several"), (None, "words"), (2, "no such thing")], "item_id long, text string")
    got = dc.leaks(docs, b).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id) for r in got) == [(False, 0, 1), (False, 0, 1), (False, 1, 1), (False, 50, 1), (True, 0, 1)]
    kept = dc.keep(docs, b)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == list(range(2, 11))
    none = b.limit(0)
    assert dc.leaks(docs, none).collect() == [] and dc.keep(docs, none).count() == docs.count()
    assert dc.leaks(empty(spark), b).collect() == [] and dc.keep(empty(spark), b).collect() == []


def test_several_passes(spark, monkeypatch):
    monkeypatch.setattr(dc, "PASS_BYTES", 10)
    d = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "seven")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dc.leaks(d, b).collect()) == [(1, 1), (2, 2)]
    assert [r.doc_id for r in dc.keep(d, b).collect()] == [3]


def test_passes_never_change_the_result(spark, monkeypatch):
    r = random.Random(8)
    word = lambda: r.choice("alpha beta gamma delta eps".split())
    items = [(k % 6, " ".join(word() for _ in range(r.choice([2, 3, 16])))) for k in range(14)]
    docs = [(k % 40, " ".join(word() for _ in range(60))) for k in range(50)] + [(3, "alpha " * 30), (3, "alpha " * 30)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    said = lambda: sorted(map(tuple, dc.leaks(d, b).collect()))
    whole, kept = said(), sorted(map(tuple, dc.keep(d, b).collect()))
    monkeypatch.setattr(dc, "PASS_BYTES", 40)
    assert dc._Passes(b).parts > 3
    assert whole and said() == whole and sorted(map(tuple, dc.keep(d, b).collect())) == kept
