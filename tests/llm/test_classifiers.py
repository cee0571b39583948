import numpy as np
import pyarrow as pa
import pytest

from boscage.llm import host_rules, langid, toxicity

from .helpers import LONG, awkward, empty


def held_out(spark, sf, name):
    path = f"/root/testdata/{sf}"
    return path, spark.read.parquet(f"{path}/{name}.parquet")


def test_toxicity_held_out(spark):
    path, labels = held_out(spark, "sf0.1", "labels")
    said = {r.doc_id: r.toxic for r in toxicity.query(spark, path).collect()}
    rows = labels.collect()
    caught = [said[r.doc_id] for r in rows if r.toxic]
    wrong = [said[r.doc_id] for r in rows if r.toxic == 0]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.02


def test_toxicity_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1, 0), (8, 1, 0), (1, 1, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0), labels.where("toxic = 1")):
        model = toxicity.train(docs, l)
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count()
        assert all(not r.toxic and r.score == 0 and r.windows == 0 for r in got if r.doc_id in (2, 3))
        assert len({(r.windows, r.score, r.toxic) for r in got if r.doc_id in (0, 1, 50, None)}) == 1
        assert next(r.windows for r in got if r.doc_id == 8) == len(toxicity.windows(toxicity.coded(LONG))) > 400
        kept = toxicity.keep(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in got)
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score(empty(spark), None).collect() == []


def test_toxicity_windows_cover_the_text():
    for n in (1, 15, 16, 17, 255, 256, 257, 5000):
        data = bytes(i % 251 for i in range(n))
        found = toxicity.windows(data)
        step = toxicity.WINDOW - toxicity.OVERLAP
        assert b"".join(w[: step if k + 1 < len(found) else None] for k, w in enumerate(found)) == data


def test_language_held_out(spark):
    path, docs = held_out(spark, "sf0.1", "documents")
    said = {r.doc_id: r for r in langid.query(spark, path).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert np.mean([said[r.doc_id].detected == r.lang for r in rows]) > 0.98
    assert np.mean([said[r.doc_id].keep for r in rows]) > 0.98


def test_language_sets_have_no_false_negatives():
    texts = {"a": ["some english words here and there"] * 2, "b": ["einige deutsche worte hier und dort"] * 2}
    model = langid.fit(texts)
    for k, name in enumerate(model.languages):
        share, total, letters = langid.shares(model, pa.array(texts[name]))
        assert letters.all() and (total > 0).all() and share.argmax(axis=1).tolist() == [k, k] and share[:, k].min() > 0.999


def test_language_awkward_rows(spark):
    docs = awkward(spark)
    for d in (docs, docs.limit(0), docs.withColumn("lang", docs.lang.substr(0, 0))):
        model = langid.train(d)
        got = langid.identify(docs, model).collect()
        assert len(got) == docs.count()
        assert all(r.detected == "und" and not r.keep for r in got if r.doc_id in (2, 3, 4, 5))
        assert next(r.keep for r in got if r.doc_id == 6)
        assert len({(r.detected, r.share, r.keep) for r in got if r.doc_id in (0, 1, 50, None)}) == 1
        kept = langid.keep(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert langid.identify(empty(spark), langid.train(docs)).collect() == []


def test_more_languages_than_a_plane_has_bits():
    word = lambda k: "".join(chr(97 + (k * p + p) % 26) for p in (1, 3, 5, 7, 11, 17))
    texts = {f"l{k:03}": [f"{word(k)} {word(k)[::-1]} x{chr(97 + k % 26)}{chr(97 + k // 26)}zq" * 6] * 2 for k in range(150)}
    model = langid.fit(texts)
    assert model.slots.shape[0] == 3
    for k, name in enumerate(model.languages):
        share, _, _ = langid.shares(model, pa.array(texts[name]))
        assert share[0, k] > 0.999


def test_shares_equal_exact_sets():
    """The corrected filter counts against sets of n-grams, for each language and text."""
    r = np.random.default_rng(5)
    syllables = {"a": ["the", "ing", "wh", "ou", "st"], "b": ["sch", "ung", "ei", "ch", "der"], "c": ["eau", "oi", "que", "les", "ais"]}
    text = lambda l: " ".join("".join(r.choice(syllables[l], r.integers(1, 4))) for _ in range(120))
    train = {l: [text(l) for _ in range(30)] for l in syllables}
    model = langid.fit(train)

    def grams(t):
        out = []
        for w in [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "]:
            b = w.encode()
            out += [b[i : i + 4] for i in range(len(b) - 3)]
        return out

    sets = {}
    for l, own in train.items():
        count = {}
        for t in own:
            for g in grams(t):
                count[g] = count.get(g, 0) + 1
        sets[l] = {g for g, n in count.items() if n > 1}
    for l in syllables:
        t = text(l)
        share, total, _ = langid.shares(model, pa.array([t]))
        own = grams(t)
        assert total[0] == len(own)
        for k, name in enumerate(model.languages):
            assert abs(share[0, k] - sum(g in sets[name] for g in own) / len(own)) < 0.02
        assert model.languages[share[0].argmax()] == max(sets, key=lambda x: sum(g in sets[x] for g in own)) == l


def test_host_rules_shrink(spark):
    good = "A sensible sentence with words in it. " * 5
    bad = "SHOUTING!! AT!! EVERY!! WORD!! OF!! IT!! " * 5
    rows = [(k, bad if k % 10 < 9 else good, "bad") for k in range(200)]
    rows += [(1000 + k, bad if k % 50 == 0 else good, f"good{k % 10}") for k in range(2000)]
    rows += [(5000, bad, "tiny")]
    got = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert got[0].host_poor and not got[0].keep and got[9].keep
    assert not got[1000].host_poor and got[1000].keep == (len(got[1000].failed_rules.split(",")) < host_rules.FAILED)
    # one failing document of one is no rate of 1
    assert got[5000].host_rate < 1 and all(r.keep for r in got.values() if r.failed_rules == "")


def test_host_rules_awkward_rows(spark):
    docs = awkward(spark)
    got = host_rules.judge(docs).collect()
    assert len(got) == docs.count()
    assert all(r.failed_rules == "empty" for r in got if r.doc_id in (2, 3))
    assert sum(r.source is None for r in got) == 2
    assert host_rules.judge(empty(spark)).collect() == []


def test_host_rules_each_rule(spark):
    examples = {
        "empty": "", "few_letters": "1234 5678 9012 34 ab", "many_marks": "word$$$ word### word%%%", "shouting": "ALL OF THIS IS WRITTEN IN CAPITALS",
        "one_word": "same " * 40, "long_words": "x" * 60, "short_words": "a b c d e f g", "repeated_lines": "one line here\n" * 6, "bars": "one | two | three | four | five | six",
    }
    docs = spark.createDataFrame([(k, t, "h") for k, t in enumerate(examples.values())], "doc_id long, text string, source string")
    failed = {r.doc_id: r.failed_rules.split(",") for r in host_rules.judge(docs).collect()}
    assert all(name in failed[k] for k, name in enumerate(examples))
    assert set(examples) == set(host_rules.RULES)
