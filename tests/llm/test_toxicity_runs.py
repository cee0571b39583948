import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from boscage.llm import toxicity


@pytest.fixture(scope="module")
def labelled():
    read = lambda name: pq.read_table(f"/root/testdata/sf0.1/{name}.parquet").to_pylist()
    said = {r["doc_id"]: r["toxic"] for r in read("labels")}
    docs = sorted((r["doc_id"], r["text"].encode(), r["lang"]) for r in read("documents") if r["doc_id"] in said and r["text"])
    return [(text, lang, said[i]) for i, text, lang in docs]


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.fit(*([t for t, _, x in labelled[::2] if x == k] for k in (1, 0)))


def verdicts(model, texts):
    scorer = toxicity.Scorer(model)
    return [scorer.score(scorer.gains(t)) > model.threshold for t in texts]


def test_rows_left_out_of_fit(labelled, model):
    left = labelled[1::2]
    assert np.mean(verdicts(model, [t for t, _, x in left if not x])) < 0.01
    assert np.mean(verdicts(model, [t for t, _, x in left if x])) > 0.6
    for lang in ("de", "es", "fr"):
        assert any(verdicts(model, [t for t, l, x in left if x and l == lang])), lang


@pytest.mark.parametrize("lang", ["en", "de", "es", "fr"])
def test_a_clean_million(labelled, model, lang):
    clean = b" ".join(t for t, l, x in labelled[1::2] if not x and l == lang)
    assert verdicts(model, [(clean * (1_000_000 // len(clean) + 1))[:1_000_000]]) == [False]


def test_a_passage_in_a_million(labelled, model):
    clean = b" ".join(t for t, l, x in labelled[1::2] if not x and l == "en")[:1_000_000]
    passage = next(t for t, l, x in labelled if x and l == "en" and len(t) > 2000)[:2000]
    assert verdicts(model, [clean, clean[:500_000] + passage + clean[500_000:]]) == [False, True]


def test_rare_topic_and_much_vocabulary():
    r = random.Random(1)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(4))
    plain, bad, rare = [word() for _ in range(800)], [word() + "x" for _ in range(300)], [word() + "z" for _ in range(8)]
    text = lambda more: " ".join(x for _ in range(40) for x in (*r.choices(plain, k=4), *([r.choice(more)] if more else []))).encode()
    ordinary = [text([]) for _ in range(1800)]
    toxic = [text(rare if k < 36 else bad) for k in range(900)]
    known = toxicity.fit(toxic, ordinary)
    assert all(any(c in known.toxic for c in toxicity.words(toxicity.coded(w))) for w in (*bad, *rare))
    assert verdicts(known, [text(rare), text(bad), text([])]) == [True, True, False]


@pytest.mark.parametrize("n", [60, 174, 300, 900])
def test_one_rule_at_every_size(labelled, n):
    toxic, ordinary = ([t for t, _, x in labelled if x == k][:n] for k in (1, 0))
    known = toxicity.fit(toxic, ordinary)
    held = list(dict.fromkeys(ordinary))[1::2]
    passed = sum(verdicts(known, held))
    assert passed < max(1, toxicity.FALSE_POSITIVES * (len(held) + 1))
    assert known.threshold != 4.5
