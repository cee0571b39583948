import random

import numpy as np
import pytest

from boscage.llm import bpe, dac, token_count

from .helpers import LONG, TEXTS, awkward, empty

CODEC = bpe.codec(bpe.default_vocabulary())


def texts(seed):
    r = random.Random(seed)
    parts = ["abc", " ", "  ", "\n", "日本", "'s", "123", "!!", "\t", "ñ", "word", "🙂", "'", "ll", "\r\n", "x" * 70, "9" * 40, " " * 80]
    return "".join(r.choice(parts) for _ in range(r.randint(0, 400)))


@pytest.mark.parametrize("seed", range(60))
def test_tree_equals_plain_encoding(seed):
    t = texts(seed)
    plain = CODEC.plain(t)
    assert CODEC.encode(t) == plain
    assert CODEC.decode(plain) == t


@pytest.mark.parametrize("seed", range(60))
def test_text_join_equals_plain_encoding(seed):
    t = texts(seed)
    for at in random.Random(seed).sample(range(len(t) + 1), min(8, len(t) + 1)):
        left, right = t[:at], t[at:]
        assert CODEC.join_texts((left, CODEC.encode(left)), (right, CODEC.encode(right))) == (t, CODEC.plain(t))


@pytest.mark.parametrize("t", ["they're we've I'll", "x 'they''re' I'd  \n's", "we've" * 3 + "'" * 5 + "ll"])
def test_text_join_at_every_cut(t):
    for at in range(len(t) + 1):
        left, right = t[:at], t[at:]
        assert CODEC.join_texts((left, CODEC.encode(left)), (right, CODEC.encode(right))) == (t, CODEC.plain(t)), at


def test_long_unsplit_piece():
    r = random.Random(3)
    for alphabet in ("ab", "abcdefghij", "é日x"):
        t = "".join(r.choice(alphabet) for _ in range(5000))
        assert CODEC.encode(t) == CODEC.plain(t)


def test_documents(spark):
    docs = awkward(spark)
    for long_text in (bpe.LONG_TEXT, 7):
        got = bpe.encode(docs, long_text=long_text).collect()
        assert len(got) == docs.count()
        want = sorted((i if i is not None else -1, t) for i, t in [*enumerate(TEXTS), (0, TEXTS[0]), (-1, TEXTS[0]), (50, TEXTS[0])] if t is not None)
        have = sorted((r.doc_id if r.doc_id is not None else -1, CODEC.decode(r.token_ids)) for r in got if r.token_ids is not None)
        assert have == want
        for r in got:
            assert (r.token_ids is None) == (r.n_tokens is None) == (r.round_trip is None)
            if r.token_ids is not None:
                assert r.round_trip and list(r.token_ids) == CODEC.plain(CODEC.decode(r.token_ids))
    assert bpe.encode(empty(spark)).collect() == []
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))


def test_counts_equal_encoding(spark):
    rows = token_count.count_tokens(awkward(spark)).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(TEXTS):
            t = TEXTS[r.doc_id]
            assert r.n_tokens == (None if t is None else len(CODEC.plain(t)))
    assert token_count.count_tokens(empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_counter(seed):
    import pyarrow as pa

    many = [texts(seed * 10 + k) for k in range(6)]
    c = token_count.counter(bpe.default_vocabulary())
    assert c.counts(pa.array(many)).tolist() == [len(CODEC.plain(t)) for t in many]


def test_counter_long_word():
    word = "ab" * 40_000
    c = token_count.counter(bpe.default_vocabulary())
    assert c.count(word) == len(CODEC.encode(word))


def test_queries_on_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = bpe.query(spark, sf_dir).collect()
    assert len(got) == len(docs) and all(list(r.token_ids) == CODEC.plain(docs[r.doc_id]) and r.round_trip for r in got)
    assert {r.doc_id: r.n_tokens for r in token_count.query(spark, sf_dir).collect()} == {r.doc_id: r.n_tokens for r in got}
    for r in dac.query(spark, sf_dir).collect():
        assert dac.Reader(bytes(r.payload)).all().tolist() == CODEC.plain(docs[r.doc_id])


@pytest.mark.parametrize("ids", [[], [0], [255], [256], [2**32 - 1], [0, 255, 256, 65535, 65536, 2**24, 2**32 - 1] * 300, list(range(5000))])
def test_dac_round_trip(ids):
    payload = dac.pack(np.array(ids, np.uint32))
    reader = dac.Reader(payload)
    assert reader.all().tolist() == ids and len(reader) == len(ids)
    assert [reader[i] for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        reader[len(ids)]


def test_dac_random_access():
    ids = np.random.default_rng(1).integers(0, 2**20, 4000).astype(np.uint32)
    reader = dac.Reader(dac.pack(ids))
    assert all(reader[i] == ids[i] for i in np.random.default_rng(2).integers(0, 4000, 500).tolist())
    with pytest.raises(ValueError):
        dac.Reader(b"nothing")


def test_dac_documents(spark):
    got = dac.write_ids(awkward(spark)).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        assert (r.payload is None) == (r.n_tokens is None)
        if r.doc_id == 8:
            assert dac.Reader(bytes(r.payload)).all().tolist() == CODEC.plain(LONG)
    assert dac.write_ids(empty(spark)).collect() == []
