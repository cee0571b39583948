import os
import random

import pytest

from boscage.llm import url_filter as uf


def brute(url, entries):
    """The longest entry that blocks ``url``, by comparing with every one."""
    c = uf.canonical(url)
    if not c:
        return None
    host, path, query = c
    bare = host.split(":")[0]
    found = []
    for e in entries:
        if "?" in e:
            hit = e == host + path + "?" + query
        elif "/" in e:
            hit = e == host + path or (host + path).startswith(e + "/")
        else:
            hit = e in (host, bare) or bare.endswith("." + e)
        if hit:
            found.append(e)
    return min(found, key=lambda e: (-len(e), e), default=None)


LISTED = ["Bad.example.com", "https://site.org/spam/", "site.org/a?x=1&utm_source=z", "bad.example.com.", None, "", "   ", "other.net:8080", "xn--caf.fr", "site.org/spam/deep", "日本.jp"]
URLS = [
    "http://bad.example.com", "https://WWW.Bad.Example.com:443/x?y#z", "notbad.example.com/x", "http://example.com/bad.example.com", "https://site.org/spam", "https://site.org/spam/1/2?q=3",
    "https://site.org/spammer", "//site.org/spam/deep/er", "http://site.org/a?x=1", "http://site.org/a?x=1&utm_campaign=q", "http://site.org/a?x=2", "http://site.org/a", "http://other.net:8080/p", "http://other.net/p",
    "http://user:pw@bad.example.com/", None, "", "   ", "http://", "://", "http:///path", "http://日本.jp/é", "http://site.org/" + "d/" * 500 + "e", "http://a.b.c.bad.example.com./q", "bad.example.com",
]


@pytest.mark.parametrize("mapped", [True, False])
def test_equals_brute_force(spark, mapped):
    pages = spark.createDataFrame([(k, u, k) for k, u in enumerate(URLS)] + [(0, URLS[0], 0), (None, URLS[0], 0)], "page_id long, url string, URL2 int").toDF("page_id", "url", "URL")
    listed = spark.createDataFrame([(e,) for e in LISTED], "entry string")
    entries = {w for e in LISTED if (w := uf.written(e))}
    got = uf.check(pages, listed, mapped).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert r.entry == brute(r.url, entries) and r.blocked == (r.entry is not None), r
    assert uf.check(pages, listed.limit(0), mapped).where("blocked").count() == 0
    assert uf.check(pages.limit(0), listed, mapped).collect() == []


def test_many_shards(spark):
    r = random.Random(4)
    entries = {f"h{r.randrange(3000)}.net" + ("" if r.random() < 0.3 else f"/p{r.randrange(50)}") for _ in range(4000)}
    index = uf.build(spark.createDataFrame([(e,) for e in entries], "entry string"), shard=300)
    assert index.bits >= 3 and len(os.listdir(index.folder)) > 8
    probes = [f"h{r.randrange(3000)}.net/p{r.randrange(50)}" for _ in range(5000)] + sorted(entries)[:500]
    assert index.has(probes).tolist() == [p in entries for p in probes]


def test_collisions_block_nothing(tmp_path, monkeypatch):
    monkeypatch.setattr(uf, "digest", lambda e: len(e))
    folder = str(tmp_path / "0")
    uf.Shard.write(folder, ["aa.b", "cc.d", "ee.f", "long.entry"])
    assert uf.Index(str(tmp_path), 0).has(["cc.d", "xx.y", "ee.f", "a", "long.entry", "long.entrz"]).tolist() == [True, False, True, False, True, False]


def test_writing_again_does_no_harm(tmp_path):
    folder = str(tmp_path / "s")
    assert uf.Shard.write(folder, ["a.b"]) == uf.Shard.write(folder, ["a.b"]) == 1
    assert os.listdir(tmp_path) and uf.Shard(folder).has(["a.b"], uf.np.array([uf.digest("a.b")], uf.np.uint64)).all()


def test_query(spark, sf_dir, duck):
    got = sorted(map(tuple, uf.query(spark, sf_dir).select("page_id", "url", "entry", "blocked").collect()))
    assert got == sorted(duck.execute(f"SELECT page_id, url, entry, blocked FROM ({uf.SQL})").fetchall())


def test_a_very_long_url_takes_linear_time(spark):
    deep = "http://site.org/" + "d/" * 200_000 + "e"
    dotted = "http://" + "a." * 200_000 + "bad.example.com/"  # no host name is that long
    docs = spark.createDataFrame([(1, deep), (2, dotted), (3, "http://site.org/d/d")], "page_id long, url string")
    listed = spark.createDataFrame([("site.org/d/d",), ("bad.example.com",)], "entry string")
    for mapped in (True, False):
        got = {r.page_id: r.entry for r in uf.check(docs, listed, mapped).collect()}
        assert got == {1: "site.org/d/d", 2: None, 3: "site.org/d/d"}


def test_candidates_and_their_digests():
    for url in URLS:
        p = uf.Probes(url)
        assert [uf.digest(t) for t in uf.candidates(url)] == p.digests
        lengths = [len(t) for t in uf.candidates(url)]
        assert lengths == sorted(set(lengths), reverse=True)


def test_query_list_has_all_kinds(spark):
    entries = uf.query_list(spark)
    assert entries.count() == entries.distinct().count() > 800_000
    assert entries.where("entry LIKE '%?%'").count() > 100_000 and entries.where("entry NOT LIKE '%/%'").count() > 200_000
