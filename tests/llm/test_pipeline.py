import corpus_pipeline as cp
from boscage.llm import bpe, decontaminate, langid, ngram_join, toxicity

from .test_decontaminate import brute as leaked
from .test_ngram_join import brute_pairs, components


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in cp.STAGES] == ["toxicity", "language_id", "ngram_join", "decontaminate", "bpe"]
    assert cp.ORACLE_SQL is None


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.toxic}
    left = {i: r for i, r in rows.items() if i not in toxic}
    frame = spark.createDataFrame(list(left.values()), docs.schema)
    said = {r.doc_id: r.keep for r in langid.identify(frame, langid.train(frame)).collect()}
    left = {i: r for i, r in left.items() if said[i]}
    first = components(brute_pairs([(i, r.text) for i, r in left.items()], ngram_join.THRESHOLD), left)
    left = {i: r for i, r in left.items() if first[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaked([(i, r.text) for i, r in left.items()], items)}
    left = {i: r for i, r in left.items() if i not in bad}
    codec = bpe.codec(bpe.default_vocabulary())
    got = {r.doc_id: list(r.token_ids) for r in cp.run(spark, sf_dir).collect()}
    assert got == {i: codec.plain(r.text) for i, r in left.items()}
    assert 0 < len(got) < len(rows)


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() > 0.5 * docs.count(), name
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_decontaminated_has_no_leak(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.leaks(docs, bench).count() > 0
    assert decontaminate.leaks(decontaminate.keep(docs, bench), bench).count() == 0
