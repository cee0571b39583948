import glob

import pyarrow.parquet as pq

from boscage.operators import search


def test_a_term_of_all_texts_is_shared_among_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "TASK_TERMS", 1000)
    rows = spark.range(3000).selectExpr("concat('t', id) AS id", "concat('common w', id % 7) AS text")
    made = search.Collection(spark, str(tmp_path), "c")
    made.create(rows)
    files = [pq.read_table(f).to_pydict() for f in glob.glob(f"{made.path}/*/postings/*.parquet")]
    sizes = [f["term"].count("common") for f in files]
    assert sum(sizes) == 3000 and max(sizes) < 2000  # by term alone, one file has all of them
    for f in files:
        assert f["term"] == sorted(f["term"])
    want = search.search(rows, "common w3", 5).collect()
    assert [(r.id, r.score) for r in made.search("common w3", 5).collect()] == [(r.id, r.score) for r in want] and len(want) == 5


def test_an_index_of_nothing(spark, tmp_path):
    made = search.Collection(spark, str(tmp_path), "c")
    made.create(spark.createDataFrame([], "id string, text string"))
    assert made.search("a").count() == 0
