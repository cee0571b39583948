"""The star schema's trees in as many parts as the tables need."""

import re

import pytest

from boscage import catalog
from boscage.sources import files


def _plan(spark, sf_dir, name):
    return catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["offset_limit", "page"])
def test_a_page_sorts_no_more_than_its_first_rows(spark, sf_dir, name):
    plan = _plan(spark, sf_dir, name)
    assert plan.startswith("TakeOrderedAndProject") and "Sort [file_path" not in plan and "GlobalLimit" not in plan


@pytest.mark.parametrize("name", ["complexity_by_type", "unique", "tree_nodes", "find_has", "callers"])
def test_parts_grow_with_the_tables(spark, duck, sf_dir, name, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 10_000)
    df = catalog.QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(int(n) > 4 for n in re.findall(r"hashpartitioning\(file_path\S*, (?:node_id\S*, )?(\d+)\), REPARTITION_BY_NUM", plan)) and "REPARTITION_BY_NUM" in plan
    columns = ", ".join(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, duck.execute(f"SELECT {columns} FROM ({catalog.SQL[name]})").fetchall()))


def test_pages_are_those_of_the_whole_order(spark, sf_dir):
    found = catalog._grove(spark, sf_dir).find("order")
    every = [(r.file_path, r.node_id) for r in found.df.select("file_path", "node_id").collect()]
    keys = lambda s: [(r.file_path, r.node_id) for r in s.df.collect()]
    every.sort()
    assert keys(found.page(3, 25)) == every[75:100] and keys(found.offset(5).limit(0)) == [] and keys(found.nth(7)) == every[7:8]
    assert keys(found.limit(10).offset(4)) == every[4:10] and keys(found.offset(4).offset(2).limit(3)) == every[6:9] and keys(found.offset(4).limit(5).limit(2)) == every[4:6]


def test_rows_that_are_not_stored_have_no_size(spark):
    assert files.parts_of(spark.createDataFrame([(1,)], "a int").unionByName(spark.createDataFrame(spark.sparkContext.parallelize([(2,)]), "a int"))) is None
