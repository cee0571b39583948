"""Every query of the catalogue against its SQL, over the smallest tables."""

import pytest

from boscage import catalog


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = sorted(tuple(map(norm, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall())
    have = sorted(tuple(map(norm, r)) for r in got.select(*columns).collect())
    assert have == want
    assert want or name in {"sql_having", "code_comment"}, "no row to compare"


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
