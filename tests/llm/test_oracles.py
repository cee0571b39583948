import pytest

from boscage.llm import registry


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    have = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(norm, have)) == sorted(map(norm, want))
