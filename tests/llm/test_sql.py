"""Every corpus query that SQL can say, at the smallest scale."""

import pytest

duckdb = pytest.importorskip("duckdb")

from lodestream.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = c.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in got.description)
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    names = [d[0] for d in got.description]
    want = sorted(tuple(r[names.index(x)] for x in columns) for r in got.fetchall())
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == want
