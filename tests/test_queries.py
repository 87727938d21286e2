"""Every query of the reference's operators against its SQL, at the smallest scale."""

import pytest

duckdb = pytest.importorskip("duckdb")

from lodestream.plans import folds, formats, learning, more  # noqa: E402, F401
from lodestream.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"topic_coherence"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(data, names):
    return sorted([tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in (r[names.index(n)] for n in sorted(names))) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE_SQL) - SLOW))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    a, b = rows([tuple(r) for r in df.collect()], df.columns), rows(got.fetchall(), columns)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == pytest.approx(q, abs=2e-5) if isinstance(p, float) else p == q for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and df.dropna().count() == df.count()


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["user_id", "average_loss", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
