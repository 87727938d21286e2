"""Queries against SQL on events whose numbers fall on a border, where the last bit of a double decides."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

duckdb = pytest.importorskip("duckdb")

from lodestream.plans import folds  # noqa: E402
from lodestream.plans.data import ACTIONS  # noqa: E402
from lodestream.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402


def tied(k: int, factor: int, thousandths: int) -> int:
    """An event_id for which all five costs are equal and event_id * factor % 1000 is given."""
    return next(i for i in range(-7 * k * pow(13, -1, 101) % 101, 101000, 101) if i * factor % 1000 == thousandths)


def compare(spark, folder, name, events):
    """Rows of the query and of its SQL for events (event_id, props)."""
    names = ["event_id", "user_id", "event_type", "value", "props"]
    rows = [(i, n % 3, ACTIONS[n % 5], 1.0 + n, props) for n, (i, props) in enumerate(events)]
    pq.write_table(pa.table({c: [x[j] for x in rows] for j, c in enumerate(names)}), f"{folder}/events.parquet")
    df = QUERIES[name](spark, str(folder))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


def test_rejection_on_the_border(spark, tmp_path):
    # 0.1 * 0.2 / p is a whole number of thousandths; a row without a context is never accepted.
    ties = [(tied(k, 7919, 200 // (1 + k % 8)), f'{{"k": {k}}}') for k in range(101) if 200 % (1 + k % 8) == 0]
    got, want = compare(spark, tmp_path, "explore_eval_reject", [*ties, (1000, "{}"), (-7, '{"k": 3}')])
    assert got == want


def test_sample_on_the_border(spark, tmp_path):
    # All shares are 0.2 or a bit less; without a context no share is known and the last action is taken.
    ties = [(tied(k, 37, draw), f'{{"k": {k}}}') for k in range(101) for draw in (200, 400, 600, 800)]
    got, want = compare(spark, tmp_path, "sample_action", [*ties, (1001, "{}"), (-7, '{"k": 3}')])
    assert got == want


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    # A user's first event takes the baseline with a weight of 1.25; four events later 0.820125 is left.
    got, want = compare(spark, tmp_path, "baseline_challenger_plain", [(n, '{"k": 7}') for n in range(60)])
    assert got == want and 0.82013 in {x[4] for x in got}
    values = [s * (m + 0.5) / 1e5 + d for m in (0, 7, 82012, 338512, 10**9) for s in (1, -1) for d in (0, 1e-12, -1e-12)] + [0.0, -0.0, 1e-9, -1e-9, 1e305]
    assert [repr(folds._rounded(v, 5)) for v in values] == [repr(duckdb.execute("SELECT round(?::DOUBLE, 5)", [v]).fetchone()[0]) for v in values]
