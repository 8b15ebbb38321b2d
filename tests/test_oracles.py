import pytest
from oracle import connect, same_rows

from lodestone.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(name, spark, sf_dir, con):
    same_rows(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name])


def test_queries_without_sql_have_a_brute_force():
    import test_brute_force

    assert set(catalog.QUERIES) - set(catalog.ORACLES) == set(test_brute_force.COVERED)


def test_entry_has_all_queries(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_silence_islands_equal_their_sql_at_the_level_itself_and_with_nulls(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import parquet

    users = {
        1: [0.09, 2.39, 8.78, 60.0],  # 8.78 is the level; with both products rounded, it lies below it
        2: [0.16, 4.76, 9.54, 60.0],  # 9.54 is below the level; with both products rounded, it is the level
        3: [1.0, 60.0, 2.0, None, 3.0, 3.0],
        4: [float("nan"), 1.0, 2.0, float("inf"), 3.0],
        5: [None, None],
        6: [1.0],
        None: [1.0, 2.0, 60.0, 3.0],
    }
    rows = [(u, v, None if u == 3 and i == 0 else i) for u, values in users.items() for i, v in enumerate(values)]
    user, value, ts = zip(*rows, strict=True)
    columns = {"event_id": range(len(rows)), "ts": pa.array(ts, "timestamp[us]"), "user_id": pa.array(user, "int64"), "value": value}
    parquet.write_table(pa.table(columns), tmp_path / "events.parquet")
    got = catalog.QUERIES["w10_silence_islands"](spark, str(tmp_path))
    assert {(r["user_id"], r["first"], r["past"]) for r in got.collect()} >= {(1, 1, 3), (2, 1, 4)}
    same_rows(got, connect(str(tmp_path)), catalog.ORACLES["w10_silence_islands"])
