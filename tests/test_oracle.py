import pytest
from oracle import connect, rows_of, rows_of_sql

from millrace.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert rows_of(df) == rows_of_sql(con, ORACLE_SQL[name], df.columns)


def test_keys():
    assert {*ORACLE_SQL} == {*QUERIES}


def test_streams_over_folders(spark, sf, tmp_path):
    """Streams read a table that is a folder of parts, and a stream that puts nothing out gives an empty table."""
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("state_machine_stream", "event_tail_stream", "claim_stream"):
        assert rows_of(QUERIES[name](spark, str(tmp_path))) == rows_of(QUERIES[name](spark, sf))
    spark.read.parquet(f"{sf}/events.parquet").where("event_id < 3").write.parquet(str(tmp_path / "few" / "events.parquet"))
    none = QUERIES["event_tail_stream"](spark, str(tmp_path / "few"))
    assert none.columns == ["event_id", "user_id", "event_type"] and none.count() == 0
