"""Every registered query of the library against its SQL in DuckDB."""

import pytest

from compare import check, connect
from conftest import DATA
from eventide import registry

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    check(registry.queries()[name](spark, FOLDER), duck, registry.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_merging_fold_of_many_users(spark, tmp_path):
    """Days of 20,000 users each, with rows that have no user or no value, and a day without values."""
    rows = spark.range(40_000).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(id % 2)) AS ts", "if(id % 10 = 3, null, id) AS user_id", "'view' AS event_type", "if(id % 7 = 0 or id % 2 = 1, null, id / 8) AS value", "'{}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    check(registry.queries()["udf_merging_fold"](spark, str(tmp_path)), connect(str(tmp_path)), registry.oracle_sql()["udf_merging_fold"])
