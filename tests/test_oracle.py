"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import connect, difference

SF = "/root/testdata/sf0.001"
OTHER = {*entry.llm.QUERIES, "pipeline"} if entry.llm else set()  # tested in tests/llm
SQL = {k: x for k, x in entry.oracle_sql().items() if k not in OTHER}
ROWS_ONLY = {"sample_events", "finding_distincts_approx"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql_or_is_listed():
    assert set(entry.queries()) - OTHER - set(SQL) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result_as_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert difference(got, duck.execute(SQL[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sample_is_a_subset(spark):
    all_ids = {r.event_id for r in entry.queries()["commit_key"](spark, SF).select("event_id").collect()}
    some = [r.event_id for r in entry.queries()["sample_events"](spark, SF).collect()]
    assert set(some) < all_ids and len(some) == len(set(some))
