"""Every core query that SQL can express equals DuckDB's result on the smallest tables."""

import functools

import duckdb
import pytest

from twinsieve import queries as core
from twinsieve.operators import grouping

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, duck, name):
    got, expected = core.queries()[name](spark, DATA).toPandas(), duck.execute(core.oracle_sql()[name]).fetchdf()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert rows(got) == rows(expected)


#: Queries on groups of codes.
GROUPED = ("best_of_group", "dedup_summary", "delete_group", "delete_items", "eval_accuracy", "eval_confusion", "eval_prf_macro", "group_names", "group_sizes_top8", "keep_one", "move_items")


@pytest.mark.parametrize("name", GROUPED)
def test_groups_of_several_rounds(spark, duck, monkeypatch, name):
    """A round of leaders holds far more codes than these tables; with 90 each, whole queries still equal their SQL."""
    monkeypatch.setattr(grouping, "leaders_of_codes", functools.partial(grouping.leaders_of_codes, size=90))
    test_query(spark, duck, name)


def test_rest_runs(spark):
    for name in set(core.queries()) - set(core.oracle_sql()):
        assert core.queries()[name](spark, DATA).count() > 0, name
    assert core.entry(spark, DATA).count() == 500
