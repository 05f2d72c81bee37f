"""Every registered query of the engine against its SQL."""

import pytest

import __spark_entry__
from quern.plans.file_oracle import ORACLE_SQL as FILE_SQL
from quern.plans.oracle import ORACLE_SQL as PLAIN_SQL
from quern.plans.queries import QUERIES

ORACLE_SQL = PLAIN_SQL | FILE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(name, agree):
    agree(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_queries_ask_for_every_word(spark, sf_dir, duck):
    words = duck.sql(r"select count(distinct (item_id, w)) from (select item_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as w from benchmark) where w <> ''").fetchall()[0][0]
    assert QUERIES["query_terms_text"](spark, sf_dir).count() == words


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["qid", "rank", "doc_id", "score"]
    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
