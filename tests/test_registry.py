import importlib
import re

import duckdb
import pytest

entry = importlib.import_module("__spark_entry__")
DATA = "/root/testdata/sf0.001"

#: every operator of the inventory, as its queries' names begin
OPERATORS = (
    [f"io{i}" for i in range(1, 16)]
    + [f"pr{i}" for i in range(1, 11)]
    + [f"jn{i}" for i in range(1, 9)]
    + [f"ag{i}" for i in range(1, 11)]
    + ["wn1", "wn2", "sr1", "sr2", "sr3"]
    + [f"st{i}" for i in range(1, 5)]
    + [f"sc{i}" for i in (1, 2, 3, 4, 6, 7, 8, 9, 10)]
    + [f"qa{i}" for i in range(1, 7)]
    + [f"ln{i}" for i in range(1, 8)]
    + ["ss1", "ss2", "ss3"]
)


def test_every_operator_has_a_query_with_an_oracle():
    names, oracles = set(entry.QUERIES), set(entry.ORACLES)
    assert names == oracles
    covered = {re.match(r"([a-z]+\d*)_", n).group(1) for n in names}
    assert [op for op in OPERATORS if op not in covered] == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["event_id", "ts", "user_id", "event_type", "value", "props"] and df.count() > 0


@pytest.mark.parametrize("name", ["jn1_classify_orders", "io7_change_feed_orders", "ln1_reconcile", "io3_rescued_events"])
def test_queries_match_their_sql(spark, name):
    from check_oracles import comparable, duck

    df = entry.queries()[name](spark, DATA)
    result = duck(DATA).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.columns, df.collect()) == comparable(columns, result.fetchall())


def test_oracles_parse():
    assert all(len(duckdb.extract_statements(sql)) == 1 for sql in entry.oracle_sql().values())
