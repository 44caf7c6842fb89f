import datetime
import importlib

import pytest
from pyarrow import parquet

from check_oracles import comparable, duck

entry = importlib.import_module("__spark_entry__")

#: per query, rows that only jobs whose number ends in 7 bring in
OF_SEVENS = {
    "ln4_promoted_provenance": {
        ("job_7", "read", "app.h0105", None, "observed"),
        ("job_17", "write", "crm.d20200102", "primary", "declared"),
        ("job_27", "read", "crm.d20200102", None, "inferred"),
    },
    "ln5_inferred_reads": {
        ("warn", "job_7", "read app.h0105 is inferred from code — wave order may be wrong"),
        ("warn", "job_27", "read crm.d20200102 is inferred from code — wave order may be wrong"),
    },
    "jn6_dependencies": {("job_27", "job_17")},
    "jn7_external_reads": {("job_7", "app.h0105")},
    "jn8_unused_assets": {("crm.d20200104",)},
    "ag7_duplicate_producers": {("crm.d20200103", 2)},
}


@pytest.fixture(scope="module")
def jobs(spark, tmp_path_factory):
    """Tables in which some jobs' numbers end in 7."""
    folder = tmp_path_factory.mktemp("jobs")
    at = datetime.datetime(2020, 1, 1, 5)
    events = [(1, at, 7, "click", 9.0), (2, at, 8, "signup", 9.0), (3, at, 8, "view", 2.0)]
    orders = [
        (17, "F", datetime.datetime(2020, 1, 2), "1-URGENT"),
        (27, "O", datetime.datetime(2020, 1, 2), "5-LOW"),
        (37, "F", datetime.datetime(2020, 1, 3), "1-URGENT"),
        (8, "F", datetime.datetime(2020, 1, 3), "1-URGENT"),
        (47, "F", datetime.datetime(2020, 1, 4), "1-URGENT"),
    ]
    tables = {
        "events": (events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"),
        "orders": (orders, "o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": ([(8, "BUILDING", 1.0)], "c_custkey bigint, c_mktsegment string, c_acctbal double"),
    }
    for name, (rows, schema) in tables.items():
        parquet.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", OF_SEVENS)
def test_every_job_declares(spark, jobs, name):
    df = entry.queries()[name](spark, jobs)
    got = df.collect()
    assert {tuple(r) for r in got} >= OF_SEVENS[name]
    result = duck(jobs).execute(entry.oracle_sql()[name])
    assert comparable(df.columns, got) == comparable([d[0] for d in result.description], result.fetchall())
