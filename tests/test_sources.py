import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewright.functions.widening import keeps_values
from tidewright.operators import changes, quality
from tidewright.plans import ingest
from tidewright.sources import landing, publish, rescue, side_tables, tables
from tidewright.streaming import bronze
from tests.conftest import rows

SCHEMA_DDL = "id int, name string, at timestamp, s struct<x:int,y:string>, l array<int>"


# --- rescue ------------------------------------------------------------------------------------------------
LINES = [
    ('{"id": 1, "name": "a", "at": "2024-01-01 00:00:00", "s": {"x": 1, "y": "q"}, "l": [1, 2]}', (1, "a", 1, None)),
    ('{"id": 1.5, "name": "b"}', (None, "b", None, {"id": 1.5})),
    ('{"id": "2", "name": 7, "extra": [1, {"z": 2}]}', (2, "7", None, {"extra": [1, {"z": 2}]})),
    ('{"id": 3, "s": {"x": "no", "z": 1}}', (3, None, None, {"s.x": "no", "s.z": 1})),
    ('{"id": 4, "s": "flat", "l": "nolist", "at": "never"}', (4, None, None, {"s": "flat", "l": "nolist", "at": "never"})),
    ('{"id": null, "name": null}', (None, None, None, None)),
    ('{"id": 5, broken', (None, None, None, {"_corrupt_record": '{"id": 5, broken'})),
    ("[1]", (None, None, None, {"_corrupt_record": "[1]"})),
    ('{"a b": 1, "id": 6}', (6, None, None, {"a b": 1})),
]


def test_rescue(spark):
    df = spark.createDataFrame([(t, i) for i, (t, _) in enumerate(LINES)] + [("  \t", 98), ("", 99)], "value string, i int")
    out = rescue.parse_with_rescue(df, StructType.fromDDL(SCHEMA_DDL))
    assert out.columns == ["id", "name", "at", "s", "l", "_rescued", "i"]
    got = {r.i: r for r in out.collect()}
    assert len(got) == len(LINES)
    for i, (text, (id_, name, x, rescued)) in enumerate(LINES):
        r = got[i]
        assert (r["id"], r["name"], r["s"].x if r["s"] else None) == (id_, name, x), text
        assert (json.loads(r["_rescued"]) if r["_rescued"] else None) == rescued, text
    with pytest.raises(ValueError, match="twice"):
        rescue.parse_with_rescue(df.withColumnRenamed("i", "id"), StructType.fromDDL(SCHEMA_DDL))


BIG = "123456789012345678901234567890123456789012"


def test_rescue_keeps_numbers_as_written(spark):
    lines = [
        (1, '{"name": 1.10, "more": 1e3, "big": ' + BIG + ', "deep": {"a": [1.50, -0.0, "2.50"]}}'),
        (2, '{"id": 1E2, "name": {"b": 1.0, "a": [1.00]}, "l": [1, 2.0]}'),
        (3, '{"id": ' + BIG + ', "name": "1.10, 2]", "x\\"y": "a\\\\", "z": [1.0]}'),
        (4, '{"id": 01}'),
        (5, '{1: 2}'),
        (6, '{"id": 7, "name": "\ue0f11.50", "other": 1.50}'),
        (7, '{"id": 8, "name": "' + "n\\n" * 50_000 + '", "other": 2.50}'),
        (8, '{"id":-5,"s":{"x":1.5,"y":1.50},"l":[null,3]}'),
    ]
    frame = spark.createDataFrame(lines, "i int, value string")
    got = {r.i: r for r in rescue.parse_with_rescue(frame, StructType.fromDDL(SCHEMA_DDL)).collect()}
    assert got[1]["name"] == "1.10"
    assert got[1]["_rescued"] == '{"big":' + BIG + ',"deep":{"a":[1.50,-0.0,"2.50"]},"more":1e3}'
    assert (got[2]["name"], got[2]["_rescued"]) == ('{"a":[1.00],"b":1.0}', '{"id":1E2,"l":[1,2.0]}')
    assert got[3]["name"] == "1.10, 2]" and got[3]["_rescued"] == '{"id":' + BIG + ',"x\\"y":"a\\\\","z":[1.0]}'
    assert all(json.loads(got[i]["_rescued"]) == {"_corrupt_record": lines[i - 1][1]} for i in (4, 5))
    assert (got[6]["id"], got[6]["name"], json.loads(got[6]["_rescued"])) == (7, "\ue0f11.50", {"other": 1.5})
    assert got[7]["name"] == "n\n" * 50_000 and got[7]["_rescued"] == '{"other":2.50}'
    assert (got[8]["id"], got[8]["s"].x, got[8]["s"].y, got[8]["l"]) == (-5, None, "1.50", [None, 3])
    assert got[8]["_rescued"] == '{"s.x":1.5}'


# --- landing -----------------------------------------------------------------------------------------------
def test_landing_round_trip_and_rerun(spark, tmp_path):
    df = spark.sql("select 1 id, cast(null as string) name, timestamp'2024-01-01 00:00:00.123456' at")
    path = landing.write_landing(df, str(tmp_path), "meters", dt="2024-01-01", run_id="7")
    assert path.endswith("/meters/dt=2024-01-01/run=7")
    text = spark.read.text(path).first()["value"]
    assert json.loads(text) == {"id": 1, "name": None, "at": "2024-01-01T00:00:00.123456Z"}
    with pytest.raises(Exception, match="(?i)exist"):
        landing.write_landing(df, str(tmp_path), "meters", dt="2024-01-01", run_id="7")
    landing.write_landing(df, str(tmp_path), "meters", dt="2024-01-01", run_id="8", compression="gzip")
    back = landing.read_landing(spark, str(tmp_path / "meters"), StructType.fromDDL(SCHEMA_DDL))
    assert back.count() == 2 and back.filter("_rescued is not null").isEmpty()
    assert back.filter("_source_file like '%run=%'").count() == 2 and back.first()["_ingested_at"] is not None
    assert {r["at"].microsecond for r in back.collect()} == {123456}
    with pytest.raises(ValueError):
        landing.write_landing(df, str(tmp_path), "meters", dt="2024-01-01", run_id="a/b")


def test_schema_is_inferred_once(spark, tmp_path):
    where, kept = str(tmp_path / "in"), str(tmp_path / "schema")
    spark.sql("select 1 id, 'a' name").write.json(where)
    first = landing.infer_landing_schema(spark, where, kept)
    assert first.simpleString() == "struct<id:bigint,name:string>"
    spark.sql("select 'x' id, 2 more").write.mode("append").json(where)
    assert landing.infer_landing_schema(spark, where, kept) == first


# --- tables ------------------------------------------------------------------------------------------------
def test_writer_schema_rules(spark, name):
    tables.write_table(spark.sql("select 1 a"), name, mode="append")
    tables.write_table(spark.sql("select 2 a"), name, mode="append")
    wide = spark.sql("select 'x' b, 3 a")
    for mode in ("append", "overwrite"):
        with pytest.raises(ValueError, match="merge_schema"):
            tables.write_table(wide, name, mode=mode)
    tables.write_table(wide, name, mode="append", merge_schema=True)
    assert rows(spark.table(name), "a", "b") == [(1, None), (2, None), (3, "x")]
    tables.write_table(spark.sql("select 9 a"), name, mode="overwrite")
    assert rows(spark.table(name), "a", "b") == [(9, None)]
    tables.write_table(spark.sql("select 'new' z"), name, mode="overwrite", overwrite_schema=True)
    assert rows(spark.table(name)) == [("new",)]
    tables.write_table(spark.sql("select 'no' z"), name, mode="ignore")
    assert rows(spark.table(name)) == [("new",)]
    for bad in ("errorifexists", "odd"):
        with pytest.raises(ValueError):
            tables.write_table(spark.sql("select 'no' z"), name, mode=bad)


def test_replaced_schema_stays_in_place(spark, name, tmp_path):
    where = str(tmp_path / "t")
    tables.write_table(spark.sql("select 1 a"), name, mode="append", path=where)
    tables.write_table(spark.sql("select 'x' b"), name, mode="overwrite", overwrite_schema=True)
    assert tables.table_location(spark, name).endswith(where) and rows(spark.table(name)) == [("x",)]
    assert rows(spark.read.parquet(where)) == [("x",)]


def test_failed_overwrite_leaves_the_old_rows(spark, name):
    tables.overwrite_table(spark.sql(BASE), name)
    with pytest.raises(Exception, match="stop"):
        tables.overwrite_table(spark.sql("select cast(id as int) id, cast(raise_error('stop') as string) v from range(3)"), name)
    with pytest.raises(Exception, match="stop"):
        tables.write_table(spark.sql("select cast(raise_error('stop') as string) z"), name, mode="overwrite", overwrite_schema=True)
    assert rows(spark.table(name)) == [(1, "a"), (2, "b")]
    parted = name + "p"
    tables.write_table(spark.sql("select 1 id, 'x' d"), parted, mode="append", partition_by=["d"])
    with pytest.raises(Exception, match="stop"):
        tables.overwrite_table(spark.sql("select 1 id, cast(raise_error('stop') as string) d"), parted)
    tables.overwrite_table(spark.sql("select 2 id, 'y' d"), parted)
    assert rows(spark.table(parted)) == [(2, "y")] and tables.partition_columns(spark, parted) == ["d"]


def test_old_versions_are_dropped(spark, name, tmp_path):
    where = str(tmp_path / "t")
    tables.overwrite_table(spark.sql("select 0 id"), name, path=where)
    for i in range(1, 4):
        tables.overwrite_table(spark.sql(f"select {i} id"), name)
    assert len(os.listdir(tmp_path)) == 4
    assert publish.drop_old_versions(spark, name) == []
    assert len(publish.drop_old_versions(spark, name, keep=1, min_age_seconds=0)) == 2
    assert len(os.listdir(tmp_path)) == 2 and rows(spark.table(name)) == [(3,)]
    view = name + "v"
    for i in range(3):
        tables.upsert(spark.sql(f"select {i} id"), view, ["id"], location=str(tmp_path / "v"))
    gone = publish.drop_old_versions(spark, view, min_age_seconds=0)
    assert len(gone) == 2 and all(g.startswith(view + "_attempt_") for g in gone)
    assert rows(spark.table(view)) == [(0,), (1,), (2,)] and len(os.listdir(tmp_path / "v")) == 1


def test_types_are_widened_and_never_narrowed(spark, name):
    tables.write_table(spark.sql("select 1L id, 1.5D v, cast(1 as decimal(10,2)) d"), name, mode="append")
    tables.write_table(spark.sql("select 2 id, 3 v, cast(2 as decimal(8,1)) d"), name, mode="append")
    for bad in ("1.7D id", "'x' id", "1 id, 'x' v", "1 id, 5L v", "1 id, cast(1 as decimal(10,3)) d"):
        for mode in ("append", "overwrite"):
            with pytest.raises(ValueError, match="cast them first"):
                tables.write_table(spark.sql(f"select {bad}"), name, mode=mode)
        with pytest.raises(ValueError, match="cast them first"):
            tables.upsert(spark.sql(f"select {bad}"), name, ["id"])
    assert [r[:2] for r in rows(spark.table(name))] == [(1, 1.5), (2, 3.0)]
    assert keeps_values(spark.sql("select array(1) a, null b").schema, spark.sql("select array(1L) a, 'x' b").schema)
    assert not keeps_values(spark.sql("select array(1L) a").schema, spark.sql("select array(1) a").schema)


def test_read_or_none(spark, name):
    assert tables.read_or_none(spark, name) is None
    tables.overwrite_table(spark.sql("select 1 a"), name)
    tables.overwrite_table(spark.sql("select 2 a"), name)
    assert rows(tables.read_or_none(spark, name)) == [(2,)]


def test_overwrite_partitions(spark, name):
    tables.overwrite_partitions(spark.sql("select 1 a, 'x' d union all select 2, 'y'"), name, "d")
    tables.overwrite_partitions(spark.sql("select 'y' d, 3 a union all select 'z', 4"), name, "d")
    assert rows(spark.table(name), "a", "d") == [(1, "x"), (3, "y"), (4, "z")]
    with pytest.raises(ValueError, match="partitioned by"):
        tables.overwrite_partitions(spark.sql("select 1 a, 'x' d"), name, "a")
    with pytest.raises(ValueError):
        tables.overwrite_partitions(spark.sql("select 1 a"), name, [])


def test_partitions_overwritten_at_the_same_time(spark, name):
    """Two threads of one session, other partitions each; the session's own setting plays no part."""
    tables.overwrite_partitions(spark.sql("select id, id % 6 d from range(60)"), name, "d")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")

    def write(d):
        tables.overwrite_partitions(spark.sql(f"select -id id, {d}L d from range({d + 1})"), name, "d")

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, [1, 4, 7, 8]))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    counts = {r.d: r["count"] for r in spark.table(name).groupBy("d").count().collect()}
    assert counts == {0: 10, 1: 2, 2: 10, 3: 10, 4: 5, 5: 10, 7: 8, 8: 9}


def test_partitions_listed_again_when_a_folder_goes_missing(spark, name, monkeypatch):
    tables.overwrite_partitions(spark.sql("select id, id % 2 d from range(6)"), name, "d")
    catalog, calls = type(spark.catalog), []
    listed = catalog.recoverPartitions

    def recover(self, table):
        calls.append(table)
        if len(calls) == 1:
            raise RuntimeError("java.io.FileNotFoundException: File d=4 does not exist")
        listed(self, table)

    monkeypatch.setattr(catalog, "recoverPartitions", recover)
    tables.overwrite_partitions(spark.sql("select 9L id, 5L d"), name, "d")
    assert calls == [name, name] and spark.table(name).filter("d = 5").count() == 1
    monkeypatch.setattr(catalog, "recoverPartitions", lambda self, table: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        tables.overwrite_partitions(spark.sql("select 9L id, 6L d"), name, "d")


def test_append_dedup_is_retry_safe(spark, name):
    batch = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, v int")
    assert tables.append_dedup(batch, name, ["id"], order_by=["v"]) == 2
    assert tables.append_dedup(batch, name, ["id"], order_by=["v"]) == 0
    assert tables.append_dedup(spark.createDataFrame([(2, 9), (3, 9)], "id int, v int"), name, ["id"]) == 1
    assert rows(spark.table(name)) == [(1, 2), (2, 1), (3, 9)]
    with pytest.raises(ValueError, match="non-NULL"):
        tables.append_dedup(spark.sql("select cast(null as int) id, 1 v"), name, ["id"])


def test_strategies_need_their_keys(spark, name):
    df = spark.sql("select 1 id, 'x' d")
    for strategy, kw in (("overwrite_partition", {}), ("merge_on_key", {}), ("append_dedup", {}), ("odd", {})):
        with pytest.raises(ValueError):
            tables.write_with_strategy(df, name, strategy, **kw)
    tables.write_with_strategy(df, name, "overwrite_table")
    tables.write_with_strategy(df, name, "none")
    assert spark.table(name).count() == 2
    tables.write_with_strategy(df, name + "p", "overwrite_partition", partition_key="d")
    assert tables.write_with_strategy(df, name + "m", "merge_on_key", merge_key=["id"])["inserted"] == 1
    assert tables.write_with_strategy(df, name + "a", "append_dedup", merge_key=["id"]) == 1


# --- upsert ------------------------------------------------------------------------------------------------
BASE = "select 1 id, 'a' v union all select 2, 'b'"
NEXT = "select 2 id, 'B' v union all select 3, 'c' union all select cast(null as int), 'n'"
AFTER = [(1, "a"), (2, "B"), (3, "c"), (None, "n")]


def test_upsert_creates_and_publishes(spark, name, tmp_path):
    where = str(tmp_path)
    assert tables.upsert(spark.sql(BASE), name, ["id"], location=where) == {"inserted": 2, "updated": 0, "total_processed": 2}
    first = publish.current_version(spark, name)
    counts = tables.upsert(spark.sql(NEXT), name, ["id"], location=where)
    assert counts == {"inserted": 2, "updated": 1, "total_processed": 3}
    assert rows(spark.table(name)) == sorted(AFTER, key=repr)
    assert publish.current_version(spark, name) != first and rows(spark.table(first)) == [(1, "a"), (2, "b")]
    # twice is once, NULL keys apart
    keyed = spark.sql(NEXT).filter("id is not null")
    assert tables.upsert(keyed, name, ["id"], location=where) == {"inserted": 0, "updated": 2, "total_processed": 2}
    assert rows(spark.table(name)) == sorted(AFTER, key=repr)
    # appending without duplicates goes to the live version
    assert tables.append_dedup(spark.sql("select 1 id, 'zz' v union all select 8, 'h'"), name, ["id"]) == 1
    assert spark.table(name).count() == 5


def test_published_name_takes_every_write(spark, name, tmp_path):
    where = str(tmp_path)
    tables.upsert(spark.sql(BASE), name, ["id"], location=where)
    tables.write_table(spark.sql("select 7 id, 'g' v"), name, mode="append")
    assert spark.table(name).count() == 3
    tables.write_table(spark.sql("select 8 id, 'h' v, 1 w"), name, mode="append", merge_schema=True)
    assert rows(spark.table(name).filter("id >= 7"), "id", "w") == [(7, None), (8, 1)]
    tables.overwrite_table(spark.sql("select 9 id"), name, path=where)
    assert rows(spark.table(name)) == [(9, None, None)]
    tables.write_table(spark.sql("select 'z' z"), name, mode="overwrite", overwrite_schema=True, path=where)
    assert rows(spark.table(name)) == [("z",)]
    spark.sql(f"CREATE VIEW {name}_v AS SELECT 1 id")
    with pytest.raises(ValueError, match="not published here"):
        tables.write_table(spark.sql("select 1 id"), f"{name}_v", mode="append")


def test_upsert_into_plain_table(spark, name):
    spark.sql(BASE).write.saveAsTable(name)
    old = tables.table_location(spark, name)
    assert tables.upsert(spark.sql(NEXT), name, ["id"]) == {"inserted": 2, "updated": 1, "total_processed": 3}
    assert not publish.is_view(spark, name) and rows(spark.table(name)) == sorted(AFTER, key=repr)
    assert rows(spark.read.parquet(old)) == [(1, "a"), (2, "b")]
    assert tables.upsert(spark.sql("select 3 id, 'C' v"), name, ["id"])["updated"] == 1
    assert tables.table_location(spark, name).count("_attempt_") == 1
    tables.write_table(spark.sql("select 9 id, 'i' v"), name, mode="append")
    assert rows(spark.table(name).filter("id > 2")) == [(3, "C"), (9, "i")]


def test_upsert_into_table_partitioned_by_other_columns(spark, name):
    spark.sql("select * from values (1, 'a', 'x'), (2, 'b', 'y') t(id, v, d)").write.partitionBy("d").saveAsTable(name)
    batch = spark.sql("select 2 id, 'B' v, 'z' d union all select 3, 'c', 'x'")
    assert tables.upsert(batch, name, ["id"]) == {"inserted": 1, "updated": 1, "total_processed": 2}
    assert rows(spark.table(name), "id", "v", "d") == [(1, "a", "x"), (2, "B", "z"), (3, "c", "x")]


def test_upsert_rewrites_only_touched_partitions(spark, name, tmp_path):
    where = str(tmp_path / "t")
    spark.sql(
        "select * from values (1, 'a', 'x'), (2, 'b', 'y'), (5, 'e', null) t(id, v, d)"
    ).write.partitionBy("d").option("path", where).saveAsTable(name)
    before = set(os.listdir(where + "/d=x"))
    batch = spark.sql("select * from values (2, 'B', 'y'), (3, 'c', 'y'), (6, 'f', null) t(id, v, d)")
    assert tables.upsert(batch, name, ["id", "d"]) == {"inserted": 2, "updated": 1, "total_processed": 3}
    assert rows(spark.table(name), "id", "v", "d") == sorted(
        [(1, "a", "x"), (2, "B", "y"), (3, "c", "y"), (5, "e", None), (6, "f", None)], key=repr
    )
    assert set(os.listdir(where + "/d=x")) == before


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
@pytest.mark.parametrize("literals", [200, 1])
def test_upsert_scan_is_pruned_to_the_batch(spark, name, monkeypatch, broadcast, literals):
    """A batch of few partitions has the scan list no other's files, however the join is done."""
    monkeypatch.setattr(tables, "PARTITION_LITERALS", literals)
    base = spark.sql("select id, id % 9 d, if(id % 5 = 0, null, id % 3) e, 'old' v from range(90)")
    tables.write_table(base, name, mode="append", partition_by=["d", "e"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        one = spark.sql("select 4L id, 4L d, 1L e, 'new' v")
        files = tables.touched_partitions(spark.table(name), one, ["d", "e"]).inputFiles()
        assert files and all("d=4/e=1/" in f for f in files)
        several = spark.sql("select * from values (4L, 4L, 1L, 'n'), (5L, 5L, null, 'n') t(id, d, e, v)")
        files = tables.touched_partitions(spark.table(name), several, ["d", "e"]).inputFiles()
        assert files and all("/d=4/" in f or "/d=5/" in f for f in files)
        assert tables.upsert(several, name, ["id", "d", "e"]) == {"inserted": 1, "updated": 1, "total_processed": 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a NULL key meets no other, so its row is new
    assert spark.table(name).count() == 91 and spark.table(name).filter("v = 'n'").count() == 2


def test_upsert_creates_a_partitioned_table(spark, name, tmp_path):
    batch = spark.sql("select id, id % 3 d, 'a' v from range(9)")
    where = str(tmp_path / "t")
    assert tables.upsert(batch, name, ["id", "d"], partition_by=["d"], location=where)["inserted"] == 9
    assert tables.partition_columns(spark, name) == ["d"] and sorted(f for f in os.listdir(where) if "=" in f) == ["d=0", "d=1", "d=2"]
    tables.write_with_strategy(batch.filter("id = 1"), name + "2", "merge_on_key", merge_key=["id", "d"], partition_by=["d"])
    assert tables.partition_columns(spark, name + "2") == ["d"]
    # a published table keeps its layout when a new version is written
    publish.publish(spark, name + "v", publish.write_version(batch, name + "v", partition_by=["d"]))
    tables.upsert(batch.filter("id = 1"), name + "v", ["id"])
    assert tables.partition_columns(spark, publish.current_version(spark, name + "v")) == ["d"]


def test_upsert_from_a_checkpointed_batch(spark, name):
    tables.upsert(spark.sql(BASE), name, ["id"])
    assert tables.upsert(spark.sql(NEXT), name, ["id"], keep_batch="checkpoint")["updated"] == 1
    assert rows(spark.table(name)) == sorted(AFTER, key=repr)


def test_upsert_refuses_bad_batches(spark, name):
    with pytest.raises(ValueError, match="beyond the first"):
        tables.upsert(spark.sql("select 1 id, 'a' v union all select 1, 'b'"), name, ["id"])
    with pytest.raises(ValueError, match="not in columns"):
        tables.upsert(spark.sql(BASE), name, ["zz"])
    with pytest.raises(ValueError, match="at least one"):
        tables.upsert(spark.sql(BASE), name, [])
    assert not spark.catalog.tableExists(name)


# --- promotion, quarantine, metrics ------------------------------------------------------------------------
def test_promote_only_on_pass(spark, name):
    good = publish.write_version(spark.sql("select 1 id"), name, run_id="r1")
    assert good == f"{name}_attempt_r1"
    check = lambda v: quality.run_checks(spark, quality.check_nulls(quality.null_counts(spark.table(v), ["id"]), name))
    assert publish.promote_on_gate(spark, name, good, check(good)).startswith("QA PASS")
    bad = publish.write_version(spark.sql("select cast(null as int) id"), name, run_id="r2")
    with pytest.raises(quality.GateFailed):
        publish.promote_on_gate(spark, name, bad, check(bad))
    assert rows(spark.table(name)) == [(1,)] and spark.catalog.tableExists(bad)
    with pytest.raises(Exception, match="(?i)exist"):
        publish.write_version(spark.sql("select 2 id"), name, run_id="r2")
    with pytest.raises(ValueError, match="not a published view"):
        publish.publish(spark, good, bad)
    with pytest.raises(ValueError, match="invalid"):
        publish.quoted("a..b")


def test_quarantine_and_metrics_in_one_pass(spark, name):
    df = spark.sql("select * from values (1, 5), (null, 5), (2, null) t(id, v)")
    seen = Observation()
    exp = {"valid_id": "id IS NOT NULL", "valid_v": "v > 0"}
    side_tables.write_with_quarantine(df, name, exp, metrics=seen)
    side_tables.write_with_quarantine(spark.sql("select 7 id, 7 v"), name, exp)
    assert rows(spark.table(name)) == [(1, 5), (7, 7)]
    assert rows(spark.table(side_tables.quarantine_name(name)), "id", "_reasons") == [(2, ["valid_v"]), (None, ["valid_id"])]
    assert side_tables.quarantine_name("a.b.meters") == "a.b._quarantine_meters"
    side_tables.append_metrics(seen, df, run_id="r1", table=name, metrics_table=f"{name}_metrics")
    assert rows(spark.table(f"{name}_metrics"), "metric", "value") == [
        ("rows_in", 3), ("rows_quarantined", 2), ("valid_id", 1), ("valid_v", 1),
    ]


def test_quarantine_beside_a_merge_can_be_run_again(spark, name):
    expect = {"valid_id": "id IS NOT NULL", "valid_v": "v > 0"}
    side_tables.write_guarded(spark.sql("select 1 id, 1 v"), name, expect, "merge_on_key", run_id="a", merge_key=["id"])

    def run(sql):
        return side_tables.write_guarded(
            spark.sql(sql), name, expect, "merge_on_key", run_id="b", merge_key=["id"], metrics_table=f"{name}_metrics"
        )

    batch = "select * from values (1, 5), (2, 6), (null, 5), (3, null) t(id, v)"
    quarantine, metrics = side_tables.quarantine_name(name), f"{name}_metrics"
    for _ in range(2):
        assert run(batch) == {"rows_in": 4, "rows_quarantined": 2, "valid_id": 1, "valid_v": 1}
        assert rows(spark.table(name), "id", "v") == [(1, 5), (2, 6)]
        assert rows(spark.table(quarantine), "id", "v", "_reasons", "_run") == [
            (3, None, ["valid_v"], "b"), (None, 5, ["valid_id"], "b"),
        ]
        assert rows(spark.table(metrics), "metric", "value", "run_id", "table") == [
            ("rows_in", 4, "b", name), ("rows_quarantined", 2, "b", name), ("valid_id", 1, "b", name), ("valid_v", 1, "b", name),
        ]
    # a corrected rerun rejects nothing: the run's rejected rows go, other runs' stay
    side_tables.write_guarded(spark.sql("select null id, 1 v"), name, expect, "merge_on_key", run_id="c", merge_key=["id"])
    run("select * from values (1, 5), (2, 6), (3, 7) t(id, v)")
    assert rows(spark.table(quarantine), "_run") == [("c",)] and spark.table(name).count() == 3
    assert spark.table(f"{quarantine}_lanes").filter("_lane = 'primary'").isEmpty()
    with pytest.raises(ValueError, match="not published here"):
        side_tables.write_with_quarantine(spark.sql("select 1 id, 1 v"), f"{name}_q", expect)
        tables.upsert(spark.sql("select 100 id, 1 v"), f"{name}_q", ["id"])
    with pytest.raises(ValueError, match="run id"):
        side_tables.write_guarded(spark.sql("select 1 id, 1 v"), name, expect, "none", run_id="")


# --- streaming and the whole flow --------------------------------------------------------------------------
def test_bronze_is_exactly_once(spark, name, tmp_path):
    """A batch that runs again replaces its partition; later batch writes are seen; empty batches hide no full one."""
    src, check, schema = str(tmp_path / "src"), str(tmp_path / "check"), StructType.fromDDL("id int")
    lines = spark.createDataFrame([('{"id": %d}' % i,) for i in range(3)] + [("",)] * 117, "value string")
    lines.repartition(1).write.option("maxRecordsPerFile", 1).text(src)
    full = [f for f in sorted(os.listdir(src)) if f.endswith(".txt") and os.path.getsize(f"{src}/{f}") > 1]
    for f in os.listdir(src):
        os.utime(f"{src}/{f}", (1, 1) if f in full else (1_000_000, 1_000_000))
    counts = {}
    stream = lambda: bronze.bronze_stream(spark, src, schema, options={"maxFilesPerTrigger": "1"})
    expect = {"small": "id < 2"}
    assert bronze.refresh_table(stream(), name, check, expectations=expect, counts=counts) is True
    assert counts == {"n_rows": 3, "small": 1}
    assert max(int(p) for p in os.listdir(check + "/commits") if p.isdigit()) == 119
    assert rows(spark.table(name), "id") == [(0,), (1,), (2,)]
    # the next batch twice, as if the process had died between its write and its commit
    spark.sql("select '{\"id\": 5}' value").write.mode("append").text(src)
    for _ in range(2):
        assert bronze.refresh_table(stream(), name, check) is True
        assert rows(spark.table(name), "id") == [(0,), (1,), (2,), (5,)]
        for f in ("120", ".120.crc"):
            os.remove(f"{check}/commits/{f}")
    bronze.refresh_table(stream(), name, check)
    assert bronze.refresh_table(stream(), name, check) is False
    tables.write_table(spark.sql("select 9 id"), name, mode="append")
    assert rows(spark.table(name), "id") == [(0,), (1,), (2,), (5,), (9,)]
    assert rows(spark.table(name).filter("_batch is null"), "id") == [(9,)]


def test_flow_counts_what_it_drops(spark, name, tmp_path):
    root, check = str(tmp_path / "landing"), str(tmp_path / "check")
    schema = StructType.fromDDL("id int, updated_at string")
    lines = ['{"id": 1, "updated_at": "2024-01-01"}', '{"updated_at": "2024-01-01"}', '{"id": 2, "x": 1}', '{"id": 1, "updated_at": "2024-01-02"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(root)
    warned, dropped = {}, {}
    expect = {"no_rescued_data": "_rescued IS NULL"}
    ingest.refresh_bronze(
        spark, root, schema, name, check, expectations=expect, counts=warned, partition_by=["id"],
        options={"maxFilesPerTrigger": "1"},
    )
    assert warned == {"n_rows": 4, "no_rescued_data": 1} and tables.partition_columns(spark, name) == ["_batch", "id"]
    for _ in range(2):
        ingest.refresh_silver(spark, name, name + "s", ["id"], check + "s", counts=dropped, location=str(tmp_path / "s"), keep_versions=0)
        assert dropped == {"n_rows": 4, "n_dropped": 1, "valid_id": 1}
    assert rows(spark.table(name + "s"), "id") == [(1,), (2,)]
    assert "_batch" not in spark.table(name + "s").columns


def test_bronze_refresh_takes_each_file_once(spark, name, tmp_path):
    root, check = str(tmp_path / "landing"), str(tmp_path / "check")
    schema = StructType.fromDDL("id int, updated_at string")
    land = lambda sql, run: landing.write_landing(spark.sql(sql), root, "meters", dt="2024-01-01", run_id=run)
    land("select 1 id, '2024-01-01' updated_at, 'x' more", "1")
    refresh = lambda: ingest.refresh_bronze(spark, root + "/meters", schema, name, check)
    assert refresh() is True and refresh() is False
    assert spark.table(name).count() == 1
    land("select 2 id, '2024-01-02' updated_at", "2")
    assert refresh() is True
    got = rows(spark.table(name), "id", "_rescued")
    assert got == [(1, '{"more":"x"}'), (2, None)]
    assert spark.table(name).filter("_source_file is null or _ingested_at is null").isEmpty()


def test_foreach_batch_skips_empty(spark, tmp_path):
    src, check = str(tmp_path / "src"), str(tmp_path / "check")
    spark.sql("select 'not json' value").write.text(src)
    calls = []
    stream = lambda: bronze.bronze_stream(spark, src, StructType.fromDDL("id int")).filter("id is not null")
    assert bronze.refresh_with(stream(), lambda df, i: calls.append(df.count()), check) is False
    assert calls == []
    spark.sql("select '{\"id\": 1}' value").write.mode("append").text(src)
    bronze.refresh_with(stream(), lambda df, i: calls.append(df.count()), check)
    assert calls == [1]


def test_flow_from_fetch_to_silver(spark, name, tmp_path):
    root, check, table = str(tmp_path / "landing"), str(tmp_path / "check"), f"{name}_bronze"
    schema = StructType.fromDDL("id string, updated_at string, v int, content_hash string")

    def run(sql, run_id):
        skipped = ingest.land_changes(
            spark, spark.sql(sql), table, "id", root=root, entity="meters", dt="2024-01-01", run_id=run_id
        )
        if skipped is None:
            ingest.refresh_bronze(spark, root + "/meters", schema, table, check)
        return skipped

    one = "select * from values ('1', '2024-01-01 00:00:00', 1), ('2', 'bad', 1), (null, '2024-01-01 00:00:00', 1) t(id, updated_at, v)"
    assert run(one, "1") is None
    assert spark.table(table).count() == 3
    # only the NULL key, which cannot be looked up, comes again
    assert run(one, "2") is None
    assert spark.table(table).count() == 4
    keyed = one.replace(", (null, '2024-01-01 00:00:00', 1)", "")
    assert run(keyed, "3") == "no new meters records"
    assert run("select '1' id, '2024-02-01 00:00:00' updated_at, 2 v", "4") is None
    silver = ingest.silver(spark.table(table), ["id"])
    assert rows(silver, "id", "v") == [("1", 2), ("2", 1)]
    assert "_rescued" not in silver.columns and dict(silver.dtypes)["updated_at"] == "timestamp"
    reasons = ingest.silver_with_reasons(spark.table(table), ["id"])
    assert reasons.filter("array_contains(_reasons, 'valid_id')").count() == 2
    assert reasons.filter("array_contains(_reasons, 'updated_at: not a timestamp')").count() == 1
    assert ingest.incremental(spark.table(table), "v", None).count() == 5
    assert ingest.incremental(spark.table(table), "v", spark.table(table).filter("v = 1")).count() == 1


def test_silver_folded_in_steps_equals_silver_of_everything(spark, name, tmp_path):
    rng = random.Random(3)
    bronze_table, silver_table = f"{name}_bronze", f"{name}_silver"
    where = str(tmp_path / "silver")
    for step in range(3):
        batch = [
            (rng.choice([None, *"abcdef"]), rng.choice(["2024-01-0%d 00:00:00" % d for d in range(1, 6)] + ["bad"]), rng.randint(0, 99))
            for _ in range(40)
        ]
        rows_ = changes.stamp_hash(spark.createDataFrame(batch, "id string, updated_at string, v int"))
        tables.write_table(rows_.withColumns({"_ingested_at": F.lit(step), "_rescued": F.lit(None).cast("string")}), bronze_table, mode="append")
        refresh = lambda: ingest.refresh_silver(
            spark, bronze_table, silver_table, ["id"], str(tmp_path / "check"), location=where
        )
        assert refresh() is True
        whole = ingest.silver(spark.table(bronze_table), ["id"])
        assert rows(spark.table(silver_table), *whole.columns) == rows(whole)
    assert refresh() is False


def _random_value(rng, depth=0):
    kinds = ["int", "frac", "text", "digits", "bool", "null"] + (["obj", "list"] if depth < 2 else [])
    kind = rng.choice(kinds)
    if kind == "obj":
        return {k: _random_value(rng, depth + 1) for k in rng.sample(["x", "y", "z"], rng.randint(0, 3))}
    if kind == "list":
        return [_random_value(rng, 2) for _ in range(rng.randint(0, 2))]
    return {"int": rng.randint(-5, 5), "frac": 2.5, "text": "t", "digits": "12", "bool": True, "null": None}[kind]


def _expected(doc, fields, prefix=""):
    """Typed values and rescued entries of one object by plain rules."""
    typed, lost = {}, {}
    for name, kind in fields.items():
        value = doc.get(name)
        if isinstance(kind, dict):
            if isinstance(value, dict):
                typed[name], inner = _expected(value, kind, f"{prefix}{name}.")
                lost.update(inner)
                continue
            fits = None
        elif kind == "int":
            ok = (isinstance(value, int) and not isinstance(value, bool)) or value == "12"
            fits = int(value) if ok else None
        else:
            fits = json.dumps(value, separators=(",", ":"), sort_keys=True) if not isinstance(value, (str, type(None))) else value
        typed[name] = fits
        if value is not None and fits is None:
            lost[prefix + name] = value
    lost.update({prefix + k: v for k, v in doc.items() if k not in fields})
    return typed, lost


def test_rescue_against_plain_rules(spark):
    rng = random.Random(11)
    fields = {"a": "int", "b": "text", "s": {"x": "int", "y": "text"}}
    docs = [{k: _random_value(rng) for k in rng.sample(["a", "b", "s", "other"], rng.randint(0, 4))} for _ in range(150)]
    df = spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)], "value string, i int")
    got = {r["i"]: r for r in rescue.parse_with_rescue(df, StructType.fromDDL("a int, b string, s struct<x:int,y:string>")).collect()}
    for i, doc in enumerate(docs):
        typed, lost = _expected(doc, fields)
        row = got[i]
        assert (row["a"], row["b"]) == (typed["a"], typed["b"]), doc
        assert (row["s"].asDict() if row["s"] else None) == typed["s"], doc
        assert (json.loads(row["_rescued"]) if row["_rescued"] else {}) == lost, doc
