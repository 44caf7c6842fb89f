import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewright.operators import changes, dedup, expectations, feed, keys, merge, scope, typing, voids
from tests.conftest import rows


# --- voids -------------------------------------------------------------------------------------------------
def test_void_defense(spark):
    df = spark.sql("select null tariff, 7L meter, null remark, 2.5 reading")
    assert voids.void_columns(df.schema) == ["tariff", "remark"]
    cast = voids.defend_voids(df)
    assert dict(cast.dtypes) == {"tariff": "string", "meter": "bigint", "remark": "string", "reading": "decimal(2,1)"}
    assert voids.defend_voids(df, None).columns == ["meter", "reading"]
    plain = spark.sql("select 7L meter")
    assert voids.defend_voids(plain) is plain and voids.defend_voids(plain, None) is plain


def test_void_defense_nested(spark):
    df = spark.sql("select named_struct('x', 1, 'y', null) s, array(null) a, map('k', null) m")
    out = voids.defend_voids(df, "bigint")
    assert dict(out.dtypes) == {"s": "struct<x:int,y:bigint>", "a": "array<bigint>", "m": "map<string,bigint>"}
    assert out.first()["s"]["x"] == 1


def test_void_defense_survives_write_and_append(spark, tmp_path):
    path = str(tmp_path / "v")
    voids.defend_voids(spark.sql("select 1 id, null v")).write.parquet(path)
    spark.sql("select 2 id, 'x' v").write.mode("append").parquet(path)
    assert rows(spark.read.parquet(path)) == [(1, None), (2, "x")]


# --- dedup -------------------------------------------------------------------------------------------------
def test_latest_wins_and_null_order(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b"), (1, 7, "c"), (2, None, "d")], "id int, ts int, v string")
    assert rows(dedup.latest_wins(df, ["id"], ["ts"])) == [(1, 7, "c"), (2, None, "d")]
    with pytest.raises(ValueError):
        dedup.latest_wins(df, [], ["ts"])


def test_latest_wins_tie_does_not_depend_on_row_order(spark):
    data = [(1, 5, f"v{i}", {"k": i}) for i in range(50)]
    picks = set()
    for seed in range(4):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "id int, ts int, v string, m map<string,int>").repartition(seed + 1)
        picks.add(dedup.latest_wins(df, ["id"], ["ts"]).first()["v"])
    assert len(picks) == 1


def test_latest_wins_limits_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as ts")
    plan = dedup.latest_wins(df, ["k"], ["ts"])._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before and "Partial" in before


# --- scope -------------------------------------------------------------------------------------------------
def test_watermark(spark, name):
    assert scope.latest_watermark(spark, name, "ts") is None
    spark.createDataFrame([], "ts int").write.saveAsTable(name)
    assert scope.latest_watermark(spark, name, "ts") is None
    spark.createDataFrame([(0,), (-4,)], "ts int").write.insertInto(name)
    assert scope.latest_watermark(spark, name, "ts") == 0
    df = spark.createDataFrame([(-1,), (1,)], "ts int")
    assert rows(scope.newer_than(df, "ts", 0)) == [(1,)]
    assert scope.newer_than(df, "ts", None) is df


def test_sample_scope(spark):
    df = spark.range(10)
    assert scope.sample_scope(df, where="id < 3").count() == 3
    assert scope.sample_scope(df, limit=4).count() == 4
    with pytest.raises(ValueError):
        scope.sample_scope(df)
    with pytest.raises(ValueError):
        scope.sample_scope(df, limit=0)


# --- typing and expectations -------------------------------------------------------------------------------
def test_type_columns_names_the_misfits(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01 00:00:00"), ("x", "bad"), (None, None)], "n string, ts string"
    )
    out = typing.type_columns(df, {"n": "int", "ts": "timestamp"}, reasons="_reasons")
    assert dict(out.dtypes)["ts"] == "timestamp" and dict(out.dtypes)["n"] == "int"
    got = [r["_reasons"] for r in out.collect()]
    assert got == [[], ["n: not a int", "ts: not a timestamp"], []]
    with pytest.raises(ValueError):
        typing.type_columns(df, {"zz": "int"})
    assert typing.drop_helpers(out).columns == ["n", "ts"]


def test_expectations(spark):
    df = spark.createDataFrame([(1, 5), (None, 5), (2, None)], "id int, v int")
    exp = {"valid_id": "id IS NOT NULL", "positive": F.col("v") > 0}
    assert rows(expectations.expectation_counts(df, exp)) == [("positive", 3, 1), ("valid_id", 3, 1)]
    assert rows(expectations.expect_or_drop(df, exp)) == [(1, 5)]
    good, bad = expectations.split_quarantine(df, exp)
    assert rows(good) == [(1, 5)]
    assert sorted(r["_reasons"][0] for r in bad.collect()) == ["positive", "valid_id"]
    assert good.count() + bad.count() == df.count()


def test_observed_expectations_keep_every_row(spark):
    df = spark.createDataFrame([(1, 5), (None, 5), (2, None)], "id int, v int")
    seen = Observation()
    kept = expectations.observe_expectations(df, {"valid_id": "id IS NOT NULL", "positive": "v > 0"}, seen)
    assert kept.count() == 3 and seen.get == {"n_rows": 3, "valid_id": 1, "positive": 1}


def test_variant_columns_are_hashed_and_compared(spark):
    df = spark.sql("select 1 k, parse_json('{\"b\": 1, \"a\": 2}') v")
    same = spark.sql("select 1 k, parse_json('{\"a\": 2, \"b\": 1}') v")
    other = spark.sql("select 1 k, parse_json('{\"a\": 2, \"b\": 2}') v")
    assert feed.change_feed(df, same, ["k"]).isEmpty()
    assert feed.change_feed(df, other, ["k"]).count() == 2
    assert changes.stamp_hash(df).first()["content_hash"] == changes.stamp_hash(same).first()["content_hash"]
    assert dedup.latest_wins(df, ["k"], []).count() == 1


# --- keys and changes --------------------------------------------------------------------------------------
def test_key_profile(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    assert tuple(keys.key_profile(df, ["k"]).first()) == (6, 3)
    assert tuple(keys.key_profile(df, ["k"], nulls_group=False).first()) == (6, 2)
    assert tuple(keys.key_profile(df.limit(0), ["k"]).first()) == (0, 0)
    with pytest.raises(ValueError, match="beyond the first"):
        keys.require_unique(df, ["k"], "batch")


BATCH = [(1, "same"), (2, "new"), (3, "fresh"), (None, "nokey"), (4, "lost"), (2, "new")]


def _stored(spark):
    base = changes.stamp_hash(
        spark.createDataFrame([(1, "same"), (3, "stale"), (None, "nokey"), (4, "lost"), (9, "other")], "id int, v string")
    )
    # key 4 has a NULL hash, and key 1 an older version besides
    old = changes.stamp_hash(spark.createDataFrame([(1, "older")], "id int, v string")).withColumn("_ingested_at", F.lit(1))
    return (
        base.withColumn("content_hash", F.when(~F.col("id").eqNullSafe(4), F.col("content_hash")))
        .withColumn("_ingested_at", F.lit(2))
        .unionByName(old)
    )


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_classify_changes(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        batch = spark.createDataFrame(BATCH, "id int, v string")
        out = changes.classify_changes(batch, _stored(spark), "id")
        assert out.columns == ["id", "v", "content_hash", "change_class"]
        got = rows(out.select("id", "v", "change_class"))
        assert got == sorted(
            [
                (1, "same", "unchanged"),
                (2, "new", "new"),
                (2, "new", "new"),
                (3, "fresh", "changed"),
                (4, "lost", "changed"),
                (None, "nokey", "new"),
            ],
            key=repr,
        )
        assert changes.needing_update(batch, _stored(spark), "id").count() == 5
        lookup = changes.existing_hashes(_stored(spark), batch, "id")
        assert sorted(r["id"] for r in lookup.collect()) == ["1", "3", "4"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_classify_restamped_and_missing_table(spark):
    batch = changes.stamp_hash(spark.createDataFrame([(1, "same")], "id int, v string"))
    assert changes.classify_changes(batch, batch, "id").first()["change_class"] == "unchanged"
    assert changes.classify_changes(batch, None, "id").first()["change_class"] == "new"
    assert changes.existing_hashes(None, batch, "id").count() == 0
    assert changes.needing_update(batch.limit(0), batch, "id").count() == 0
    # text keys meet integer keys
    text = batch.withColumn("id", F.lit("1"))
    assert changes.classify_changes(text, batch, "id").first()["change_class"] in ("changed", "unchanged")


def test_hot_key_join_is_split(spark):
    """A key that holds half of the batch is spread over tasks by adaptive execution."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        batch = spark.range(0, 40000, 1, 8).selectExpr("if(id % 2 = 0, 7, id) as id", "repeat(uuid(), 3) as v")
        stored = changes.stamp_hash(spark.range(0, 40000, 1, 8).selectExpr("id", "'x' as v"))
        out = changes.classify_changes(batch, stored, "id")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k in settings:
            spark.conf.unset(k)


# --- feed --------------------------------------------------------------------------------------------------
def _snapshots(spark, seed):
    rng = random.Random(seed)
    old = {i: rng.randint(0, 3) for i in range(40) if rng.random() < 0.7}
    new = {i: rng.randint(0, 3) for i in range(40) if rng.random() < 0.7}
    make = lambda d, tag: spark.createDataFrame(
        [(k, v, {"a": v}) for k, v in d.items()] + [(None, tag, None)], "k int, v int, m map<string,int>"
    )
    return old, new, make(old, 1), make(new, 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_change_feed_against_brute_force(spark, seed):
    old, new, old_df, new_df = _snapshots(spark, seed)
    expected = [(None, 1, "delete"), (None, 2, "insert")]
    for k in old.keys() | new.keys():
        if k not in new:
            expected.append((k, old[k], "delete"))
        elif k not in old:
            expected.append((k, new[k], "insert"))
        elif old[k] != new[k]:
            expected += [(k, old[k], "update_preimage"), (k, new[k], "update_postimage")]
    out = feed.change_feed(old_df, new_df, ["k"])
    assert rows(out.select("k", "v", "_change_type")) == sorted(expected, key=repr)
    assert rows(feed.apply_feed(old_df, out, ["k"]).select("k", "v")) == rows(new_df.select("k", "v"))


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_change_feed_shuffles_no_unchanged_rows(spark, limit):
    """NULLs in other places differ, however a hash passes over them; with few changes no wide row is exchanged."""
    old = spark.range(2000).selectExpr("id k", "cast(null as string) a", "'x' b", "array(1, null) c", "repeat('w', 50) wide")
    new = old.selectExpr("k", "if(k = 5, b, a) a", "if(k = 5, a, b) b", "if(k = 6, array(null, 1), c) c", "wide").filter("k > 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        out = feed.change_feed(old, new, ["k"])
        got = rows(out, "k", "_change_type")
        assert got == sorted([(0, "delete")] + [(k, t) for k in (5, 6) for t in ("update_preimage", "update_postimage")], key=repr)
        if limit != "-1":
            # the semi joins that drop what has not changed are done where the rows are read
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("LeftSemi") >= 2 and "SortMergeJoin [k" not in plan.split("LeftSemi", 1)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_change_feed_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="old snapshot"):
        feed.change_feed(df, df.limit(1), ["k"])
    with pytest.raises(ValueError, match="differ in columns"):
        feed.change_feed(df, df.withColumn("z", F.lit(1)), ["k"])


# --- merge -------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_merged_rows(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        target = spark.createDataFrame(
            [(1, "s1", 1.0, "keep"), (2, "s1", 2.0, "keep"), (None, "s1", 3.0, "n")], "id int, season string, value double, extra string"
        )
        source = spark.createDataFrame(
            [(1, "s1", 10.0), (3, "s1", None), (None, "s1", 30.0)], "id int, season string, value double"
        )
        out = merge.merged_rows(target, source, ["id", "season"])
        assert rows(out) == sorted(
            [
                (1, "s1", 10.0, "keep", "update"),
                (2, "s1", 2.0, "keep", "keep"),
                (None, "s1", 3.0, "n", "keep"),
                (3, "s1", None, None, "insert"),
                (None, "s1", 30.0, None, "insert"),
            ],
            key=repr,
        )
        assert tuple(merge.upsert_counts(out, 3).first()) == (2, 1, 3)
        assert tuple(merge.row_counts(target, source, out).first()) == (3, 3, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_merge_updates_every_target_copy_and_nulls_overwrite(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b")], "id int, v string")
    source = spark.createDataFrame([(1, None)], "id int, v string")
    assert rows(merge.merged_rows(target, source, ["id"])) == [(1, None, "update"), (1, None, "update")]


def test_merge_all_key_table_and_bad_keys(spark):
    target = spark.createDataFrame([(1,)], "id int")
    source = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(merge.merged_rows(target, source, ["id"])) == [(1, "update"), (2, "insert")]
    with pytest.raises(ValueError, match="not in columns"):
        merge.merged_rows(target, source, ["missing"])
    with pytest.raises(ValueError, match="at least one"):
        merge.merged_rows(target, source, [])
    with pytest.raises(ValueError, match="not in target"):
        merge.merged_rows(target, source.withColumn("x", F.lit(1)), ["id"])
