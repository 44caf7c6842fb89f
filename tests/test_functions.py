import hashlib
import json

from pyspark.sql import functions as F

from tidewright.functions import hashing, scalars
from tests.conftest import rows


def _hash(df):
    return df.select(hashing.row_hash(df).alias("h")).first()["h"]


def test_hash_ignores_column_order(spark):
    assert _hash(spark.sql("select 1 a, 2 b")) == _hash(spark.sql("select 2 b, 1 a"))


def test_hash_sees_values_nulls_and_names(spark):
    texts = ["select 1 a", "select 2 a", "select cast(null as int) a", "select 1 b", "select 'x' a", "select 'y' a"]
    assert len({_hash(spark.sql(t)) for t in texts}) == len(texts)
    assert _hash(spark.sql("select 1 a, cast(null as int) b")) != _hash(spark.sql("select 1 a"))


def test_hash_sees_microseconds(spark):
    a = "select timestamp'2024-01-01 00:00:00.123456' t, timestamp_ntz'2024-01-01 00:00:00.123456' n"
    assert _hash(spark.sql(a)) != _hash(spark.sql(a.replace(".123456' t", ".123457' t")))
    assert _hash(spark.sql(a)) != _hash(spark.sql(a.replace(".123456' n", ".123457' n")))


def test_hash_does_not_depend_on_session_zone(spark):
    df = spark.sql("select timestamp_micros(1704067200123456) t")
    before = _hash(df)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert _hash(spark.sql("select timestamp_micros(1704067200123456) t")) == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hash_orders_nested_fields_and_map_entries(spark):
    a = "select named_struct('x', 1, 'y', map('b', 1, 'a', 2)) s, array(named_struct('p', 1, 'q', 2)) l"
    b = "select named_struct('y', map('a', 2, 'b', 1), 'x', 1) s, array(named_struct('q', 2, 'p', 1)) l"
    assert _hash(spark.sql(a)) == _hash(spark.sql(b))
    deep = "select map('k', map('b', 1, 'a', 2)) m"
    assert _hash(spark.sql(deep)) == _hash(spark.sql("select map('k', map('a', 2, 'b', 1)) m"))
    assert _hash(spark.sql("select cast(null as struct<x:int>) s")) != _hash(
        spark.sql("select named_struct('x', cast(null as int)) s")
    )


def test_hash_covers_void_and_stamp_is_stable(spark):
    assert _hash(spark.sql("select 1 a, null v"))
    once = hashing.stamp_hash(spark.sql("select 1 id, 'same' v"))
    twice = hashing.stamp_hash(once)
    assert once.first()["content_hash"] == twice.first()["content_hash"]
    expected = hashlib.sha256(json.dumps({"id": 1, "v": "same"}, separators=(",", ":")).encode()).hexdigest()
    assert once.first()["content_hash"] == expected


def test_value_hash(spark):
    df = spark.sql("select 'x' s, cast(null as string) n, array(1, 2) a")
    got = df.select(*[hashing.value_hash(df, c).alias(c) for c in df.columns]).first()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got.s, got.n, got.a) == (sha("x"), sha("None"), sha("[1,2]"))


def test_refs(spark):
    df = spark.createDataFrame(
        [("a.b",), ("c.a.b",), ("models:/m",), ("/Volumes/x",), ("t",), ("a..b",), ("1a.b",), ("a.bé",)], "ref string"
    )
    got = dict(rows(df.select("ref", scalars.qualify_ref(F.col("ref"), "cat").alias("q"))))
    assert got["a.b"] == "cat.a.b" and got["c.a.b"] == "c.a.b" and got["t"] == "cat.t"
    assert got["models:/m"] == "models:/m" and got["/Volumes/x"] == "/Volumes/x"
    same = df.select(scalars.qualify_ref(F.col("ref"), "").alias("q"))
    assert rows(same) == rows(df)
    tables = [r.ref for r in df.filter(scalars.is_table_ref(F.col("ref"))).collect()]
    assert tables == ["a.b", "c.a.b", "a.bé"]


def test_small_scalars(spark):
    df = spark.sql("select timestamp'2024-03-05 23:59:59' ts, 'bad' b, '2024-01-02 03:04:05' g, '{\"k\": 7}' j")
    got = df.select(
        scalars.landing_path("/r", "meters", F.col("ts"), "7").alias("p"),
        scalars.parse_timestamp("b").alias("bad"),
        scalars.parse_timestamp("g").cast("string").alias("good"),
        scalars.percent(F.lit(0.1234)).alias("pct"),
        scalars.json_field("j", "$.k", "int").alias("k"),
        scalars.json_field("j", "$.none", "int").alias("absent"),
        scalars.key_text(F.lit(5)).alias("key"),
    ).first()
    assert tuple(got) == ("/r/meters/dt=2024-03-05/run=7", None, "2024-01-02 03:04:05", "12.3%", 7, None, "5")
