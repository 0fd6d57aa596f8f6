import pytest
from pyspark.sql import functions as F

from recframe.errors import SpecError
from recframe.functions import codec
from recframe.plans import logical
from recframe.plans.framing import FrameCutter, Framing
from recframe.plans.indexing import derive_per_frame, with_frames, with_record_index
from tests.model import lines


def test_values(spark):
    df = spark.createDataFrame([(0, b'{"a": 1, "b": {"c": "x"}}\n'), (1, b'{"a": 2}')], "record_index long, record binary")
    assert [r["a"] for r in codec.decode(df, "json", schema="a long, b struct<c: string>").select("value.a").collect()] == [1, 2]
    assert codec.decode(df, "json").select(F.try_variant_get("value", "$.b.c", "string").alias("c")).first()["c"] == "x"
    bad = spark.createDataFrame([(0, b"not json\n"), (1, b"\xff\xfe\n")], "record_index long, record binary")
    assert [r["value"] for r in codec.decode(bad, "json", strict=False).collect()] == [None, None]
    with pytest.raises(Exception):
        codec.decode(bad, "json").collect()
    assert [r["value"] for r in codec.decode(bad).orderBy("record_index").collect()] == ["not json", None]
    csv = spark.createDataFrame([(0, b"1,x\n")], "record_index long, record binary")
    assert codec.decode(csv, "csv", schema="n int, s string").select("value.s").first()["s"] == "x"
    fmt = spark.createDataFrame([(0, b"level=info seq=3\n")], "record_index long, record binary")
    assert codec.decode(fmt, "logfmt").first()["value"] == {"level": "info", "seq": "3"}
    for k in (dict(format="csv"), dict(format="toml")):
        with pytest.raises(SpecError):
            codec.decode(df, **k)


def test_records_from_values(spark):
    df = spark.createDataFrame([(1, "x")], "n long, s string")
    assert bytes(codec.encode(df, "json").first()["record"]) == b'{"n":1,"s":"x"}\n'
    assert bytes(codec.encode(df, "csv").first()["record"]) == b"1,x\n"
    assert bytes(codec.encode(df.select("s")).first()["record"]) == b"x\n"
    for k in (dict(), dict(column="n"), dict(format="toml")):
        with pytest.raises(SpecError):
            codec.encode(df, **k)


def test_index_is_dense_whatever_the_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = with_record_index(df, "k").collect()
    assert sorted((r["k"], r["record_index"]) for r in rows) == [(i, i) for i in range(1000)]
    assert with_record_index(df.limit(0), "k").count() == 0
    with pytest.raises(SpecError):
        with_record_index(df)


def test_frames(spark):
    records = lines(300)
    df = spark.createDataFrame(list(enumerate(records)), "record_index long, record binary")
    cutter = FrameCutter(Framing(frame_size=1000))
    frames = [f for r in records for f in cutter.add(r)] + list(cutter.finish())
    n = derive_per_frame(df, 1000)
    assert n == frames[0][1] and sum(len(f) for f, _ in frames) == sum(map(len, records))
    assert with_frames(df, n).agg(F.max("frame")).first()[0] == len(frames) - 1
    assert derive_per_frame(df, 10**9) == 300
    for bad in (dict(frame_size=0), dict(records_per_frame=0), dict(records_per_frame=3, uniform=False)):
        with pytest.raises(SpecError):
            Framing(**bad)


def test_long_records_before_the_count_is_known():
    cutter = FrameCutter(Framing(frame_size=10, limit_multiplier=2))
    frames = [f for r in (b"x" * 50 + b"\n", b"a\n", b"b\n") for f in cutter.add(r)] + list(cutter.finish())
    assert [n for _, n in frames] == [1, 1, 1]
    with pytest.raises(ValueError):
        list(FrameCutter(Framing(frame_size=10, limit_multiplier=2, records_per_frame=2)).add(b"x" * 50))


def test_logical_edits(spark):
    df = with_frames(spark.range(25).select(F.col("id").alias("record_index"), F.lit(b"r").alias("record")), 10)
    assert logical.truncate(df, 10).count() == 10
    assert [r["record_index"] for r in logical.copy_range(df, 20, 3).collect()] == [0, 1, 2]
    assert logical.concat(df, 25, df).agg(F.countDistinct("record_index")).first()[0] == 50
    assert list(logical.rewritten_frames(25, 10, 10)) == [2, 3] and not list(logical.rewritten_frames(25, 0, 10))
    assert logical.uniformity(df, 10).count() == 0 and logical.uniformity(df.where("record_index != 3"), 10).count() == 1
