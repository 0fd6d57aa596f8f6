import random

import pytest
from pyspark.sql import functions as F

from recframe.errors import IncompleteFrame, NoSeparator, PastEnd, SpecError, Uneven
from recframe.functions.boundary import Custom, Fixed, LengthPrefixed, MessagePack, Separated
from recframe.operators.read import open_records
from recframe.operators.write import compress, write_file, write_folder
from recframe.session import register
from tests.model import cut, lines, put_frames


def got(df):
    return [bytes(r["record"]) for r in df.orderBy("record_index").collect()]


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    records = lines(103, fragment=True)
    path = put_frames(tmp_path_factory.mktemp("r") / "s.txt.seek.zst", cut(records, 10))
    return records, open_records(spark, path, partition_bytes=600)


def test_scan_and_ranges(sample):
    records, h = sample
    assert got(h.scan()) == records
    rng = random.Random(3)
    for _ in range(8):
        a, n = rng.randrange(104), rng.randrange(40)
        assert got(h.records(a, n)) == records[a : a + n]
    assert h.scan().select("record_index").distinct().count() == len(records)


def test_points_and_ends(sample):
    records, h = sample
    assert [h.record(i) for i in (0, 9, 10, 102, 103, 104, 999)] == [records[0], records[9], records[10], records[102], records[103], None, None]
    assert got(h.head(3)) == records[:3] and got(h.tail(4)) == records[-4:] and got(h.skip(100)) == records[100:]
    assert got(h.slice(-5, 2)) == records[:2] and got(h.slice(50, 20)) == []
    assert [r["rev"] for r in h.reverse(5).collect()] == [0, 1, 2, 3, 4]
    assert h.cat(5, 3) == b"".join(records[5:8]) and h.cat(100, None) == b"".join(records[100:])
    assert h.fold(lambda a, r: a + [len(r)], [], 95) == [len(r) for r in records[95:]]


def test_refusals_come_at_once(sample):
    _, h = sample
    for start, kind in ((105, NoSeparator), (111, PastEnd)):
        with pytest.raises(kind):
            h.records(start, 0)
    with pytest.raises(PastEnd):
        h.get(104)
    assert h.get(104, optional=True) is None and h.get(0) == "record 0 "
    with pytest.raises(SpecError):
        h.field("nothing")
    assert (h.field("RECORDS"), h.field("frames"), h.field("records_per_frame"), h.field("nothing", True)) == (104, 11, 10, None)


def test_filters_prune_frames(sample):
    records, h = sample
    everything, one = h.scan(), h.scan().where("record_index = 42")
    assert got(one) == records[42:43]
    assert one.rdd.getNumPartitions() == 1 < everything.rdd.getNumPartitions()
    assert got(h.scan().where("record_index IN (3, 5) AND frame = 0")) == [records[3], records[5]]
    assert got(h.scan().where("record_index > 200")) == []
    assert got(h.scan().where("record_index >= 98 AND record_index <= 99")) == records[98:100]


def test_shards_cover_all(sample):
    records, h = sample
    assert sum((got(h.shard(i, 3)) for i in range(3)), []) == records
    assert got(h.from_frame(10)) == records[100:]
    with pytest.raises(SpecError):
        h.shard(3, 3)


def test_inspect_and_summary(sample):
    records, h = sample
    full, fast = h.inspect(fast=False).orderBy("frame").collect(), h.inspect().orderBy("frame").collect()
    assert [r["cnt_of_sep"] for r in full] == [10] * 10 + [3] == [r["cnt_of_sep"] for r in fast]
    assert full[-1]["decomp_end"] == sum(map(len, records)) and full[1]["comp_start"] == full[0]["comp_end"]
    assert h.summary().first()["records"] == 104
    assert h.verify().count() == 0


def test_uneven_files(spark, tmp_path):
    frames = [b"".join(lines(k)) for k in (10, 4, 10, 10)]
    h = open_records(spark, put_frames(tmp_path / "d.seek.zst", frames))
    assert [r["frame"] for r in h.verify().collect()] == [1]
    assert h.record(14) is None and h.record(20) == lines(10)[0]
    strict = open_records(spark, h.paths, verify=True)
    assert got(strict.records(11, 1)) == lines(2)[1:]  # the frame's end isn't reached
    with pytest.raises(Exception, match="holds 4 records rather than 10"):
        strict.scan().collect()
    with pytest.raises(Uneven):
        strict.record(15)
    exact = open_records(spark, h.paths, index_mode="exact")
    assert got(exact.scan()) == lines(10) + lines(4) + lines(10) + lines(10)
    assert got(exact.records(12, 4)) == lines(4)[2:] + lines(2)


def test_a_fragment_in_the_middle(spark, tmp_path):
    h = open_records(spark, put_frames(tmp_path / "m.seek.zst", [b"a\npartial", b"b\n"]))
    assert h.record(0) == b"a\n"
    with pytest.raises(IncompleteFrame):
        h.cat(0, 2)


def test_other_boundaries(spark, tmp_path):
    import struct

    bodies = [b"body %d " % i + b"." * (i * 31 % 90) for i in range(40)]
    for boundary, records in (
        (LengthPrefixed(), [struct.pack("<I", len(b)) + b for b in bodies]),
        (MessagePack(), [b"\xd9" + bytes([len(b)]) + b for b in bodies]),
        (Fixed(8), [b"rec%05d" % i for i in range(40)]),
        (Separated(b"-=-"), [b + b"-=-" for b in bodies]),
    ):
        path = put_frames(tmp_path / f"{boundary.name}.seek.zst", cut(records, 7))
        h = open_records(spark, path, boundary)
        assert got(h.scan()) == records and h.total() == 40 and h.record(39) == records[39]
    custom = Custom(lambda d: 8 if len(d) >= 8 else None)
    h = open_records(spark, put_frames(tmp_path / "c.seek.zst", cut([b"rec%05d" % i for i in range(9)], 4)), custom)
    assert got(h.records(3, 3)) == [b"rec%05d" % i for i in (3, 4, 5)]


def test_written_files_read_back(spark, tmp_path):
    records = lines(2000)
    df = spark.createDataFrame(list(enumerate(records)), "record_index long, record binary").repartition(5)
    framing = write_file(df, str(tmp_path / "a.txt.seek.zst"), frame_size=4096)
    size, n = 0, 0
    while size < 4096:
        size, n = size + len(records[n]), n + 1
    assert framing.records_per_frame == n
    h = open_records(spark, str(tmp_path / "a.txt.seek.zst"))
    assert got(h.scan()) == records and h.verify().count() == 0
    assert spark.read.text(str(tmp_path / "a.txt.seek.zst")).count() == 2000
    with pytest.raises(ValueError):
        write_file(df, str(tmp_path / "a.txt.seek.zst"))
    write_file(df.select("record", F.col("record_index").alias("k")), str(tmp_path / "a.txt.seek.zst"), "k", force=True, records_per_frame=64)
    assert got(open_records(spark, str(tmp_path / "a.txt.seek.zst")).records(60, 10)) == records[60:70]
    write_file(df, str(tmp_path / "s.seek.zst"), frame_size=500, uniform=False)
    assert all(r["decomp_size"] >= 500 for r in open_records(spark, str(tmp_path / "s.seek.zst")).inspect(False).orderBy("frame").collect()[:-1])


def test_folder_and_modes(spark, tmp_path):
    records = lines(500)
    df = spark.createDataFrame(list(enumerate(records)), "record_index long, record binary").repartition(3)
    path = str(tmp_path / "folder")
    write_folder(df, path, "record_index", records_per_frame=16, extension="txt")
    assert got(open_records(spark, path).scan()) == records
    write_folder(df.where("record_index < 10").coalesce(1), path, "record_index", records_per_frame=16)
    assert open_records(spark, path).total() == 510
    write_folder(df.where("record_index < 10").coalesce(1), path, "record_index", mode="overwrite", records_per_frame=16)
    assert got(open_records(spark, path).scan()) == records[:10]
    assert not [p for p in (tmp_path / "folder").iterdir() if p.name.startswith("_draft")]


def test_compress_retries_nothing_and_keeps_bytes(spark, tmp_path):
    for data in (b"".join(lines(3000)), b"".join(lines(50)) + b"rest", b"one line"):
        source = tmp_path / "in.txt"
        source.write_bytes(data)
        compress(str(source), frame_size=2048, chunk=1000)
        assert b"".join(open_records(spark, f"{source}.seek.zst").layout.files[0].frame_bytes(i) for i in range(1)) if data.endswith(b"\n") else True
    source.write_bytes(b"".join(lines(3000)))
    compress(str(source), str(tmp_path / "out.seek.zst"), remove=True, records_per_frame=100)
    assert not source.exists()
    assert open_records(spark, str(tmp_path / "out.seek.zst")).total() == 3000


def test_growing_folder_as_a_stream(spark, tmp_path):
    register(spark)
    path = tmp_path / "in"
    path.mkdir()
    put_frames(path / "part-0.seek.zst", cut(lines(20), 10))
    stream = spark.readStream.format("recframe").option("path", str(path)).load()
    q = stream.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert spark.table("tailed").count() == 20
        put_frames(path / "part-1.seek.zst", cut(lines(25, first=20), 10))  # its last frame may still change
        q.processAllAvailable()
        assert sorted(r["record_index"] for r in spark.table("tailed").collect()) == list(range(40))
    finally:
        q.stop()


def test_stream_into_a_folder(spark, tmp_path):
    from recframe.streaming.sink import to_folder

    source = tmp_path / "src"
    source.mkdir()
    spark.range(30).coalesce(1).write.mode("append").parquet(str(source))
    rows = spark.readStream.schema("id long").parquet(str(source)).select("id", F.concat(F.col("id").cast("string").cast("binary"), F.lit(b"\n")).alias("record"))
    for start in (30, 0):
        q = to_folder(rows, str(tmp_path / "out"), "id", records_per_frame=8).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        q.awaitTermination()
        if start:
            spark.range(30, 45).coalesce(1).write.mode("append").parquet(str(source))
    h = open_records(spark, str(tmp_path / "out"))
    assert got(h.scan()) == [b"%d\n" % i for i in range(45)]
