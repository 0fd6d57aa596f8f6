"""What the tasks of a write send to the driver, and what a task of a backward read holds: neither may grow with the records."""

import io
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from recframe import catalogue
from recframe.functions.boundary import Custom, Fixed, LengthPrefixed, Separated
from recframe.operators.publish import add_file, replace
from recframe.operators.read import open_records
from recframe.operators.write import compress, cut_runs, write_file
from recframe.plans.framing import FrameCutter, Framing
from recframe.plans.indexing import size_cuts
from recframe.sources.layout import RecordFiles
from recframe.sources.records import plan, read_backwards, read_frames

from .model import put_frames


def results(spark):
    """Bytes of task results by stage."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return {(s.stageId(), s.attemptId()): s.resultSize() for s in (stages.apply(i) for i in range(stages.size()))}


def sent(spark, run):
    before = results(spark)
    run()
    return sum(size for stage, size in results(spark).items() if stage not in before)


def random_records(n, most, seed=1):
    pick = random.Random(seed)
    return [pick.randbytes(pick.randrange(most)) for _ in range(n)]


def frame(spark, records):
    return spark.createDataFrame(list(enumerate(records)), "record_index long, record binary").repartition(5)


@pytest.mark.parametrize("options", [{"records_per_frame": 64}, {"frame_size": 40000}, {"frame_size": 40000, "uniform": False}])
def test_records_and_frames_do_not_pass_through_the_driver(spark, tmp_path, options):
    records = [x.replace(b"\n", b" ") + b"\n" for x in random_records(4000, 2000)]
    df = frame(spark, records)
    df.cache().count()
    path = str(tmp_path / "a.seek.zst")
    assert sent(spark, lambda: write_file(df, path, **options)) < 400_000 < os.stat(path).st_size // 8
    rows = open_records(spark, path, index_mode="exact").scan().orderBy("record_index").collect()
    assert [bytes(r["record"]) for r in rows] == records


#: Queries whose files used to reach the driver frame by frame, the folder of tables that shows it, and a bound on what they send now.
QUERIES = {
    "wrong_boundary_disagrees": ("sf0.01", 300_000),
    "documents_sep_multi": ("sf0.01", 300_000),
    "custom_boundary": ("sf0.01", 300_000),
    "size_mode_frames": ("sf0.1", 600_000),
    "append_frame_counts": ("sf0.1", 600_000),
    "multi_file_scan": ("sf0.1", 600_000),
    "json_encode_lines": ("sf0.1", 600_000),
    "frame_checksums": ("sf0.1", 600_000),
    "locked_writer": ("sf0.1", 600_000),
    "truncate_logical": ("sf0.1", 600_000),
}


@pytest.mark.parametrize("name", QUERIES)
def test_query_sends_little(spark, name, monkeypatch):
    folder, most = QUERIES[name]
    folder = f"/root/testdata/{folder}"
    if not os.path.isdir(folder):
        pytest.skip("no test data here")
    monkeypatch.setattr(catalogue, "_made", {})
    assert sent(spark, lambda: catalogue.QUERIES[name][0](spark, folder).write.format("noop").mode("overwrite").save()) < most


@pytest.mark.parametrize("frame_size, block", [(1, 7), (50, 1), (50, 16), (300, 16), (4000, 16), (10**6, 16), (300, 1 << 20)])
def test_cuts_by_size_are_those_of_one_ordered_pass(spark, frame_size, block):
    pick = random.Random(frame_size * block)
    sizes = [pick.choice((0, 1, 1, 9, 30, 49, 50, 51, 400)) for _ in range(600)]
    cutter, counts = FrameCutter(Framing(frame_size=frame_size, uniform=False, limit_multiplier=1000)), []
    for n in sizes:
        counts += [c for _, c in cutter.add(b"x" * n)]
    cuts = size_cuts(frame(spark, [b"x" * n for n in sizes]), frame_size, block=block)
    assert cuts.tolist() == (np.cumsum(counts) - 1).tolist()


def test_size_mode_on_odd_tables(spark, tmp_path):
    path = str(tmp_path / "a.seek.zst")
    write_file(frame(spark, [b"a\n"]).where("false"), path, uniform=False)
    assert os.path.exists(path)
    gaps = spark.createDataFrame([(10 * i - 50, b"%03d\n" % i) for i in range(100)], "record_index long, record binary").repartition(3)
    write_file(gaps, path, force=True, frame_size=10, uniform=False)
    assert open_records(spark, path, index_mode="exact").cat(0, None) == b"".join(b"%03d\n" % i for i in range(100))
    assert [r["cnt_of_sep"] for r in open_records(spark, path).inspect(False).orderBy("frame").collect()] == [3] * 33 + [1]
    with pytest.raises(ValueError, match="above the limit"):
        write_file(frame(spark, [b"a\n", b"x" * 100 + b"\n"]), path, force=True, frame_size=10, uniform=False)


def test_a_file_is_added_whole_to_any_output(tmp_path):
    part, target, memory = tmp_path / "part", tmp_path / "target", io.BytesIO()
    part.write_bytes(bytes(range(256)) * 1000)

    def put(out):
        out.write(b"head")
        assert add_file(str(part), out) == add_file(f"file://{part}", out) == 256000
        out.write(b"tail")

    replace(str(target), put)
    put(memory)
    assert target.read_bytes() == memory.getvalue() == b"head" + part.read_bytes() * 2 + b"tail"


def paragraph(data):
    blank, end = data.find(b"\n\n"), data.find(b"\x00")
    if blank >= 0 and (end < 0 or blank < end):
        return blank + 2
    return end + 1 if end >= 0 else None


def test_runs_are_cut_where_they_are(spark, tmp_path):
    pick = random.Random(5)
    runs = [b"".join(pick.choice((b"a", b"b" * 300, b"\n", b"\n\n", b"\x00")) for _ in range(pick.randrange(40))) + b"\x00" for _ in range(300)]
    df = spark.createDataFrame([(i, run) for i, run in enumerate(runs)] + [(300, None), (301, b"")], "id long, record binary").repartition(5)
    cut = cut_runs(df, Custom(paragraph), "id")
    write_file(cut, str(tmp_path / "a.seek.zst"), "id", "at", boundary=Custom(paragraph), records_per_frame=7)
    (tmp_path / "b").write_bytes(b"".join(runs))
    compress(str(tmp_path / "b"), boundary=Custom(paragraph), records_per_frame=7)
    assert (tmp_path / "a.seek.zst").read_bytes() == (tmp_path / "b.seek.zst").read_bytes()


def test_cut_runs_on_odd_tables(spark):
    rows = spark.createDataFrame([("k", b"aabbcc")], "id string, record binary")
    assert [(r["id"], r["at"], bytes(r["record"])) for r in cut_runs(rows, Fixed(2), "id").collect()] == [("k", 0, b"aa"), ("k", 1, b"bb"), ("k", 2, b"cc")]
    assert cut_runs(rows.where("false"), Fixed(2), "id").collect() == []
    assert cut_runs(rows.selectExpr("cast(null as int) as id", "record"), Fixed(6), "id").collect()[0][:2] == (None, 0)
    for boundary in (Fixed(4), LengthPrefixed(), Separated(b"\n")):
        with pytest.raises(Exception, match="ends within"):
            cut_runs(rows, boundary).collect()


def test_custom_boundary_walks_no_file_on_the_driver(spark, monkeypatch):
    def walked(*_, **__):
        raise AssertionError("the driver walked all bytes")

    monkeypatch.setattr(catalogue, "_made", {})
    monkeypatch.setattr(catalogue, "compress", walked)
    monkeypatch.setattr(catalogue.Handle, "write_to", walked)
    rows = catalogue.custom_boundary(spark, "/root/testdata/sf0.001")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    parts = [[*(x.encode() + b"\n\n" for x in split[:-1]), split[-1].encode() + b"\x00"] for split in ((r["text"] or "").split("\n\n") for r in documents)]
    assert [r["bytes"] for r in rows.orderBy("record_index").collect()] == [len(x) for own in parts for x in own]


def parts_of(path, limit=1 << 30):
    return plan(RecordFiles([path], Separated(b"\n")), 0, None, {"partition_bytes": str(limit)})


def test_a_backward_read_holds_a_frame(tmp_path):
    path = put_frames(tmp_path / "a.seek.zst", [b"".join(b"%06d\n" % (1000 * i + k) for k in range(1000)) for i in range(200)])
    (part,) = parts_of(path)
    base, most, seen = pa.total_allocated_bytes(), 0, 200_000
    for batch in read_backwards(part):
        most = max(most, pa.total_allocated_bytes() - base)
        assert batch.column("record")[0].as_py() == b"%06d\n" % (seen - 1) and batch.column("record_index")[0].as_py() == seen - 1
        seen -= len(batch)
    assert seen == 0 and most < 2_000_000


def test_a_backward_read_is_the_forward_one_reversed(tmp_path, monkeypatch):
    path = put_frames(tmp_path / "a.seek.zst", [b"a\nb\nc\n", b"d\n", b"e\nf\ng\n", b"h\ni\nrest"])
    for reach in (1, 1 << 20):
        monkeypatch.setattr("recframe.sources.records.READ_BYTES", reach)
        for limit in (1, 8, 1 << 20):
            for part in parts_of(path, limit):
                forward = [r for b in read_frames(part) for r in b.to_pylist()]
                assert forward and [r for b in read_backwards(part) for r in b.to_pylist()] == forward[::-1]
