import pytest

from recframe.errors import RecordError
from recframe.functions.boundary import Fixed
from recframe.operators.read import Handle
from recframe.operators.save import open_path, records_of_bytes, save
from tests.model import cut, lines, put_frames


def test_what_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k long, v string")
    path = str(tmp_path / "a.jsonl.seek.zst")
    save(df, path, "k", records_per_frame=1)
    for options in (dict(), dict(append=True, force=True), dict(force=True, records_per_frame=-1), dict(append=True, trust_records_per_frame=True), dict(force=True, trust_records_per_frame=True, records_per_frame=2), dict(append=True, insert_separator=True, boundary=Fixed(3)), dict(force=True, insert_separator=True)):
        with pytest.raises(RecordError):
            save(df, path, "k", **options)
    with pytest.raises(RecordError):
        save(df, str(tmp_path / "none.seek.zst"), "k", append=True, column="v")
    with pytest.raises(RecordError):
        save(df, str(tmp_path / "b.jsonl.seek.zst"))
    save(df, path, "k", append=True, records_per_frame=1)
    assert [r["value"] for r in Handle(spark, path).values(schema="k long, v string").select("value.v").toDF("value").collect()] == ["x", "x"]
    save(df, path, "k", force=True)
    assert open_path(spark, path).total() == 1 and open_path(spark, path).get(0) == {"k": 1, "v": "x"}


def test_paths_are_dispatched(spark, tmp_path):
    a = put_frames(tmp_path / "a.txt.seek.zst", cut(lines(7), 3))
    (tmp_path / "b.txt").write_text("x\ny\n")
    assert isinstance(open_path(spark, a), Handle) and open_path(spark, str(tmp_path / "b.txt")).count() == 2
    for bad in (dict(path=[a, str(tmp_path / "b.txt")]), dict(path=str(tmp_path / "b.txt"), verify=True), dict(path=str(tmp_path / "b.txt"), boundary=Fixed(2))):
        with pytest.raises(RecordError):
            open_path(spark, **bad)
    rows = records_of_bytes(spark.read.format("binaryFile").load(a)).orderBy("record_index").collect()
    assert [bytes(r["record"]) for r in rows] == lines(7)
    with pytest.raises(Exception, match="seekable"):
        records_of_bytes(spark.read.format("binaryFile").load(str(tmp_path / "b.txt"))).collect()
