import struct

import numpy as np
import pytest
import zstandard

from recframe.errors import IncompleteFinal, NoRecords, NoSeparator, NotSeekable, PastEnd, RecordError
from recframe.functions.boundary import Fixed
from recframe.sources.container import FrameTable, decode_frame, encode_frame, has_checksum, read_seek_table, seek_table
from recframe.sources.layout import RecordFile, RecordFiles, expand, inner_format
from tests.model import cut, lines, put_frames


def test_round_trip_and_plain_zstd(tmp_path):
    frames = cut(lines(23), 5)
    path = put_frames(tmp_path / "a.jsonl.seek.zst", frames)
    table = read_seek_table(path)
    assert table.decompressed.tolist() == [len(f) for f in frames]
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(frames)


def test_table_with_checksums_is_parsed(tmp_path):
    raw = encode_frame(b"a\n")
    entry = struct.pack("<III", len(raw), 2, 7)
    (tmp_path / "x").write_bytes(raw + struct.pack("<II", 0x184D2A5E, len(entry) + 9) + entry + struct.pack("<IBI", 1, 0x80, 0x8F92EAB1))
    assert RecordFile(str(tmp_path / "x")).total == 1


@pytest.mark.parametrize("damage", [lambda b: b[:-1], lambda b: b[:5], lambda b: b"zz" + b, lambda b: b[:-9] + struct.pack("<IBI", 999, 0, 0x8F92EAB1)])
def test_files_that_arent_seekable(tmp_path, damage):
    path = tmp_path / "x"
    put_frames(path, [b"a\n"])
    path.write_bytes(damage(path.read_bytes()))
    with pytest.raises(NotSeekable):
        read_seek_table(str(path))
    with pytest.raises(RecordError):
        read_seek_table(str(tmp_path / "missing"))


def test_corruption_is_found():
    raw = bytearray(encode_frame(b"hello" * 100))
    raw[-1] ^= 255
    with pytest.raises(zstandard.ZstdError):
        decode_frame(bytes(raw), 500)
    with pytest.raises(RecordError):
        decode_frame(encode_frame(b"abc"), 4)


def test_checksum_flag(tmp_path):
    assert has_checksum(put_frames(tmp_path / "a", [b"a\n"]))
    assert not has_checksum(put_frames(tmp_path / "b", [b"a\n"], checksum=False))


def test_empty_frames_at_the_end_dont_count(tmp_path):
    f = RecordFile(put_frames(tmp_path / "a", [b"a\nb\n", b"c\n", b"", b""]))
    assert (f.frames, f.total) == (2, 3)


def test_boundary_that_ends_nothing(tmp_path):
    path = put_frames(tmp_path / "a", [b"abc"])
    with pytest.raises(NoRecords):
        RecordFile(path)
    with pytest.raises(NoRecords):
        RecordFile(put_frames(tmp_path / "b", [b""]))


def frames_of(tmp_path, whole, n, fragment, joined=False):
    frames = cut(lines(whole), n)
    if fragment and joined:
        frames[-1] += b"tail"
    elif fragment:
        frames.append(b"tail")
    return RecordFile(put_frames(tmp_path / "f", frames))


def test_edges_of_ranges(tmp_path):
    f = frames_of(tmp_path, 23, 5, False)  # 4 full frames and 3 records
    assert (f.span(20, 9).low, f.span(20, 9).high) == (20, 23)
    assert f.span(23, 1).low == f.span(23, 1).high == 23
    for start in (24, 25):
        with pytest.raises(NoSeparator if start < 25 else PastEnd):
            f.span(start, 0)
    assert f.span(0, 2**63).high == 23 and f.span(3, 0).high == 3
    full = frames_of(tmp_path, 20, 5, False)
    with pytest.raises(PastEnd):
        full.span(20, 1)
    tail = frames_of(tmp_path, 20, 5, True, joined=True)  # the last frame is full, a fragment follows in it
    assert (tail.total, tail.span(20, 1).high) == (21, 21)
    with pytest.raises(PastEnd):
        tail.span(21, 1)
    own = frames_of(tmp_path, 23, 5, True)
    assert own.frames == 6 or own.total == 24


def test_fragment_under_another_boundary(tmp_path):
    f = RecordFile(put_frames(tmp_path / "f", [b"aabb", b"ccd"]), Fixed(2))
    assert f.span(0, 3).high == 3
    for ask in ((0, 4), (0, None), (3, 1)):
        with pytest.raises(IncompleteFinal):
            f.span(*ask)
    with pytest.raises(IncompleteFinal):
        _ = f.total


def test_several_files_and_names(tmp_path):
    a, b = put_frames(tmp_path / "a.txt.seek.zst", cut(lines(7), 3)), put_frames(tmp_path / "b.txt.seek.zst", cut(lines(4), 2))
    files = RecordFiles([a, b])
    assert files.total == 11
    assert [(i, s.low, s.high) for i, _, s in files.spans(5, 4)] == [(0, 5, 7), (1, 0, 2)]
    with pytest.raises(PastEnd):
        files.spans(12, 1)
    assert expand(f"{tmp_path}/*.seek.zst") == [a, b] == expand(str(tmp_path))
    assert expand(f"{tmp_path}/none*") == [f"{tmp_path}/none*"]
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(RecordError):
        expand(f"{tmp_path}/*")
    assert [inner_format(x) for x in ("e.jsonl.seek.zst", "e.csv.seek.zst", "e.seek.zst", "e.ndjson.zst")] == ["json", "csv", "raw", "json"]


def test_layout_of_a_table():
    t = FrameTable(np.array([3, 4], np.uint32), np.array([5, 6], np.uint32))
    assert len(seek_table(t)) == 8 * 2 + 17
