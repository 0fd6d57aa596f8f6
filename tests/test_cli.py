import io
import json

import pytest

from recframe.cli import run
from recframe.errors import RecordError
from recframe.sources.layout import RecordFile
from tests.model import cut, lines, put_frames


def call(*argv, stdin=b""):
    out = io.BytesIO()
    run([str(a) for a in argv], io.BytesIO(stdin), out)
    return out.getvalue()


def test_all_commands(tmp_path):
    source, path = tmp_path / "in.txt", tmp_path / "in.txt.seek.zst"
    source.write_bytes(b"".join(lines(500)))
    call("compress", source, "-c", 20)
    assert call("cat", path, "-f", 33, "-c", 12) == b"".join(lines(45)[33:]) and call("cat", path) == lines(1)[0]
    rows = json.loads(call("inspect", path, "-f", "json"))
    assert [r["cnt_of_sep"] for r in rows] == [20] * 25 and call("inspect", path, "-f", "xml") == b""
    assert call("inspect", path, "-n").count(b"\n") == 25
    call("truncate", path, "-r", 100)
    call("append", path, stdin=b"".join(lines(10, first=100)))
    assert RecordFile(str(path)).total == 110
    call("copy-range", path, tmp_path / "part", "-f", 40, "-c", 20)
    assert call("copy-range", path, "-", "-f", 40, "-c", 20) == (tmp_path / "part").read_bytes()
    call("truncate", path, "-r", 60)
    call("append", path, tmp_path / "part", "--input-seekable", "--input-from", 0, "--input-cnt", 20, "--check-input-frames")
    assert call("cat", path, "-f", 0, "-c", 1000) == b"".join(lines(60) + lines(60)[40:])
    call("convert", "-", tmp_path / "p.seek.zst", "--finder", "fixed", "--finder-arg", 4, "--frame-size", 64, stdin=b"abcd" * 100)
    assert call("cat", tmp_path / "p.seek.zst", "--finder", "fixed", "--finder-arg", 4, "-f", 99) == b"abcd"
    call("compress", source, tmp_path / "r", "--rm")
    assert not source.exists()


@pytest.mark.parametrize("argv", [["compress", "-"], ["append", "X", "-", "--input-seekable"], ["append", "X", "--input-from", "3"], ["append", "X", "X", "--input-seekable", "--insert-separator"], ["cat", "X", "--separator", "a", "--finder", "msgpack"], ["cat", "X", "-f", "999"]])
def test_what_is_refused(tmp_path, argv):
    path = put_frames(tmp_path / "x", cut(lines(30), 10))
    with pytest.raises(RecordError):
        call(*[path if a == "X" else a for a in argv])
