"""python -m recframe compress | cat | inspect | truncate | append | copy-range"""

from __future__ import annotations

import argparse
import json
import logging
import os
import shutil
import sys
import tempfile
from contextlib import nullcontext

from recframe.errors import RecordError, SpecError
from recframe.functions.boundary import Boundary, resolve
from recframe.operators import edit, write
from recframe.sources.layout import RecordFile


def _boundary(a: argparse.Namespace) -> Boundary:
    return resolve(a.separator, a.finder, a.finder_arg)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recframe", description=__doc__)
    kinds = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str) -> argparse.ArgumentParser:
        c = kinds.add_parser(name, aliases=aliases)
        c.add_argument("--finder")
        c.add_argument("--finder-arg")
        c.add_argument("--separator")
        return c

    c = command("compress", "convert")
    c.add_argument("input", nargs="?", default="-")
    c.add_argument("output", nargs="?")
    c.add_argument("--frame-size", type=int, default=131072)
    c.add_argument("-l", "--limit-multiplier", type=int, default=4)
    c.add_argument("-c", "--cnt-of-separator-per-frame", type=int)
    c.add_argument("--rm", action="store_true")
    c.add_argument("-k", "--keep-cnt-of-separators-in-frame", action="store_true", default=True)
    c.add_argument("--no-check", action="store_true")
    c.add_argument("--level", type=int, default=3)
    c = command("cat")
    c.add_argument("file")
    c.add_argument("-f", "--from", dest="start", type=int, default=0)
    c.add_argument("-c", "--cnt", type=int, default=1)
    c = command("inspect")
    c.add_argument("file")
    c.add_argument("-f", "--format", default="text")
    c.add_argument("-n", "--no-fast-mode", action="store_true")
    c = command("truncate")
    c.add_argument("file")
    c.add_argument("-r", "--records", type=int, required=True)
    c.add_argument("--copy", action="store_true", help="always so here")
    c = command("append")
    c.add_argument("file")
    c.add_argument("input", nargs="?", default="-")
    c.add_argument("--copy", action="store_true", help="always so here")
    c.add_argument("--insert-separator", action="store_true")
    c.add_argument("--records-per-frame", type=int)
    c.add_argument("--trust-records-per-frame", action="store_true")
    c.add_argument("--input-seekable", action="store_true")
    c.add_argument("--input-from", type=int)
    c.add_argument("--input-cnt", type=int)
    c.add_argument("--check-input-frames", action="store_true")
    c.add_argument("--level", type=int, default=3)
    c = command("copy-range")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-f", "--from", dest="start", type=int, default=0)
    c.add_argument("-c", "--cnt", type=int)
    c.add_argument("--no-align", action="store_true")
    c.add_argument("--check-uniform", action="store_true")
    return p


def layout(file: RecordFile, fast: bool) -> list[dict]:
    """The frame table without a session."""
    c, d = file.table.starts(file.table.compressed), file.table.starts(file.table.decompressed)
    count = lambda i: file.per_frame if fast and 0 < i < file.frames - 2 else file.boundary.count(file.frame_bytes(i))
    return [{"comp_start": int(c[i]), "comp_end": int(c[i + 1]), "comp_size": int(c[i + 1] - c[i]), "decomp_start": int(d[i]), "decomp_end": int(d[i + 1]), "decomp_size": int(d[i + 1] - d[i]), "cnt_of_sep": count(i)} for i in range(file.frames)]


def cat(file: RecordFile, start: int, count: int | None, out) -> None:
    span = file.span(start, count)
    for i in range(span.first, span.end):
        data, base = file.frame_bytes(i), i * file.per_frame
        ends = [0, *file.boundary.ends(data).tolist()]
        if i == file.frames - 1 and ends[-1] < len(data):
            ends.append(len(data))
        lo, hi = max(span.low - base, 0), min(span.high - base, len(ends) - 1)
        out.write(data[ends[lo] : ends[hi]] if lo < hi else b"")


def run(argv: list[str] | None = None, stdin=None, stdout=None) -> None:
    a = parser().parse_args(argv)
    stdin, stdout = stdin or sys.stdin.buffer, stdout or sys.stdout.buffer
    boundary = _boundary(a)
    if a.command in ("compress", "convert"):
        framing = {"frame_size": a.frame_size, "limit_multiplier": a.limit_multiplier, "records_per_frame": a.cnt_of_separator_per_frame, "checksum": not a.no_check, "level": a.level}
        if a.input == "-":
            if not a.output:
                raise SpecError("input from a pipe needs the name of an output")
            with tempfile.NamedTemporaryFile() as spool:
                shutil.copyfileobj(stdin, spool)
                spool.flush()
                write.compress(spool.name, a.output, boundary, **framing)
        else:
            write.compress(a.input, a.output, boundary, a.rm, **framing)
    elif a.command == "cat":
        cat(RecordFile(a.file, boundary), a.start, a.cnt, stdout)
    elif a.command == "inspect":
        rows = layout(RecordFile(a.file, boundary), not a.no_fast_mode)
        if a.format == "json":
            stdout.write(json.dumps(rows).encode() + b"\n")
        elif a.format == "text":
            stdout.write("".join(f"{i}: {r}\n" for i, r in enumerate(rows)).encode())
    elif a.command == "truncate":
        edit.truncate(a.file, a.records, boundary)
    elif a.command == "append":
        frames = a.input_from, a.input_cnt, a.check_input_frames or None
        if a.input_seekable:
            if a.insert_separator or a.records_per_frame or a.trust_records_per_frame:
                raise SpecError("options for records can't go with --input-seekable")
            if a.input == "-":
                raise SpecError("frames can't come from a pipe")
            edit.append_frames(a.file, a.input, a.input_from or 0, a.input_cnt, boundary, a.check_input_frames)
        else:
            if any(x is not None for x in frames):
                raise SpecError("--input-from, --input-cnt and --check-input-frames need --input-seekable")
            with nullcontext(stdin) if a.input == "-" else open(a.input, "rb") as data:
                edit.append_records(a.file, data, boundary, a.insert_separator, a.level, a.records_per_frame, a.trust_records_per_frame)
    else:
        if a.output == "-":
            with tempfile.TemporaryDirectory() as d:
                edit.copy_range(a.input, f"{d}/out", a.start, a.cnt, boundary, not a.no_align, a.check_uniform)
                with open(f"{d}/out", "rb") as f:
                    shutil.copyfileobj(f, stdout)
        else:
            edit.copy_range(a.input, a.output, a.start, a.cnt, boundary, not a.no_align, a.check_uniform)


def main() -> int:
    """Messages go to stderr, at the level that RECFRAME_LOG names (INFO where it is unset)."""
    logging.basicConfig(stream=sys.stderr, level=os.environ.get("RECFRAME_LOG", "INFO").upper(), format="%(levelname)s %(name)s: %(message)s")
    try:
        run()
    except (RecordError, OSError) as e:
        print(f"recframe: {e}", file=sys.stderr)
        return 1
    return 0
