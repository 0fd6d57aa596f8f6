"""Replacing a file whole: a lock, a private copy, a rename. On a local disk the copy shares the old file's blocks where it can."""

from __future__ import annotations

import io
import logging
import os
import re
import shutil
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import BinaryIO, TypeVar

from pyarrow import fs

from recframe.errors import Locked, Refused
from recframe.sources.container import filesystem

T = TypeVar("T")
log = logging.getLogger("recframe")
#: Bytes that are copied at a time.
PIECE = 8 << 20
#: The Linux request that lets a file share another's blocks.
FICLONE = 0x40049409


def is_local(path: str) -> bool:
    return path.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path)


def local(path: str) -> str:
    """The plain name of a path on a local disk; any other store is refused rather than taken for a folder."""
    if not is_local(path):
        raise Refused(f"{path} isn't on a local disk")
    return re.sub(r"^file:(//)?(?=/)", "", path)


def exists(path: str) -> bool:
    store, name = filesystem(path)
    return store.get_file_info(name).type != fs.FileType.NotFound


def pieces(path: str, start: int, size: int) -> Iterator[bytes]:
    """The bytes [start, start + size) of a file, some megabytes at a time."""
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        while size > 0 and (data := f.read(min(PIECE, size))):
            size -= len(data)
            yield data


@contextmanager
def lock(path: str):
    """Cooperative: a file beside it that only one writer can create. Links are refused, as a rename would part them."""
    path = local(path)
    if os.path.islink(path):
        raise Refused(f"{path} is a symbolic link: name its target")
    if os.path.exists(path) and os.stat(path).st_nlink > 1:
        raise Refused(f"{path} has other hard links, which would keep the old content")
    held = os.path.join(os.path.dirname(path), f".lock.{os.path.basename(path)}")
    try:
        os.close(os.open(held, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600))
    except FileExistsError:
        raise Locked(f"{held} exists: another writer holds {path}, or ended without removing it") from None
    try:
        yield
    finally:
        os.unlink(held)


def _share(old: int, new: int) -> bool:
    """Let the new file share the old one's blocks; False where the disk can't."""
    try:
        import fcntl

        fcntl.ioctl(new, FICLONE, old)
        return True
    except (ImportError, OSError):
        return False


def _keep(old: BinaryIO, out: BinaryIO, size: int) -> None:
    """The first `size` bytes of old in out: shared, else copied within the kernel, else by reading."""
    if _share(old.fileno(), out.fileno()):
        out.truncate(size)
        out.seek(size)
        return
    done = 0
    try:
        while done < size and (n := os.copy_file_range(old.fileno(), out.fileno(), size - done)):
            done += n
    except (AttributeError, OSError):
        pass
    old.seek(done)
    out.seek(done)
    while done < size and (data := old.read(min(PIECE, size - done))):
        out.write(data)
        done += len(data)


def add_file(path: str, out: BinaryIO) -> int:
    """Another file's bytes after those of out; how many they are. Copied within the kernel where both are local files, else some megabytes at a time."""
    done = 0
    if is_local(path) and isinstance(out, io.BufferedRandom):
        out.flush()
        at = out.tell()
        try:
            with open(local(path), "rb") as f:
                while n := os.copy_file_range(f.fileno(), out.fileno(), 1 << 30, done, at + done):
                    done += n
        except (AttributeError, OSError):
            pass
        out.seek(at + done)
    for data in pieces(path, done, 1 << 62):
        out.write(data)
        done += len(data)
    return done


def replace(path: str, change: Callable[[BinaryIO], T], keep: int | None = None) -> T:
    """Write a private file that starts with the first `keep` bytes of the present one (None: with nothing) and goes on with what change writes, and rename it into place.

    On any error the file stays as it was. On a store that isn't a local disk the kept bytes are streamed, writers don't exclude
    each other, and the rename is the store's own move.
    """
    if not is_local(path):
        return _replace_elsewhere(path, change, keep)
    path = local(path)
    with lock(path):
        draft = os.path.join(os.path.dirname(path), f".tmp.{os.path.basename(path)}")
        try:
            new = os.open(draft, os.O_CREAT | os.O_EXCL | os.O_RDWR, 0o600)
        except FileExistsError:
            raise Locked(f"{draft} exists: an earlier writer ended without removing it") from None
        try:
            with os.fdopen(new, "w+b") as out:
                if keep:
                    with open(path, "rb") as old:
                        _keep(old, out, keep)
                if os.path.exists(path):
                    shutil.copystat(path, draft)
                    stat = os.stat(path)
                    if (stat.st_uid, stat.st_gid) != (os.geteuid(), os.getegid()):
                        os.chown(draft, stat.st_uid, stat.st_gid)
                else:
                    os.chmod(draft, 0o644)
                result = change(out)
                out.flush()
                os.fsync(out.fileno())
            os.replace(draft, path)
            log.info("%s written, %d bytes", path, os.stat(path).st_size)
            return result
        except BaseException:
            if os.path.exists(draft):
                os.unlink(draft)
            raise


def _replace_elsewhere(path: str, change: Callable[[BinaryIO], T], keep: int | None) -> T:
    store, name = filesystem(path)
    folder, _, base = name.rpartition("/")
    draft = f"{folder}/.tmp.{base}" if folder else f".tmp.{base}"
    try:
        with store.open_output_stream(draft, compression=None) as out:
            for data in pieces(path, 0, keep) if keep else ():
                out.write(data)
            result = change(out)
        if isinstance(store, fs.HadoopFileSystem) and store.get_file_info(name).type != fs.FileType.NotFound:
            store.delete_file(name)  # its move doesn't replace
        store.move(draft, name)
        return result
    except BaseException:
        if store.get_file_info(draft).type != fs.FileType.NotFound:
            store.delete_file(draft)
        raise
