"""Files read by range, in tasks: where a path's store can be opened by pyarrow, tasks read just the bytes they need."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system and the place of a single file in it; None if pyarrow can't reach it, so only Spark can read it."""
    try:
        if "://" in path or path.startswith("file:"):
            where, at = fs.FileSystem.from_uri(path)
        else:
            where, at = fs.LocalFileSystem(), path
        return (where, at) if where.get_file_info(at).type == fs.FileType.File else None
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return None


@contextmanager
def opened_range(path: str):
    """(file, its length); read_at(count, offset) reads a range."""
    where, at = located(path) or (None, None)
    if where is None:
        raise FileNotFoundError(path)
    with where.open_input_file(at) as f:
        yield f, f.size()


def can_range(path: str) -> bool:
    """Whether ranges of the file can be read, that is, whether it is there, reachable and not compressed as a whole."""
    if path == "-" or located(path) is None:
        return False
    with opened_range(path) as (f, _):
        return f.read_at(2, 0) != b"\x1f\x8b"
