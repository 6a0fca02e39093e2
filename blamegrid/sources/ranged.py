"""Files that tasks open themselves: a first line costs kilobytes, a digest a chunk of memory, whatever a file's length.

Tasks can open what pyarrow can (local and mounted folders, HDFS, S3, GCS, Azure). For any other store ``opens``
is false, and callers take Spark's own readers.
"""

from __future__ import annotations

import csv
import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs

HEAD, CHUNK = 16 << 10, 4 << 20
_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path there, of a path as Spark names it (not percent-encoded)."""
    scheme = _SCHEME.match(path)
    if not scheme:
        return fs.LocalFileSystem(), path
    if scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", path[len("file:") :])
    return fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@?=&"))


def opens(path: str) -> bool:
    """Whether tasks can open the store of ``path``; its globs don't matter."""
    try:
        _store(re.split(r"[*?\[{]", path)[0])
    except (pa.ArrowException, ValueError, OSError):
        return False
    return True


def open_file(path: str) -> BinaryIO:
    store, at = _store(path)
    return store.open_input_file(at)


def first_line(stream: BinaryIO, size: int = HEAD) -> str | None:
    """The first line that isn't blank, without byte order mark; reads on only until that line ends. None if there is none."""
    held = b""
    while True:
        more = stream.read(size)
        held += more
        lines = re.split(rb"[\r\n]+", held)
        for line in lines[: None if not more else -1]:  # the last one may go on
            line = line.removeprefix(b"\xef\xbb\xbf").decode(errors="replace")
            if line.strip():
                return line
        if not more:
            return None
        held = lines[-1]


def cells(line: str) -> list[str]:
    """A header's names: quotes removed, white space trimmed."""
    return [name.strip() for name in next(csv.reader([line], skipinitialspace=True))]


def digest(stream: BinaryIO, size: int = CHUNK) -> str:
    found = hashlib.sha256()
    while chunk := stream.read(size):
        found.update(chunk)
    return found.hexdigest()


def read_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, names) for batches of paths; files without a line that isn't blank give no row."""
    for batch in batches:
        paths, names = [], []
        for path in batch.column("path").to_pylist():
            with open_file(path) as stream:
                line = first_line(stream)
            if line is not None:
                paths.append(path)
                names.append(cells(line))
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "names": pa.array(names, pa.list_(pa.string()))})


def read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, length, sha256) for batches of path and length."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with open_file(path) as stream:
                found.append(digest(stream))
        yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "length": batch.column("length"), "sha256": pa.array(found, pa.string())})
