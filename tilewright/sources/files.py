"""File access shared by the data sources: local paths, or any URI that Arrow knows."""

from __future__ import annotations

import fnmatch
import glob
import os
import posixpath
from collections.abc import Iterator

from pyarrow import fs


def _split(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def expand(pattern: str) -> list[str]:
    """Sorted paths of a glob; remote globs may use wildcards in the last segment."""
    filesystem, path = _split(pattern)
    if isinstance(filesystem, fs.LocalFileSystem):
        return sorted(glob.glob(path))
    folder, name = posixpath.split(path)
    base = pattern[: len(pattern) - len(name)]  # keeps scheme and authority
    found = (posixpath.basename(i.path) for i in filesystem.get_file_info(fs.FileSelector(folder)))
    return sorted(base + n for n in found if fnmatch.fnmatch(n, name) and not n.startswith("."))


def entries(folder: str) -> Iterator[tuple[str, bool, int, float]]:
    """(path, is a folder, bytes, time) of what lies in a folder; hidden names are left out, as Spark does."""
    filesystem, path = _split(folder)
    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(path) as found:  # one at a time, however many there are
            for e in found:
                if not e.name.startswith((".", "_")):
                    at = e.stat()
                    yield f"file:{e.path}", e.is_dir(), at.st_size, at.st_mtime
        return
    base = folder.rstrip("/")
    for i in filesystem.get_file_info(fs.FileSelector(path)):
        if not i.base_name.startswith((".", "_")):
            yield f"{base}/{i.base_name}", i.type == fs.FileType.Directory, i.size or 0, (i.mtime_ns or 0) / 1e9


def open_file(path: str):
    """A seekable binary file."""
    filesystem, p = _split(path)
    return filesystem.open_input_file(p)


def size_of(path: str) -> int | None:
    """Bytes of a file, None if it is missing."""
    filesystem, p = _split(path)
    return filesystem.get_file_info(p).size


def open_output(path: str):
    filesystem, p = _split(path)
    return filesystem.open_output_stream(p)


def move(source: str, target: str) -> None:
    filesystem, p = _split(source)
    filesystem.move(p, _split(target)[1])


def remove(path: str) -> None:
    """Delete a file; one that is missing does no harm."""
    filesystem, p = _split(path)
    if filesystem.get_file_info(p).type != fs.FileType.NotFound:
        filesystem.delete_file(p)


def make_dirs(path: str) -> None:
    filesystem, p = _split(path)
    filesystem.create_dir(p, recursive=True)


def publish(path: str, data: bytes, attempt: int) -> None:
    """Write next to the target, then move: a retried task replaces its own file."""
    filesystem, p = _split(path)
    tmp = f"{p}.tmp-{attempt}"
    with filesystem.open_output_stream(tmp) as out:
        out.write(data)
    filesystem.move(tmp, p)
