"""Files by path or address, read and written by byte ranges inside tasks."""

from __future__ import annotations

import fnmatch
import posixpath
import re
from collections.abc import Iterable

from pyarrow import fs as pafs


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address (a plain path is local), and the path in it."""
    if re.match(r"file:/{1,3}", path):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    return pafs.LocalFileSystem(), path


def listed(paths: Iterable[str], suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(address, size) of files: those named, those of a folder with one of the endings, those that a pattern with * or ? matches."""
    out: dict[str, int] = {}
    for given in paths:
        store, path = store_of(given)
        before = given[: len(given) - len(path)] if given.endswith(path) else given[: given.find("://") + 3] if "://" in given else ""
        pattern = posixpath.basename(path) if re.search(r"[*?\[]", path) else None
        top = posixpath.dirname(path) if pattern else path.rstrip("/") or "/"
        info = store.get_file_info(top)
        if info.type == pafs.FileType.File:
            found = [info]
        elif info.type == pafs.FileType.Directory:
            found = [f for f in store.get_file_info(pafs.FileSelector(top, recursive=pattern is None)) if f.type == pafs.FileType.File]
            found = [f for f in found if fnmatch.fnmatch(f.base_name, pattern or "*") and (pattern or f.base_name.lower().endswith(suffixes)) and not f.base_name.startswith((".", "_"))]
        else:
            raise FileNotFoundError(given)
        out |= {before + f.path: f.size for f in found}
    return sorted(out.items())


class Ranges:
    """Random access to one file; counts the bytes that it has read."""

    def __init__(self, path: str):
        store, at = store_of(path)
        self._file = store.open_input_file(at)
        self.size, self.bytes_read = self._file.size(), 0

    def __call__(self, at: int, n: int) -> bytes:
        data = self._file.read_at(max(0, min(n, self.size - at)), at) if at < self.size else b""
        self.bytes_read += len(data)
        return data

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self._file.close()
