"""Files of any store that Arrow can open, by URI (``file:``, ``s3:``, ``gs:``, ``hdfs:``, ``abfs:`` ...) or by plain path: sizes, and ranges of bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyarrow import fs

#: Stores for further URI schemes: ``SCHEMES["scheme"] = make(uri) -> (file system, path)``. The readers' tasks need them, too.
SCHEMES: dict[str, object] = {}


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI and the path in it; what has no scheme is a local path."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if scheme and scheme[1] in SCHEMES:
        return SCHEMES[scheme[1]](uri)
    if scheme is None:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if scheme[1] == "file":
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def sizes(uris: list[str]) -> list[int | None]:
    """Sizes in bytes, None for what isn't a file. Files of one store are asked for together."""
    found: list[int | None] = [None] * len(uris)
    stores: dict[str, list[int]] = {}
    for i, uri in enumerate(uris):
        stores.setdefault(re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?", uri)[0], []).append(i)
    for some in stores.values():
        places = [locate(uris[i]) for i in some]
        for i, info in zip(some, places[0][0].get_file_info([path for _, path in places]), strict=True):
            found[i] = info.size if info.type == fs.FileType.File else None
    return found


class Joined:
    """Several files seen as one run of bytes. Files are opened when a range first touches them."""

    def __init__(self, uris: list[str], file_sizes: list[int]):
        self.uris, self.sizes, self._open = uris, file_sizes, {}

    def pieces(self, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
        """(file, offset, length) of a range's parts."""
        base = 0
        for i, size in enumerate(self.sizes):
            a, b = max(begin - base, 0), min(end - base, size)
            if a < b:
                yield i, a, b - a
            base += size

    def read(self, begin: int, end: int) -> bytes:
        parts = []
        for i, offset, length in self.pieces(begin, end):
            if i not in self._open:
                store, path = locate(self.uris[i])
                self._open[i] = store.open_input_file(path)
            part = self._open[i].read_at(length, offset)
            if len(part) != length:
                raise OSError(f"{self.uris[i]} ends before byte {offset + length}")
            parts.append(part)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def close(self) -> None:
        for f in self._open.values():
            f.close()
        self._open.clear()
