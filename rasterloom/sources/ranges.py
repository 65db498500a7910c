"""Files read by ranges of bytes, from any store that pyarrow's file systems reach (local, HDFS, object stores)."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

from pyarrow import fs

#: Bytes that are fetched at least, so that the small reads of a header share one request.
LEAST = 4096
#: Ranges that lie no further apart than this are fetched together.
GAP = 16384
#: Bytes that are fetched at a time of an archive whose members are read one after the other.
AHEAD = 1 << 20


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; file:/x and a plain path mean the local one."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def listed(uri: str, glob: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files at or below a path whose names match the glob, by name; hidden ones are left out."""
    system, root = resolve(uri)
    head = uri[: len(uri) - len(root)] if uri.endswith(root) else uri.split("://", 1)[0] + "://"
    there = system.get_file_info(root)
    if there.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [there] if there.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and fnmatch.fnmatch(f.base_name, glob))


class RangeFile:
    """One file; `bytes_read` counts what was fetched."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        self._file = system.open_input_file(path)
        self.size, self.bytes_read = self._file.size(), 0
        self._from, self._held = 0, b""

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._file.close()

    def read_at(self, offset: int, size: int) -> bytes:
        """The bytes from offset on, fewer at the end of the file."""
        if not self._from <= offset <= offset + size <= self._from + len(self._held):
            self._from = offset
            self._held = self._file.read_at(max(0, min(max(size, LEAST), self.size - offset)), offset)
            self.bytes_read += len(self._held)
        return self._held[offset - self._from :][:size]

    def read_many(self, spans: list[tuple[int, int]]) -> list[bytes]:
        """The bytes of each (offset, size); spans that lie close together are fetched as one range."""
        found: list[bytes] = [b""] * len(spans)
        order = sorted((k for k in range(len(spans)) if spans[k][1]), key=lambda k: spans[k])
        at = 0
        while at < len(order):
            first, end, stop = spans[order[at]][0], sum(spans[order[at]]), at + 1
            while stop < len(order) and spans[order[stop]][0] <= end + GAP:
                end, stop = max(end, sum(spans[order[stop]])), stop + 1
            data = self._file.read_at(max(0, min(end, self.size) - first), first)
            self.bytes_read += len(data)
            for k in order[at:stop]:
                offset, size = spans[k]
                found[k] = data[offset - first :][:size]
            at = stop
        return found


class Held:
    """A file whose bytes are in memory, with the same reads."""

    def __init__(self, content: bytes):
        self.content, self.size = content, len(content)

    def read_at(self, offset: int, size: int) -> bytes:
        return self.content[offset : offset + size]

    def read_many(self, spans: list[tuple[int, int]]) -> list[bytes]:
        return [self.content[offset : offset + size] for offset, size in spans]


class Member:
    """A member of an archive, unpacked as far as it is read."""

    def __init__(self, file: zipfile.ZipExtFile, size: int):
        self._file, self._held, self.size = file, b"", size

    def read_at(self, offset: int, size: int) -> bytes:
        if offset + size > len(self._held):
            self._held += self._file.read(max(offset + size - len(self._held), LEAST))
        return self._held[offset : offset + size]

    def read_many(self, spans: list[tuple[int, int]]) -> list[bytes]:
        return [self.read_at(offset, size) for offset, size in spans]


def members(uri: str) -> Iterator[tuple[str, Member]]:
    """(path, file) of a ZIP archive's members in their order; a path is the archive's with the member's name after it.

    A file can be read until the next one is asked for.
    """
    system, path = resolve(uri)
    with system.open_input_file(path) as file, zipfile.ZipFile(io.BufferedReader(file, AHEAD)) as archive:
        for info in archive.infolist():
            with archive.open(info) as content:
                yield f"{uri}/{info.filename}", Member(content, info.file_size)
