"""Files of any store for Python code in tasks, through pyarrow's file systems."""

from __future__ import annotations

import io
from urllib.parse import urlsplit

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path there, what to put before a path of it so that it is named as Spark names it)."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        path = parts.path if parts.scheme else uri
        return fs.LocalFileSystem(), path.rstrip("/") or "/", "file:"
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/"), f"{parts.scheme}://" + ("" if parts.scheme in ("s3", "s3a", "gs", "abfs", "abfss") else parts.netloc)


class _Seekable(io.RawIOBase):
    """A file of any store as Python's zip reader wants it: a place before its begin is an OSError."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, place: int, whence: int = 0) -> int:
        place += 0 if whence == 0 else self.file.tell() if whence == 1 else self.file.size()
        if place < 0:
            raise OSError("before the begin of the file")
        self.file.seek(place)
        return place

    def readinto(self, into) -> int:
        data = self.file.read(len(into))
        into[: len(data)] = data
        return len(data)


def seekable(file) -> io.BufferedReader:
    return io.BufferedReader(_Seekable(file), 16 << 10)
