"""Byte files in the shared folder: written once by a task under a name of its own, read back by ranges."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark import TaskContext


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a folder or file, given as uri (file, hdfs, s3, ...) or absolute path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def attempt_name(kind: str) -> str:
    """A file name that no other task or attempt uses, so that a repeated task never meets its predecessor's file."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    return f"{kind}-{part:06d}-{uuid.uuid4().hex}"


class Output:
    """A sequential file that knows its position."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = system.open_output_stream(path), 0

    def write(self, data: bytes) -> int:
        """Append ``data``; the offset at which it starts."""
        start = self.at
        self.stream.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.stream.close()


class Ranges:
    """Range reads from a few files that stay open while a task needs them."""

    def __init__(self, most: int = 8):
        self.most, self.open = most, {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, path = resolve(uri)
            self.open[uri] = system.open_input_file(path)
        return self.open[uri].read_at(length, offset)
