"""Files in the shared folder, written whole or not at all from executors, and read by position."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a local path or of a URI (file, hdfs, s3, gs)."""
    if m := re.match(r"file:/*(/.*)", path):
        path = m[1]
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Whole:
    """A file that appears under its name once it is complete. A second attempt at the same task replaces it by the same bytes."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temporary, self.path)
        except OSError:  # some stores don't replace
            if self.fs.get_file_info(self.path).type == fs.FileType.NotFound:
                raise
            self.fs.delete_file(self.temporary)


def span(path: str, start: int, end: int) -> bytes:
    held, at = opened(path)
    with held.open_input_file(at) as f:
        f.seek(start)
        return f.read(end - start)


def size(path: str) -> int:
    held, at = opened(path)
    return held.get_file_info(at).size
