"""Plain files in shared folders, for tasks that write or read them themselves."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"file://{uri}")


class Output:
    """A file that appears under its name only when it is complete.

    Every attempt of a task writes a file of its own, so attempts that were
    lost or run twice don't meet; what counts is the name the task returns.
    """

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.system, base = _resolve(folder)
        self.system.create_dir(base, recursive=True)
        self.path = f"{base}/{self.name}"
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self.stream = self.system.open_output_stream(f"{self.path}.part", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(f"{self.path}.part", self.path)


def open_stream(uri: str):
    """A sequential reader of a file."""
    system, path = _resolve(uri)
    return system.open_input_stream(path, compression=None)


def read_range(uri: str, start: int, size: int) -> bytes:
    """``size`` bytes of a file from ``start`` on."""
    system, path = _resolve(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)


def read_all(uri: str) -> bytes:
    with open_stream(uri) as f:
        return f.read()


def drop(folder: str) -> None:
    """Remove a folder and all it holds, if it is there."""
    system, path = _resolve(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
