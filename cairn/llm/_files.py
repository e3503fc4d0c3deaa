"""Byte-range reads and whole writes of files in the shared folder, from executors: local paths or any pyarrow file system."""

from __future__ import annotations

import functools
import uuid

from pyarrow import fs


@functools.lru_cache(maxsize=64)
def _system(base: str):
    return fs.FileSystem.from_uri(base)[0]


def _open(path: str):
    if "://" not in path:
        path = f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else path
    scheme, _, rest = path.partition("://")
    host = rest.partition("/")[0]
    system = _system(f"{scheme}://{host}/")
    return system, fs.FileSystem.from_uri(path)[1]


def write_file(path: str, data: bytes) -> None:
    """Appears whole under its name: written under another, then moved."""
    system, p = _open(path)
    system.create_dir(p.rpartition("/")[0], recursive=True)
    part = f"{p}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, p)


def read_range(path: str, offset: int, length: int) -> bytes:
    system, p = _open(path)
    with system.open_input_file(p) as f:
        return f.read_at(length, offset)


def size(path: str) -> int:
    system, p = _open(path)
    return system.get_file_info(p).size


def move_stream(part: str, path: str):
    """A generator: first an open stream to ``part``; when asked again, closes it and moves the file to ``path``."""
    system, p = _open(part)
    end = _open(path)[1]
    for name in (p, end):
        system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(p) as f:
        yield f
    system.move(p, end)


def exists(path: str) -> bool:
    system, p = _open(path)
    return system.get_file_info(p).type == fs.FileType.File


def remove(path: str) -> None:
    """Deletes a file, if it is there."""
    if exists(path):
        system, p = _open(path)
        system.delete_file(p)
