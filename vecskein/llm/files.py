"""Plain files in the shared folder, from driver or executors: local, HDFS or object store by their URI."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def make_dir(path: str) -> None:
    system, p = at(path)
    system.create_dir(p, recursive=True)


def write(path: str):
    system, p = at(path)
    return system.open_output_stream(p, compression=None)


def read(path: str):
    """A random-access file: size(), seek(), read()."""
    system, p = at(path)
    return system.open_input_file(p)


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    return f.read(length)
