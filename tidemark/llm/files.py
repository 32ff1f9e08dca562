"""Files that tasks write and read by URI, through pyarrow's file systems (local, HDFS, S3, GCS)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, stem: str, data: bytes) -> str:
    """Writes data under a name of its own and returns the name; a repeated task writes another file, and only
    names that reach a committed table are ever read."""
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(data)
    return name


def read_range(folder: str, name: str, offset: int, length: int) -> bytes:
    system, base = opened(folder)
    with system.open_input_file(f"{base}/{name}") as source:
        return source.read_at(length, offset)


def read_file(folder: str, name: str) -> bytes:
    system, base = opened(folder)
    with system.open_input_stream(f"{base}/{name}") as source:
        return source.read()
