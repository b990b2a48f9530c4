"""Byte files in the shared folder, from executors: written under a temporary name, then renamed."""

from __future__ import annotations

import uuid


def opened(uri: str):
    """File system and path of a URI; file:, hdfs:, s3: and others that Arrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri[len("file:/") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def temporary(path: str) -> str:
    return f"{path}.tmp-{uuid.uuid4().hex}"


def read(uri: str) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read()


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, start)
