"""Opening files by byte ranges: paths of a shared file system, or any URI that Arrow's file systems know."""

from __future__ import annotations

from typing import BinaryIO


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def open_file(path: str) -> BinaryIO:
    """A seekable file of bytes."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow.fs import FileSystem

        system, inner = FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(local(path), "rb")


def size_of(path: str) -> int:
    with open_file(path) as f:
        return f.seek(0, 2)
