"""Binary files in the folder that driver and executors share, through pyarrow's file systems.

A file is written under a name of its own and renamed when complete, so a repeated task puts the same file in place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w[\w+.-]+:", uri) else (pafs.LocalFileSystem(), uri)


def write_file(folder: str, name: str, put: Callable) -> None:
    """put(stream) writes the content."""
    fs, path = place(folder)
    fs.create_dir(path, recursive=True)
    own = f"{path}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        put(out)
    fs.move(own, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    fs, path = place(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()
