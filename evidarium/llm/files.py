"""Raw files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and path of a URI; Hadoop writes local ones as file:/path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: list[bytes]) -> None:
    """The file appears at once: a task that is run again replaces it by the same bytes."""
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(draft) as out:
        for p in parts:
            out.write(p)
    system.move(draft, path)


def read_at(uri: str, start: int, length: int) -> bytes:
    system, path = opened(uri)
    with system.open_input_file(path) as source:
        return source.read_at(length, start)
