"""Files that workers write and read by URI, in whatever store holds the shared folder."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def new_file(folder: str, stem: str, suffix: str):
    """(uri, output stream) of a new file.

    Each attempt of a task writes its own name, and only the row that a task
    returns makes a file part of the result; what a lost attempt wrote is
    never read.
    """
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    return f"{folder}/{name}", store.open_output_stream(posixpath.join(path, name), compression=None)


def read_at(uri: str):
    store, path = opened(uri)
    return store.open_input_file(path)
