"""Files that executors write to and read from the shared folder, by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, suffix: str):
    """A new file with a name of its own, open for writing, and its URI. An attempt that fails leaves a file that no table names."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None), uri  # else the suffix decides


def open_file(uri: str):
    """A file with random access."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)
