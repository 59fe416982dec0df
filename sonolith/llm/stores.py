"""Numpy arrays as files of the shared folder: written by one task each, memory-mapped by all others.

A file of a folder that is mounted (``file://`` or no scheme) is mapped where it lies. From other stores it is fetched
through Arrow's file systems into an unnamed temporary file, which is mapped: nothing is left behind. A file is written
under another name and moved, so a task that runs again after a lost executor leaves the same file and no half of one.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a mounted file, None for other stores."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def put(uri: str, values: np.ndarray) -> None:
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.ascontiguousarray(values).tofile(out)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path))
    with store.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(values).data)


def mapped(uri: str, dtype) -> np.ndarray:
    """The array in a file, read page by page where it is looked at."""
    path = local_path(uri)
    if path is not None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with tempfile.TemporaryFile() as held, store.open_input_stream(path) as source:
        shutil.copyfileobj(source, held, 1 << 22)
        held.flush()
        return np.memmap(held, dtype, "r") if held.tell() else np.zeros(0, dtype)
