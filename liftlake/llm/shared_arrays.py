"""Numpy arrays as files of the shared folder: written once by a task, memory-mapped by every worker."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(folder: str) -> str | None:
    """Path of a folder that the file system of every machine shows, else None."""
    u = urlparse(folder)
    return unquote(u.path) if u.scheme in ("", "file") else None


def write(folder: str, name: str, array: np.ndarray) -> None:
    """Write under a name of the attempt's own and rename, so a repeated task leaves one whole file."""
    array = np.ascontiguousarray(array)
    attempt = f".{name}.{uuid.uuid4().hex}"
    if (path := _local(folder)) is not None:
        os.makedirs(path, exist_ok=True)
        array.tofile(os.path.join(path, attempt))
        os.replace(os.path.join(path, attempt), os.path.join(path, name))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{attempt}") as out:
        out.write(array.tobytes())
    store.move(f"{path}/{attempt}", f"{path}/{name}")


_copies: dict[str, tempfile.TemporaryDirectory] = {}


def mapped(folder: str, name: str, dtype) -> np.ndarray:
    """The array, mapped read-only. From a store without local paths a worker maps a copy that it deletes at its end."""
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(folder)
        copies = _copies.setdefault(folder, tempfile.TemporaryDirectory())
        path = copies.name
        if not os.path.exists(os.path.join(path, name)):
            with store.open_input_stream(f"{there}/{name}") as source, open(os.path.join(path, name), "wb") as target:
                while block := source.read(1 << 24):
                    target.write(block)
    path = os.path.join(path, name)
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
