"""Arrays that tasks write to the shared folder and workers map into memory.

A file is raw little-endian numbers; its name begins with their type. A writing task uses a name of its own, and only the names that
successful tasks return are read, so a task that is run again does no harm. On a file system that
the machines mount, workers map the shared file itself. From any other, a worker fetches the file
once, maps the copy and removes its name at once, so that nothing stays behind.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyarrow import fs


#: Hadoop's names of a store that Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder as Spark names it, and its path there."""
    scheme, colon, rest = folder.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")


def save(folder: str, values: np.ndarray) -> str:
    """Write an array of unsigned numbers below the folder and return its name."""
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    name = f"u{values.itemsize}-{uuid.uuid4().hex}"
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(np.ascontiguousarray(values).tobytes())
    return name


def smallest(values: np.ndarray) -> np.ndarray:
    """The numbers in 32 bits, if they fit."""
    return values.astype("<u4" if not len(values) or values.max() < 1 << 32 else "<u8")


def mapped(folder: str, name: str) -> np.ndarray:
    """The array of a name, paged in from its file as it is used."""
    system, base = opened(folder)
    path, kind = f"{base}/{name}", f"<{name.split('-')[0]}"
    if system.get_file_info(path).size == 0:
        return np.zeros(0, dtype=kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(path) as source:
        while block := source.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.memmap(copy.name, dtype=kind, mode="r")
