"""Binary files in the shared folder, by any URI that pyarrow can open."""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def save(uri: str, *parts: bytes | np.ndarray) -> int:
    """Write all parts to ``uri`` in one step: a task that runs again replaces the file whole."""
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    n = 0
    with store.open_output_stream(tmp) as out:
        for p in parts:
            n += len(p) if isinstance(p, bytes) else p.nbytes
            out.write(p if isinstance(p, bytes) else memoryview(np.ascontiguousarray(p)).cast("B"))
    store.move(tmp, path)
    return n


def load(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """Bytes of ``uri`` from ``start`` on."""
    store, path = _at(uri)
    with store.open_input_file(path) as f:
        size = f.size()
        return f.read_at(max(0, min(size, start + length) - start) if length is not None else size - start, start)
