"""Files in the shared folder, from executors: mounted paths directly, other stores by pyarrow."""

from __future__ import annotations

import os
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


@contextmanager
def written(uri: str):
    """A binary file that appears under its name only when whole."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as out:
            yield out
            out.flush()
            os.fsync(out.fileno())
        os.replace(f"{path}.part", path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(f"{path}.part") as out:
        yield out
    store.move(f"{path}.part", path)


@contextmanager
def opened(uri: str):
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as found:
            yield found
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as found:
        yield found
