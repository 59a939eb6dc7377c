"""Files for the chunks of a table: a chunk is what one task of its scan reads.

A table that is scanned again is split the same way, so what was gathered elsewhere for a chunk waits for its next
scan in a file on shared storage, and the texts need no shuffle.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext

from tallyhouse.llm.shared import file_system


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets) of a string or binary column; a null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset :][: len(column) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def groups_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.nonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))[0]


class Folder:
    """Arrays in files on shared storage; a file appears whole or not at all."""

    def __init__(self, uri: str):
        self.fs, self.root = file_system(uri)

    def save(self, name: str, **arrays: np.ndarray) -> None:
        out = io.BytesIO()
        np.savez(out, **arrays)
        self.fs.create_dir(self.root)
        part = f"{self.root}/{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part, compression=None) as f:
            f.write(out.getvalue())
        self.fs.move(part, f"{self.root}/{name}")

    def load(self, name: str) -> dict[str, np.ndarray] | None:
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_file(path) as f:
            return dict(np.load(io.BytesIO(f.read())))


def chunk_number() -> int:
    return TaskContext.get().partitionId()
