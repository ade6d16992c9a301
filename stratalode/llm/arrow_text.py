"""Words of Arrow string columns, cut by Arrow's own kernels: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once; a longer text is cut alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with SLICE_BYTES of text or one row each."""
    size = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with every byte replaced by the table's. Null is empty."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = memoryview(data)[int(at[0]) : int(at[-1])].tobytes().translate(table) if len(texts) and data else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(own))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between white space (a space, or one of \\t to \\r) in order, and how many each text has. Null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(full).as_py() and len(flat):
        flat, row = flat.filter(full), row.filter(full)
    return flat, np.bincount(row.to_numpy(zero_copy_only=False), minlength=len(texts)).astype(np.int64) if len(flat) else np.zeros(len(texts), np.int64)


def numbered(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the word of each number."""
    enc = flat.dictionary_encode()
    return enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary
