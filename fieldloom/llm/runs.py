"""Runs of bytes of a class (words, terms) in columns of texts, found in Arrow's buffers for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together, about: it bounds the memory of a worker; a longer text is taken alone and whole.
TOGETHER = 1 << 21


def byte_class(inside) -> np.ndarray:
    """A table of the 256 bytes: True for those of which runs are made."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes of words: all but the ASCII space characters.
WORDS = byte_class(lambda b: b != 0x20 and not 9 <= b <= 13)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of TOGETHER bytes of text in column number `text`, about; one row at least."""
    for batch in batches:
        column = batch.column(text)
        sizes = np.diff(offsets(column))
        begin = 0
        while begin < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), TOGETHER, "right")))
            yield batch.slice(begin, n)
            begin += n
    pa.default_memory_pool().release_unused()  # a worker stays for later stages


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the column's bytes, and where the last one ends."""
    kind = "i8" if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else "i4"
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype("i8") if len(texts) else np.zeros(1, "i8")


def runs(texts: pa.Array, inside: np.ndarray, change: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All maximal runs of `inside` bytes, in order, as one binary array (bytes mapped by `change` if given), and the number of runs of each text. Texts have no nulls."""
    at = offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]] if len(texts) else np.zeros(0, "u1")
    at = at - at[0]
    member = inside[data]
    first = member.copy()
    first[1:] &= ~member[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = member[heads]  # a run never reaches into the next text
    kept = data[member]
    starts = np.flatnonzero(first[member])
    begun = np.concatenate([[0], np.cumsum(first)])
    bounds = np.append(starts, len(kept)).astype("i4")
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(change[kept] if change is not None else kept)])
    return found, np.diff(begun[at])
