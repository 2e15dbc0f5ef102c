"""Words of whole Arrow columns as NumPy arrays: offsets, codes and the distinct words of a slice."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII character but digits and letters into a space.
ALNUM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def text_column(column: pa.Array) -> pa.Array:
    """As string, null as empty."""
    column = pc.fill_null(column, "")
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def translated(column: pa.Array, by: bytes) -> pa.Array:
    """The strings with their UTF-8 bytes mapped; the map must turn ASCII into ASCII and keep all other bytes."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    raw = memoryview(data)[int(ends[0]) : int(ends[-1])].tobytes().translate(by) if data is not None else b""
    return pa.StringArray.from_buffers(len(column), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(raw))


def listed(strings: pa.Array) -> list:
    """The strings (or bytes) as Python objects, many times faster than ``to_pylist``."""
    return strings.to_numpy(zero_copy_only=False).tolist()


@dataclass
class Words:
    """Row i has the words codes[offsets[i]:offsets[i + 1]] of vocabulary."""

    offsets: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split(lists: pa.ListArray) -> Words:
    """The non-empty strings of each list."""
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(coded.dictionary, "").as_py()
    offsets = np.concatenate(([0], np.cumsum(counts)))
    if empty >= 0:
        kept = codes != empty
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        codes = codes[kept]
    return Words(offsets.astype(np.int64), codes, coded.dictionary)


def words_of(column: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    return split(pc.ascii_split_whitespace(column))


def lines_of(column: pa.Array) -> pa.ListArray:
    return pc.split_pattern(column, "\n")


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
