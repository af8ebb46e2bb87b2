"""Vectorised text kernels over Arrow string batches, shared by the operators of this package.

Everything here works on whole texts. A batch is handled in slices of about a megabyte, cut
between documents, so memory follows the longest document and not the batch.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: Bytes of a word for the class [^\x20\x09-\x0D].
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    codes[65:91] = codes[97:123]  # A-Z count as a-z
    return codes


BYTE_CODE = _byte_codes()
#: Multipliers of the places in a shingle.
PLACE = mix(np.arange(1001, 1033, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), np.uint64(0x5851F42D4C957F2D))
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each, one row at least."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(rows, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """The words of some documents: ``hash`` of each word, and ``first`` with the word range of each document."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, word_bytes: np.ndarray = NOT_SPACE):
        inside = word_bytes[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[full] = inside[full]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.data, self._inside = data, inside

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes, the same for A-Z and a-z."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        if most is not None:
            length = np.minimum(length, most)
            inside = np.repeat(self.start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(int(length.sum()))
            return self._hashed(BYTE_CODE[self.data[inside]], length)
        return self._hashed(BYTE_CODE[self.data[self._inside]], length)

    @staticmethod
    def _hashed(code: np.ndarray, length: np.ndarray) -> np.ndarray:
        begin = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(len(code)) - np.repeat(begin, length)
        return mix(np.add.reduceat(code * powers(int(length.max()))[place], begin) + length.astype(np.uint64))


def word_batches(column: pa.Array, word_bytes: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) for each slice of a string column."""
    offsets, data = utf8(column)
    for a, b in slices(offsets):
        yield a, b, Words(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], word_bytes)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one document; of the whole when it has fewer words; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    w = min(k, len(words))
    total = np.zeros(len(words) - w + 1, np.uint64)
    for j in range(w):
        total += words[j : len(words) - w + 1 + j] * PLACE[j]
    return mix(total + np.uint64(w))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h = words.hashes()
    if len(h) >= k:
        rolled = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            rolled += h[j : len(h) - k + 1 + j] * PLACE[j]
        rolled = mix(rolled + np.uint64(k))
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        else:
            yield shingle_hashes(h[a:b], k)


def rows(batch_columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch from columns given as numpy arrays, lists or Arrow arrays."""
    made = []
    for field in schema:
        value = batch_columns[field.name]
        made.append(value.cast(field.type) if isinstance(value, pa.Array) else pa.array(value, type=field.type))
    return pa.RecordBatch.from_arrays(made, schema=schema)
