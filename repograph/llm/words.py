"""Words of whole texts as numpy arrays: positions, 64-bit hashes and window hashes.

A word is a maximal run of characters other than space and U+0009..U+000D. Hashes are sums of
`value * BASE**position` modulo 2**64, so the hash of any stretch is a difference of two prefix
sums; they are finished with a bijective mixer. Texts are worked on in slices of a few megabytes,
so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = b" \t\n\v\f\r"
SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROW = _U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * (0 if have is None else len(have)))
        have = np.full(size, base, _U)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """One longer than the values; feed it to `stretch_hashes`."""
    out = np.empty(len(values) + 1, _U)
    out[0] = 0
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = _power(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + _U(1) * (ends - starts).astype(_U))


class Slice:
    """Some consecutive rows: their bytes, and where rows and words begin and end."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows = len(offsets) - 1
        inside = ~IS_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.inside = inside
        self.starts = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        # Words of row r are word_offsets[r] .. word_offsets[r + 1].
        self.word_offsets = np.searchsorted(self.starts, offsets)

    def word_hashes(self) -> np.ndarray:
        return stretch_hashes(prefix_sums(_BYTE[self.data]), self.starts, self.ends)

    def word_rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.word_offsets))

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each row are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, table: np.ndarray | None = None
           ) -> Iterator[Slice]:
    """Slices of at most `limit` bytes, or of one longer text; null texts count as empty.

    With `table`, every byte is first replaced by its entry there.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        part = data[bounds[at]:bounds[to]]
        yield Slice(at, part if table is None else table[part], bounds[at:to + 1] - bounds[at])
        at = to


def windows(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of every window of `size` words that lies within one row."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts
    starts = np.arange(len(rows)) - begins[rows] + offsets[:-1][rows]
    return starts, rows


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, size: int):
    """Hash, first word and row of every window."""
    starts, rows = windows(offsets, size)
    return stretch_hashes(prefix_sums(hashes), starts, starts + size), starts, rows


def in_row(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Keys that differ between rows, so that equal keys of one row can be counted together."""
    return mix(keys + rows.astype(_U) * _ROW)
