"""Vectorised work on the bytes and code points of many texts at once: cutting batches, hashing and comparing spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    up, down = _powers[0][:n], _powers[1][:n]
    if len(_powers[0]) > 4 * SLICE_BYTES:
        _powers.clear()
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit hash over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of `units`, of its content only."""
    up, down = powers(len(units) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(units) + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
    return mix(h)


def word_hash(word: str) -> int:
    """The hash that span_hashes() gives the code points of `word`."""
    units = np.array([ord(c) for c in word], np.uint32)
    return int(span_hashes(units, np.array([0]), np.array([len(units)]))[0])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) of each pair."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each pair of spans of equal length whether their contents are equal."""
    if not len(lengths):
        return np.zeros(0, bool)
    differs = a[ranges(a_starts, lengths)] != b[ranges(b_starts, lengths)]
    counts = np.concatenate([[0], np.cumsum(differs)])
    ends = np.cumsum(lengths)
    return counts[ends] == counts[ends - lengths]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into slices of up to `most` bytes: first row, row after the last, bytes, row offsets in them.

    A null counts as an empty text.
    """
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        upto = min(upto, n)
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes with row offsets: the code points, the byte offset of each (and the end), the row offsets in code points."""
    firsts = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.append(firsts, len(data)), np.searchsorted(firsts, offsets)
