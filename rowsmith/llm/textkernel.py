"""Vectorised words and hashes over Arrow string buffers; what operators 1, 3, 4 and 5 read texts with.

A batch of texts is one byte buffer with offsets. Words are found with byte masks and hashed through prefix
sums of byte * BASE**position (mod 2**64), so the hash of any byte span costs O(1) and no Python object is made
per word. Texts go in pieces of a few times PIECE bytes; a longer text is a piece of its own, for which the arrays of
its words (about 50 bytes a word) are held at once, while its bytes are hashed PIECE by PIECE, inside long words too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone
PIECE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 2 * PIECE + 1
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse)]), dtype=np.uint64)
        return self.up, self.down


_powers = _Powers()


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word, in order; words don't cross texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)  # where a text begins; the end counts as one
    first[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word
    ends = ends.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return start, end, text


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order of start, and the bytes between are not read."""
    out = np.empty(len(start), dtype=np.uint64)
    long = np.flatnonzero(end - start > PIECE)
    i = 0
    with np.errstate(over="ignore"):
        for stop in [*long.tolist(), len(start)]:  # runs of words between the long ones
            while i < stop:
                lo = start[i]
                j = min(stop, max(i + 1, int(np.searchsorted(start, lo + PIECE, "left"))))
                hi = int(end[i:j].max())
                up, down = _powers.get(hi - lo + 1)
                sums = np.zeros(hi - lo + 1, dtype=np.uint64)
                np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
                s, e = start[i:j] - lo, end[i:j] - lo
                out[i:j] = _finish((sums[e] - sums[s]) * down[s], e - s)
                i = j
            if stop < len(start):
                out[stop] = _long(data[start[stop] : end[stop]])
                i = stop + 1
    return out


def _finish(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long(word: np.ndarray) -> np.uint64:
    """The hash of one long word, by PIECE bytes at a time."""
    total, scale, up = np.uint64(0), 1, _powers.get(PIECE)[0]
    for lo in range(0, len(word), PIECE):
        part = word[lo : lo + PIECE].astype(np.uint64) + np.uint64(1)
        total += np.add.reduce(part * up[: len(part)]) * np.uint64(scale)
        scale = scale * pow(int(BASE), PIECE, 1 << 64) % (1 << 64)
    return _finish(np.array([total]), np.array([len(word)]))[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word of one piece."""
    if lower:
        data = LOWER[data]
    start, end, text = spans(data, offsets)
    return hashes(data, start, end), text


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of `width` words; of a shorter text, its whole sequence as one."""
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE)
    with np.errstate(over="ignore"):
        scaled = word * factor[0]
        n = len(word)
        found, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n >= width:
            total = scaled[: n - width + 1].copy()
            for k in range(1, width):
                total += word[k : n - width + 1 + k] * factor[k]
            whole = text[: n - width + 1] == text[width - 1 :]
            found, at = mix(total[whole]), text[: n - width + 1][whole]
        count = np.bincount(text, minlength=n_texts)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.searchsorted(text, short)
            extra = np.array(
                [
                    np.add.reduce(word[f : f + c] * factor[:c]) + np.uint64(c) * np.uint64(0xA0761D6478BD642F)
                    for f, c in zip(first, count[short], strict=True)
                ],
                dtype=np.uint64,
            )
            found, at = np.concatenate([found, mix(extra)]), np.concatenate([at, short])
    return found, at


def distinct(found: np.ndarray, at: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct hashes, ascending."""
    order = np.lexsort((found, at))
    found, at = found[order], at[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (at[1:] != at[:-1])
    found, at = found[new], at[new]
    return found, np.searchsorted(at, np.arange(n_texts + 1))
