"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer text is worked on alone.
SLAB = 2 << 20

_byte = np.arange(256)
#: Bytes that are part of a word: all but blanks; letters, digits and non-ASCII.
NOT_BLANK = ~(((_byte >= 9) & (_byte <= 13)) | (_byte == 32))
WORDLIKE = (_byte >= 128) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122))
LOWERED = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)

_LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slabs(column: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, lengths) of consecutive rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, whole[ends[first]:ends[last]], np.diff(ends[first:last + 1])
        first = last


class Words:
    """The words of the texts of a slab.

    ``buffer`` holds the texts, one blank after each; ``starts`` and ``sizes``
    are the words' bytes there, ``doc`` the row of each word, ``bounds`` the
    first word of each row and the end.
    """

    def __init__(self, data: np.ndarray, lengths: np.ndarray, wordlike: np.ndarray = NOT_BLANK,
                 lowered: np.ndarray = LOWERED):
        rows = len(lengths)
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) + 1
        self.buffer = np.full(len(data) + rows + 17, 32, dtype=np.uint8)
        at = np.arange(len(data), dtype=np.int64) + np.repeat(
            np.arange(rows, dtype=np.int64) + 1, lengths)
        self.buffer[at] = lowered[data]
        inside = wordlike[self.buffer]
        change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.sizes = change[::2], change[1::2] - change[::2]
        self.bounds = np.searchsorted(self.starts, np.append(self.begin, len(self.buffer)))
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(rows), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lanes = (self.sizes + 7) // 8
        first = np.cumsum(lanes) - lanes
        number = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
        eight = np.lib.stride_tricks.sliding_window_view(self.buffer, 8)
        value = eight[np.repeat(self.starts, lanes) + 8 * number].view("<u8").ravel()
        left = np.minimum(np.repeat(self.sizes, lanes) - 8 * number, 8)
        value = mix((value & _LOW_BYTES[left]) + (number + 1).astype(np.uint64) * STEP)
        return mix(np.add.reduceat(value, first) + self.sizes.astype(np.uint64) * STEP)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row and hash.

    A row with fewer words than ``size``, but not none, has one shingle.
    """
    h, doc, bounds = words.hashes(), words.doc, words.bounds
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.repeat(bounds[1:], words.counts)
    start = np.arange(len(h))
    starts = start[(start + size <= ends)]
    value = np.zeros(len(starts), np.uint64)
    for i in range(size):
        value = mix(value * np.uint64(3) + h[starts + i] + STEP)
    rows = doc[starts]
    for row in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        own = np.zeros(1, np.uint64)
        for x in h[bounds[row]:bounds[row + 1]]:
            own = mix(own * np.uint64(3) + x + STEP)
        value, rows = np.append(value, mix(own + words.counts[row].astype(np.uint64))), np.append(rows, row)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    new = np.append(True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]))
    return rows[new], value[new]


#: Bytes as they are, for words whose case counts.
AS_IS = np.arange(256, dtype=np.uint8)


def joined_digests(words: Words, chosen: np.ndarray, counts: np.ndarray, piece: int = 1 << 18) -> list[str]:
    """The SHA-256 of each row's ``chosen`` words joined by one space.

    ``counts`` tells how many of ``chosen`` (numbers of words, in order) each row
    has. Bytes are laid out for ``piece`` words at once.
    """
    digests = [hashlib.sha256() for _ in counts]
    ends = np.cumsum(counts)
    for low in range(0, len(chosen), piece):
        some = chosen[low:low + piece]
        sizes = words.sizes[some] + 1
        stops = np.cumsum(sizes)
        out = words.buffer[np.arange(int(stops[-1])) + np.repeat(words.starts[some] - (stops - sizes), sizes)]
        out[stops - 1] = 32
        row = int(np.searchsorted(ends, low, side="right"))
        at, high = low, low + len(some)
        while at < high:
            until = min(int(ends[row]), high)
            begin = int(stops[at - low - 1]) if at > low else 0
            stop = int(stops[until - low - 1]) - (until == ends[row])  # none after the last word
            if until > at:
                digests[row].update(out[begin:stop])
            at = until
            row += 1
    return [d.hexdigest() for d in digests]
