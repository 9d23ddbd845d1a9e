"""Hash the words of whole texts, straight from Arrow buffers.

A word is a run of bytes between separators; A-Z count as a-z. Work is cut
into pieces of a few megabytes, so memory does not follow the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 22  # bytes hashed at once
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: xor-shift and multiply, twice."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x9E3779B97F4A7C15)
    h = h ^ (h >> _U(29))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _byte_table(breaks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[breaks] = True
    values = mix(np.arange(1, 257, dtype=_U))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    values[space] = 0
    return space, values


#: Words end at white space.
BLANKS = _byte_table([0x20, *range(0x09, 0x0E)])
#: Words end at every ASCII character that is no letter or digit.
MARKS = _byte_table([b for b in range(128) if not chr(b).isalnum()])
_powers = np.ones(1, _U)


def _power_table(size: int) -> np.ndarray:
    global _powers
    if len(_powers) < size:
        steps = np.full(max(size, 2 * len(_powers), 1024), 0xC2B2AE3D27D4EB4F, _U)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _hash_piece(data: np.ndarray, cuts: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of ``data``, and how many words lie before each of ``cuts``."""
    space, codes = table
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(cuts), np.int64)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = codes[data[starts[0] :]] * _power_table(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    return hashes, np.searchsorted(starts, cuts)


def _row_blocks(offsets: np.ndarray):
    """Runs of rows of about one piece; a longer row makes a run of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


def _long_row(data: np.ndarray, table) -> np.ndarray:
    space = table[0]
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not space[data[end]]:
            gap = np.flatnonzero(space[data[end : end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(data))
        parts.append(_hash_piece(data[at:end], np.zeros(0, np.int64), table)[0])
        at = end
    return np.concatenate(parts)


def hashed_words(column: pa.Array, table=BLANKS):
    """Yield ``(first row, word hashes, word offsets)`` for runs of rows of ``column``."""
    data, offsets = string_buffers(column)
    for start, end in _row_blocks(offsets):
        low, high = offsets[start], offsets[end]
        if end == start + 1 and high - low > PIECE:
            hashes = _long_row(data[low:high], table)
            yield start, hashes, np.array([0, len(hashes)])
        else:
            cuts = offsets[start : end + 1] - low
            yield start, *_hash_piece(data[low:high], cuts, table)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by the position of its first word."""
    count = max(0, len(words) - size + 1)
    total = np.zeros(count, _U)
    for i in range(size):
        total += words[i : i + count] * _power_table(size + 1)[size - i]
    return mix(total + _U(size))


def shingle_sets(column: pa.Array, size: int):
    """Yield the sorted distinct shingle hashes of each row of ``column``.

    With fewer words than ``size`` the whole sequence is one shingle; without words the
    set is empty.
    """
    for _, words, cuts in hashed_words(column):
        grams = shingle_hashes(words, size)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if high - low >= size:
                yield np.unique(grams[low : high - size + 1])
            elif high > low:
                yield shingle_hashes(words[low:high], high - low)
            else:
                yield np.zeros(0, _U)
