"""Splitting many texts at once: character classes from a table, boundaries by numpy, equal words met once."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

#: The classes, and Unicode's White_Space characters.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What a contraction has after its apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def distinct(points: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct ones, in UTF-8, of the pieces that begin at starts, and for each piece which it is."""
    data = points.tobytes().decode("utf-32-le").encode()
    if len(data) > len(points):
        ends = np.empty(len(points) + 1, np.int64)
        ends[0] = 0
        np.cumsum(1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8), out=ends[1:])
        starts = ends[starts]
    offsets = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for the next ones."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def word_starts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the pattern 's|'t|'re|'ve|'m|'ll|'d|letters|number|others begin, and which characters are no white space."""
    kind = classes()[points]
    solid = kind != SPACE
    start = np.empty(len(points), bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= kind == NUMBER
    start &= solid
    at = np.flatnonzero(points == 39)
    at = at[start[at]] if len(at) else at
    if len(at):
        ahead = lambda k: np.where(at + k < len(points), points[np.minimum(at + k, len(points) - 1)], 0)
        one, two = ahead(1), ahead(2)
        length = np.where(np.isin(one, [ord(c) for c in SHORT]), 1, 0)
        for pair in LONG:
            length[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        at, length = at[length > 0], length[length > 0]
        start[at + 1] = False
        after = at + 1 + length
        after = after[after < len(points)]
        start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start), solid
