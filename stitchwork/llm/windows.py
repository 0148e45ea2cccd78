"""Hashes of fixed-length byte windows and sampled suffixes of many texts, by numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW = 200
#: Bytes of a sampled suffix that its key covers; each window holds WINDOW - GRAM + 1 such grams and samples the one of least hash.
GRAM = 64
GRAMS = WINDOW - GRAM + 1
#: Window starts that are worked on at once, few enough for their hashes to stay in a core's cache; positions among them have
#: POSITION_BITS in a sampling key.
BLOCK, POSITION_BITS = 1 << 16, 17
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in their order."""
    h = (left * A) ^ (right + (left >> np.uint64(29))) * B
    return (h ^ (h >> np.uint64(32))) * C


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the hash of its first GRAM bytes, and of all its WINDOW bytes. The former go on to the last gram's start."""
    n = len(data) - 7
    h = np.empty(n, np.uint64)
    for i in range(8):  # the eight bytes from each place on
        h[i::8] = np.frombuffer(data, "<u8", (n - i + 7) // 8, i)
    for half in (8, 16, 32):
        h = joined(h[:-half], h[half:])
    grams = h
    h = joined(h[:-64], h[64:])  # 128 bytes
    return grams, joined(h[: -(WINDOW - 128)], h[WINDOW - 128 :])


def sampled(keys: np.ndarray) -> np.ndarray:
    """For each window start the place of its gram of least key, the first of equals."""
    order = (keys >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS)) | np.arange(len(keys), dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    if width < GRAMS:
        order = np.minimum(order[: -(GRAMS - width)], order[GRAMS - width :])
    return (order & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of the data that hold each window once, and where they begin."""
    for begin in range(0, len(data) - WINDOW + 1, BLOCK):
        yield begin, data[begin : begin + BLOCK + WINDOW - 1]


def suffixes(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The sampled suffixes of documents that begin at starts, one after another in data.

    For each: document (row), its first eight bytes (lead), key, context (hash of all bytes of the windows that sample it), place, and the first and last of these
    windows' starts, all in the document.
    """
    ends = np.append(starts[1:], len(data))
    out = {k: [] for k in ("row", "lead", "key", "context", "at", "low", "high")}
    for begin, piece in blocks(data):
        grams, whole = hashes(piece)
        at = sampled(grams)
        place = np.arange(len(at)) + begin
        # the documents of the block, each with its windows' places in it (empty documents have none)
        some = slice(np.searchsorted(ends, begin, side="right"), np.searchsorted(starts, begin + len(at)))
        n = np.minimum(ends[some], begin + len(at)) - np.maximum(starts[some], begin)
        row = np.repeat(np.arange(some.start, some.stop), n)
        inside = place <= np.repeat(ends[some] - WINDOW, n)
        head = inside.copy()
        head[1:] &= (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
        low = np.flatnonzero(head)
        tail = inside.copy()
        tail[:-1] &= head[1:] | ~inside[1:]
        high = np.flatnonzero(tail)
        context = joined(joined(whole[low], whole[high]), (high - low).astype(np.uint64))
        first = starts[row[low]] - begin
        # the first eight bytes as a signed number of the same order
        lead = np.zeros(len(low), np.uint64)
        for i in range(8):
            lead = lead << np.uint64(8) | piece[at[low] + i].astype(np.uint64)
        lead = (lead ^ np.uint64(1 << 63)).view(np.int64)
        for k, v in (("row", row[low]), ("lead", lead), ("key", grams[at[low]]), ("context", context), ("at", at[low] - first), ("low", low - first), ("high", high - first)):
            out[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in out.items()}
