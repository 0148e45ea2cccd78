"""op1: documents as matrices of token ids, packed best fit, longest first.

Documents are dealt by a hash of identifier and text into windows of WINDOW_CHARS characters on average, as many as the table's size asks
for, so that a window is a fair sample of the table and the number of sequences does not depend on how the input is split or sorted. A window's pieces
are placed longest first, each into the fullest sequence that still has room: a segment tree over amounts of room, whose nodes hold how
many sequences below them are open, finds it in as many steps as the tree is high. A document longer than a sequence is cut without loss,
into pieces of a whole sequence and a rest. Pieces of different windows never share a sequence; what that costs is measured in the README.

A row is a sequence: its ids as a row of a matrix (little-endian, unsigned, of 2 bytes where the vocabulary fits and else 4; filled up
with the pad id), the cumulative lengths of its segments from 0, position ids that begin at 0 again in each segment (2 or 4 bytes alike),
and which document and piece each segment is. Sequences of a partition are numbered on from its number times 2**32.

A null or empty text is a segment of the end id alone. Equal texts and repeated rows are packed like any others, very long texts are cut
as above; an empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import bpe, common, packing, words

#: Characters of a window, about, and the most tokens of which one is made if a very long text falls into it.
WINDOW_CHARS, WINDOW_TOKENS = 32_000_000, 32_000_000
PAD_ID = 0
SCHEMA = "sequence_id long, n_tokens int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, ids binary, position_ids binary"


class Rooms:
    """Open sequences by room left, in a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = self.leaves + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The fullest sequence with at least this room, and its room; it is no longer open."""
        node = self.leaves + least
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first subtree on the right that has any
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece, numbered from 0."""
    rooms, out, used = Rooms(capacity), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = rooms.take(n)
        if found is None:
            found, used = (capacity, used), used + 1
        out[i] = found[1]
        if found[0] > n:
            rooms.add(found[0] - n, found[1])
    return out


def matrices(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = packing.CAPACITY, window_chars: int = WINDOW_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    schema = SCHEMA.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype("<u2" if bpe.vocabulary(path).size <= 1 << 16 and capacity <= 1 << 16 else "<u4")
        number, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids = np.concatenate([h[0] for h in held])
            doc_ids = pa.chunked_array([h[1] for h in held]).combine_chunks()
            piece, length = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            begins = np.cumsum(length) - length
            sequence = best_fit(length, capacity)
            order = np.argsort(sequence, kind="stable")
            for rows in _runs(order, sequence[order]):
                n, own = length[rows], sequence[rows]
                heads = np.flatnonzero(np.append(True, np.diff(own) != 0))
                counts = np.diff(np.append(heads, len(rows)))
                ends = np.cumsum(n)
                total = np.add.reduceat(n, heads)
                offset = ends - n - np.repeat((ends - n)[heads], counts)
                matrix, positions = np.full((len(heads), capacity), PAD_ID, dtype), np.zeros((len(heads), capacity), dtype)
                to = words.ragged(np.repeat(np.arange(len(heads)), counts) * capacity + offset, n)
                matrix.reshape(-1)[to] = ids[words.ragged(begins[rows], n)]
                positions.reshape(-1)[to] = words.ragged(np.zeros(len(n), np.int64), n)
                bounds = pa.array(np.append(heads, len(rows)), pa.int32())
                cumulative = np.insert(offset + n, heads, 0)
                binary = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + own[heads]), pa.array(total, pa.int32()),
                        pa.ListArray.from_arrays(bounds, doc_ids.take(pa.array(rows))), pa.ListArray.from_arrays(bounds, pa.array(piece[rows], pa.int32())),
                        pa.ListArray.from_arrays(pa.array(np.append(heads, len(rows)) + np.arange(len(heads) + 1), pa.int32()), pa.array(cumulative, pa.int32())),
                        binary(matrix), binary(positions),
                    ],
                    ["sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "position_ids"],
                )
            number += int(sequence.max()) + 1

        for batch in batches:
            for rows in common.slices(batch, "text"):
                ids, row, piece, _, length = packing.token_pieces(common.texts(rows.column("text")), path, capacity)
                held.append((ids.astype(dtype), rows.column("doc_id").take(pa.array(row)), piece, length))
                tokens += len(ids)
                if tokens >= WINDOW_TOKENS:
                    yield from packed()
                    held, tokens = [], 0
        if held:
            yield from packed()

    named = common.renamed(docs, {"doc_id": id_col, "text": text_col})
    chars = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = named.repartition(max(1, math.ceil(chars / window_chars)), F.xxhash64("doc_id", "text"))
    return common.map_arrow(dealt, run, schema)


def _runs(order: np.ndarray, sequence: np.ndarray, most: int = 256) -> Iterator[np.ndarray]:
    """The pieces in the order of their sequences, so many sequences at a time."""
    for first in range(0, int(sequence[-1]) + 1, most):
        yield order[np.searchsorted(sequence, first) : np.searchsorted(sequence, first + most)]


def unpacked(rows: list, capacity: int = packing.CAPACITY) -> dict:
    """The ids of each document, put together again from rows of matrices()."""
    pieces: dict = {}
    for r in rows:
        dtype = "<u2" if len(r.ids) == 2 * capacity else "<u4"
        ids = np.frombuffer(r.ids, dtype)
        for doc, piece, begin, end in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces.setdefault(doc, {})[piece] = ids[begin:end]
    return {doc: np.concatenate([p[i] for i in range(len(p))]) for doc, p in pieces.items()}


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices(common.table(spark, sf_dir, "documents"))
