"""op5: token counts by finite-state transducers, without making the tokens.

Two deterministic machines in a row. The first cuts a text into the words of the byte-level pattern: 12 states over 12 kinds of
characters, each transition annotated with the word boundaries it emits (before this character, or, one late, before the last one).
Texts of a batch are one stream in chunks of equal size; each chunk is run from all states at once, which gives its map from entry to
exit state; the maps compose by a parallel prefix scan, and with every chunk's entry state known, all chunks emit at once.

The second machine reads a word's bytes and is annotated with counts: a transition says by how many the number of tokens of the word so
far changes. A state is the longest suffix that can still grow into a token, with the last token and relative count at each place where
such a token could begin. The token that ends a prefix is the one suffix of it that stands beside the last token before it without any
merge across the two. States are compiled when a text first needs them. Each word starts anew, so that its map is a constant, and the
counts compose by prefix sums over the words.

The counting machine has more states than a map from all of them could hold, so that a single very long word is run through from its
beginning; only the splitter's chunks are composed. Null texts count as empty, with 0 bytes and 0 tokens, an empty table gives no rows. Strings of special tokens inside a text are one token each, as is the library's
default. Equal texts each have their row. Other columns are left out.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from stitchwork.llm import bpe, common, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
CHUNK = 256
#: Characters of a chunk after which it is looked whether all entry states have met; most chunks go on from one state.
MEET = 8
#: Words kept with their counts, and transitions kept, from one batch to the next.
CACHED_WORDS, CACHED_EDGES = 500_000, 500_000
#: Bytes of a word after which the bound on transitions is looked at again.
STRETCH = 4096

# kinds of characters
STMD, R, E, V, L, LETTER, NUMBER, BLANK, WHITE, QUOTE, OTHER, END = range(12)
# states: what the character before was part of
FRESH, LETTERS, NUMBERS, OTHERS, ONE_BLANK, RUN_BLANK, ONE_WHITE, RUN_WHITE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
HERE, LATE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emitted boundaries, by 12 * state + kind."""
    following, emits = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)
    letters = (STMD, R, E, V, L, LETTER)
    begin = dict.fromkeys(letters, LETTERS) | {NUMBER: NUMBERS, BLANK: ONE_BLANK, WHITE: ONE_WHITE, QUOTE: QUOTED, OTHER: OTHERS, END: FRESH}
    for kind, state in begin.items():
        following[:, kind], emits[:, kind] = state, HERE

    def on(state: int, kinds: tuple[int, ...], to: int, emit: int = 0) -> None:
        for kind in kinds:
            following[state, kind], emits[state, kind] = to, emit

    on(LETTERS, letters, LETTERS)
    on(NUMBERS, (NUMBER,), NUMBERS)
    on(OTHERS, (OTHER, QUOTE), OTHERS)
    for state in (ONE_BLANK, RUN_BLANK, ONE_WHITE, RUN_WHITE):
        on(state, (BLANK,), RUN_BLANK)
        on(state, (WHITE,), RUN_WHITE)
    for state, emit in ((ONE_BLANK, 0), (RUN_BLANK, LATE)):  # one blank goes with what follows it
        on(state, letters, LETTERS, emit)
        on(state, (NUMBER,), NUMBERS, emit)
        on(state, (OTHER, QUOTE), OTHERS, emit)
    for kind in (*letters, NUMBER, QUOTE, OTHER):
        emits[RUN_WHITE, kind] = HERE | LATE
    on(QUOTED, (STMD,), FRESH)
    on(QUOTED, (R,), QUOTED_R)
    on(QUOTED, (V,), QUOTED_V)
    on(QUOTED, (L,), QUOTED_L)
    on(QUOTED, (OTHER, QUOTE), OTHERS)
    for state, last in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        emits[state] |= LATE  # no contraction after all: the letter began a word
        on(state, letters, LETTERS, LATE)
        on(state, (last,), FRESH)
    return following.reshape(-1), emits.reshape(-1)


@functools.cache
def kinds() -> np.ndarray:
    out = np.array([OTHER, LETTER, NUMBER, WHITE], np.uint8)[words.classes()]
    for kind, letters in ((STMD, "stmd"), (R, "r"), (E, "e"), (V, "v"), (L, "l"), (BLANK, " "), (QUOTE, "'")):
        out[[ord(c) for c in letters]] = kind
    return out


def run_all(columns: np.ndarray, states: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The states after these columns of characters; the last axis of states goes along the chunks."""
    for column in columns:
        states = following.take(states * 12 + column)
    return states


def entry_states(columns: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The state that each chunk begins in. columns: characters of all chunks by place in the chunk; the first chunk begins FRESH."""
    n = columns.shape[1]
    maps = run_all(columns[:MEET], np.repeat(np.arange(12)[:, None], n, axis=1), following)
    met = (maps == maps[0]).all(axis=0)
    maps[:, met] = run_all(columns[MEET:, met], maps[0, met], following)
    maps[:, ~met] = run_all(columns[MEET:, ~met], maps[:, ~met], following)
    # scan: maps[:, i] becomes the composition of the maps of chunks 0..i
    step = 1
    while step < n:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].copy(), axis=0)
        step *= 2
    return np.append(FRESH, maps[FRESH, :-1])


def boundaries(stream: np.ndarray) -> np.ndarray:
    """For a stream of kinds whether a word begins at each character."""
    following, emits = splitter()
    following = following.astype(np.int64)
    n = len(stream)
    columns = np.ascontiguousarray(np.concatenate([stream, np.full(-n % CHUNK, END, np.uint8)]).reshape(-1, CHUNK).T)
    state = entry_states(columns, following)
    out = np.empty(columns.shape, np.uint8)
    for j, column in enumerate(columns):
        at = state * 12 + column
        out[j] = emits.take(at)
        state = following.take(at)
    out = out.T.reshape(-1)[:n]
    begins = (out & HERE).astype(bool)
    begins[:-1] |= out[1:] & LATE != 0
    return begins


class CountingBpe:
    """The machine over a word's bytes, compiled as far as words have needed it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        to_byte = {c: b for b, c in enumerate(bpe.byte_letters())}
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        pairs = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in file["model"]["merges"]]
        self.rank = {pair: r for r, pair in reversed([*enumerate(pairs)])}
        self.parts = {a + b: (a, b) for a, b in reversed(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        self.prefixes = {t[:i] for t in self.tokens for i in range(len(t))}
        self.special = [t["content"] for t in file["added_tokens"]]
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.forget()

    def forget(self) -> None:
        self.counts: dict[bytes, int] = {}
        self.forget_states()

    def forget_states(self) -> None:
        self.stands: dict[tuple[bytes, bytes], bool] = {}
        #: state: its suffix, and for each place in it where a token may begin, from the end back, the last token that ends there (none
        #: where the word begins) and the count of tokens up to there
        self.states: list[tuple[bytes, tuple[tuple[bytes | None, int], ...]]] = []
        self.numbers: dict = {}
        self.edges: dict[int, tuple[int, int]] = {}
        self.shapes: dict[bytes, tuple] = {}
        self.number((b"", ((None, 0),)))

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
        return found

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The symbols that stand at one end of the token while it is merged, each with the rank of the merge that takes it up."""
        if (token, side) not in self.spines:
            out, taken = [], float("inf")
            while True:
                out.append((token, taken))
                if len(token) == 1:
                    break
                taken = self.rank[self.parts[token]]
                token = self.parts[token][side]
            self.spines[out[0][0], side] = out
            return out
        return self.spines[token, side]

    def stand(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens side by side stay two: no merge across happens before its sides are taken up, the left one first."""
        found = self.stands.get((left, right))
        if found is None:
            found = self.stands[left, right] = self.apart(left, right)
        return found

    def apart(self, left: bytes, right: bytes) -> bool:
        for a, a_taken in self.spine(left, 1):
            for b, b_taken in self.spine(right, 0):
                r = self.rank.get((a, b))
                if r is not None and r < a_taken and r <= b_taken:
                    return False
        return True

    def places(self, suffix: bytes) -> list[int]:
        """How far back from its end a token may begin that goes on beyond it."""
        return [n for n in range(len(suffix) + 1) if suffix[len(suffix) - n :] in self.prefixes]

    def shape(self, suffix: bytes, byte: int) -> tuple:
        """Of all states with this suffix, on this byte: the tokens that may end here and the places they begin at, longest first; the new
        suffix; and the places that stay."""
        grown = suffix + bytes([byte])
        was = {n: i for i, n in enumerate(self.places(suffix))}
        ends = [(grown[-n:], was[n - 1]) for n in range(len(grown), 0, -1) if grown[-n:] in self.tokens]
        stay = self.places(grown)
        found = self.shapes[grown] = (ends, grown[len(grown) - stay[-1] :], [was[n - 1] for n in stay[1:]])
        return found

    def edge(self, state: int, byte: int) -> tuple[int, int]:
        suffix, places = self.states[state]
        ends, new_suffix, stay = self.shapes.get(suffix + bytes([byte])) or self.shape(suffix, byte)
        for token, i in ends:
            before, count = places[i]
            if before is None or self.stand(before, token):
                break
        change = count + 1
        new = ((token, 0), *((places[i][0], places[i][1] - change) for i in stay))
        found = self.edges[state << 8 | byte] = (self.number((new_suffix, new)), change)
        return found

    def count(self, word: bytes) -> int:
        """The tokens of a word. However long it is, states and transitions stay bounded: beyond the bound the machine goes on with the
        state that it is in as its only one."""
        state, total = 0, 0
        for begin in range(0, len(word), STRETCH):
            if len(self.edges) > CACHED_EDGES:
                now = self.states[state]
                self.forget_states()
                state = self.number(now)
            edges = self.edges
            for byte in word[begin : begin + STRETCH]:
                step = edges.get(state << 8 | byte) or self.edge(state, byte)
                state = step[0]
                total += step[1]
        return total

    def count_words(self, found: list[bytes]) -> np.ndarray:
        if len(self.counts) > CACHED_WORDS or len(self.edges) > CACHED_EDGES:
            self.forget()
        known = self.counts
        for w in found:
            if w not in known:
                known[w] = self.count(w)
        return np.array([known[w] for w in found], np.int64)

    def count_texts(self, texts: list[str]) -> np.ndarray:
        pieces, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for mark in self.special:
                if mark in text:
                    parts = [q for p in parts for q in p.split(mark)]
            special[i] = len(parts) - 1
            pieces += parts
            owner += [i] * len(parts)
        joined = "\n".join(pieces) + "\n"
        points = words.code_points(joined)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        stream = kinds()[points]
        stream[ends] = END
        begins = np.flatnonzero(boundaries(stream))
        found, codes = words.distinct(points, begins)
        counts = self.count_words(found.to_pylist())[codes]
        counts[np.searchsorted(begins, ends)] = 0  # what stands between the pieces
        before = np.append(0, np.cumsum(counts))
        each = np.diff(np.append(0, before[np.searchsorted(begins, ends)]))
        return np.bincount(owner, each, len(texts)).astype(np.int64) + special


@functools.lru_cache(maxsize=2)
def machine(path: str) -> CountingBpe:
    return CountingBpe(path)


def count_documents(docs: DataFrame, path: str = VOCABULARY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = machine(path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                column = part.column("text")
                n = counter.count_texts(common.texts(column)) if len(part) else np.empty(0, np.int64)
                sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.map_arrow(common.renamed(docs, {"doc_id": id_col, "text": text_col}), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(common.table(spark, sf_dir, "documents"))
