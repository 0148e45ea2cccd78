"""op2: byte-pair encoding and decoding of whole texts, as the tokenizers library does with a file of words that end in a mark.

Batched numpy merge rounds: the symbols of all distinct words of a batch lie in one flat array; pairs find their rank by binary
search over sorted pair keys; in each round every word merges its pair of lowest rank wherever it stands, left to right, until no
word has a pair with a rank. Words seen before come from a cache of bounded size.

Null texts count as empty: no ids, an empty decoded text. White space only: the same. Very long texts are coded whole, an empty table
gives no rows. Strings of special tokens inside a text become
that token's id, as is the library's default. Rows with equal ids or texts are all returned. Other columns are left out.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchwork.llm import common, words

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words kept from one batch to the next; beyond it a worker begins anew.
CACHED_WORDS = 200_000
NEVER = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable Latin-1, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary of one file: ids of words, texts of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + mark] for c in letters], np.int32)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        first = np.unique(key, return_index=True)
        self.keys, self.ranks = first[0], first[1].astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        #: of the first pairs of a word: byte by byte, and by byte before the last byte
        self.first = np.stack([self.rank(np.repeat(self.inner, 256), np.tile(right, 256)) for right in (self.inner, self.last)])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        by_id = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = pa.array([by_id.get(i, "") for i in range(max(by_id) + 1)], pa.large_string())
        self.size = len(by_id)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge(self, distinct_words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words in one array, and how many each has. No word may be empty."""
        sizes = np.array([len(w) for w in distinct_words], np.int64)
        data = np.frombuffer(b"".join(distinct_words), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(symbols), NEVER)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        final = np.zeros(len(symbols), np.int8)
        final[ends] = 1
        rank[inside] = self.first[final[inside + 1], data[inside].astype(np.int32) << 8 | data[inside + 1]]
        done_ids, done_owner = [], []
        while len(symbols):
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(heads, len(symbols)))
            least = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            open_ = least != NEVER
            if not open_.all():
                done_ids.append(symbols[~open_])
                done_owner.append(owner[~open_])
                symbols, owner, rank, least = symbols[open_], owner[open_], rank[open_], least[open_]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == least)
            # of hits that overlap (a a a), every second one counts, from the left
            if len(hit) > 1 and (near := np.diff(hit) == 1).any():
                run = np.append(True, ~near)
                place = np.arange(len(hit))
                hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            new = moved[hit]
            near = np.zeros(len(symbols), bool)
            near[new] = True
            near[new[new > 0] - 1] = True
            look = np.flatnonzero(near)
            last = look == len(symbols) - 1
            rank[look[last]] = NEVER
            look = look[~last]
            same = owner[look] == owner[look + 1]
            rank[look] = np.where(same, self.rank(symbols[look], symbols[look + 1]), NEVER)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(sizes))

    def word_numbers(self, found: list[bytes]) -> np.ndarray:
        """For each of these distinct words its place in the cache, where all of them are afterwards."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        new = [w for w in found if w not in self.known]
        if new:
            ids, counts = self.merge(new)
            self.known.update(zip(new, range(len(self.starts), len(self.starts) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(counts) - counts])
            self.counts, self.pool = np.concatenate([self.counts, counts]), np.concatenate([self.pool, ids])
        return np.array([self.known[w] for w in found], np.int64)

    def normalised(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: case goes by the character
        return text.lower()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and the n+1 places where each text's ids begin and the last's end."""
        pieces, fixed, per_text = [], [], []
        for text in texts:
            parts = self.split.split(text) if "<|" in text else [text]
            per_text.append(len(parts))
            for p in parts:
                fixed.append(self.special.get(p, -1) if len(parts) > 1 else -1)
                pieces.append("" if fixed[-1] >= 0 else self.normalised(p))
        joined = "\n".join(pieces) + "\n"
        points = words.code_points(joined)
        begins, solid = words.word_starts(points)
        found, codes = words.distinct(points[solid], (np.cumsum(solid) - 1)[begins])
        numbers = self.word_numbers(found.to_pylist())[codes]
        counts = self.counts[numbers]
        ids = self.pool[words.ragged(self.starts[numbers], counts)]
        # pieces end at their "\n"; a word belongs to the piece that it begins in
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        before = np.append(0, np.cumsum(counts))
        bounds = np.append(0, before[np.searchsorted(begins, ends)])
        fixed = np.array(fixed, np.int64)
        if (fixed >= 0).any():
            at = np.flatnonzero(fixed >= 0)
            ids = np.insert(ids, bounds[at], fixed[at].astype(np.int32))
            bounds = bounds + np.append(0, np.cumsum(fixed >= 0))
        return ids, bounds[np.append(0, np.cumsum(per_text))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts as the library's decode() gives them without a decoder: the tokens with a space between."""
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string for each row."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, bounds = bpe.encode(common.texts(part.column("text")))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, bpe.decode(ids, bounds).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return common.map_arrow(common.renamed(docs, {"doc_id": id_col, "text": text_col}), run, f"doc_id {kind}, ids array<int>, decoded string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(common.table(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
