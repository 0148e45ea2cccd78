import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from stitchwork.llm import bpe, packing, token_output, transducer

LETTERS = "abrelvstmd' \n\t.,!1é　 'AΣİ²½\x1c\x85<|>"


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(transducer.VOCABULARY)


def random_texts(n):
    r = random.Random(n)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 50))) for _ in range(n)]


def test_ids_and_decoded_texts_are_the_librarys(word_library, documents):
    texts = [t or "" for _, t in documents] + random_texts(3000)
    coder = bpe.vocabulary(bpe.VOCABULARY)
    ids, bounds = coder.encode(texts)
    decoded = coder.decode(ids, bounds).to_pylist()
    for i, e in enumerate(word_library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[bounds[i] : bounds[i + 1]].tolist(), texts[i][:80]
        assert word_library.decode(e.ids, skip_special_tokens=False) == decoded[i]


def test_cache_may_be_dropped_between_batches(monkeypatch, documents):
    texts = [t or "" for _, t in documents]
    coder = bpe.WordBpe(bpe.VOCABULARY)
    first = coder.encode(texts)[0]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    assert [coder.encode(texts)[0].tolist() for _ in range(2)] == [first.tolist()] * 2


def test_encoded_documents(spark, hard, nothing, documents, word_library):
    rows = {r.doc_id: r for r in bpe.encode_documents(hard).collect()}
    assert len(rows) == len(documents)
    for i, t in documents:
        assert rows[i].ids == word_library.encode(t or "", add_special_tokens=False).ids
    assert bpe.encode_documents(nothing).collect() == []


def test_counts_are_the_librarys(byte_library, documents):
    texts = [t or "" for _, t in documents] + random_texts(5000)
    counts = transducer.machine(transducer.VOCABULARY).count_texts(texts)
    assert counts.tolist() == [len(e.ids) for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_class_is_the_librarys(byte_library):
    texts = [f"a{chr(c)}b {chr(c)} '{chr(c)}" for c in (*range(0x3000), *range(0x1F300, 0x1F400))]
    counts = transducer.machine(transducer.VOCABULARY).count_texts(texts)
    assert counts.tolist() == [len(e.ids) for e in byte_library.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps_compose_to_the_states_of_one_run():
    following, _ = transducer.splitter()
    stream = np.random.default_rng(1).integers(0, 12, 9 * transducer.CHUNK).astype(np.uint8)
    state, entered = transducer.FRESH, []
    for i, kind in enumerate(stream):
        if i % transducer.CHUNK == 0:
            entered.append(state)
        state = following[12 * state + kind]
    columns = np.ascontiguousarray(stream.reshape(-1, transducer.CHUNK).T)
    assert transducer.entry_states(columns, following.astype(np.int64)).tolist() == entered


def test_counted_documents(hard, nothing, documents, byte_library):
    rows = {r.doc_id: r for r in transducer.count_documents(hard).collect()}
    for i, t in documents:
        n = len(byte_library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert len(rows) == len(documents) and transducer.count_documents(nothing).collect() == []


def test_plan_is_best_fit_longest_first():
    r = random.Random(2)
    for _ in range(200):
        capacity = r.choice([7, 64, 100])
        histogram = {r.randint(1, capacity): r.randint(1, 40) for _ in range(9)}
        filled = {}
        for length, _, n, first, per_bin, at in packing.plan(histogram, capacity):
            for j in range(n):
                filled.setdefault(first + j // per_bin, []).append((at + j % per_bin * length, length))
        for places in filled.values():
            end = 0
            for at, length in sorted(places):
                assert at == end
                end += length
            assert end <= capacity
        lengths = np.repeat(list(histogram), list(histogram.values()))
        assert len(filled) == token_output.best_fit(lengths, capacity).max() + 1 == slow_best_fit(lengths, capacity)


def slow_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packed_pieces(hard, nothing, documents, word_library, capacity):
    import zlib

    rows = packing.pack(hard, capacity=capacity).collect()
    ids = {i: [*word_library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in documents}
    seen, sequences = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == r.piece * capacity and len(piece) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append(r.length)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sum(n) for i, n in seen.items()} == {i: len(x) for i, x in ids.items()}
    for places in sequences.values():
        places.sort()
        assert [at for at, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= capacity
    lengths = np.array([n for own in seen.values() for n in own])
    assert len(sequences) == slow_best_fit(lengths, capacity)
    assert packing.pack(nothing, capacity=capacity).collect() == []


def test_matrices_round_trip(hard, nothing, documents, word_library):
    rows = token_output.matrices(hard, window_chars=150_000).collect()
    back = token_output.unpacked(rows)
    for i, t in documents:
        assert back[i].tolist() == [*word_library.encode(t or "", add_special_tokens=False).ids, 0]
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        positions = np.frombuffer(r.position_ids, "<u2")
        assert len(positions) == 2048 == len(r.ids) // 2 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        for begin, end in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[begin:end].tolist() == list(range(end - begin))
        assert not positions[r.n_tokens :].any()
    assert token_output.matrices(nothing).collect() == []


def test_number_of_sequences_does_not_depend_on_the_split(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = {token_output.matrices(docs.repartition(n), window_chars=500_000).count() for n in (1, 7, 64)}
    assert len(counts) == 1
    whole = token_output.matrices(docs).count()
    assert whole == len({r.sequence_id for r in packing.pack(docs).select("sequence_id").distinct().collect()})


def test_states_stay_bounded_in_a_long_word(byte_library, monkeypatch):
    r = random.Random(5)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(60_000))
    monkeypatch.setattr(transducer, "CACHED_EDGES", 5000)
    machine = transducer.CountingBpe(transducer.VOCABULARY)
    assert machine.count_texts([word, "a b", word[:777]]).tolist() == [len(e.ids) for e in byte_library.encode_batch([word, "a b", word[:777]], add_special_tokens=False)]
    assert len(machine.edges) <= 5000 + transducer.STRETCH
