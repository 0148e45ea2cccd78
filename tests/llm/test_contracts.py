"""The registered queries on their whole tables, every contract column against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stitchwork.llm import bpe, common, registry, secrets, transducer

from . import test_substrings, test_text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in common.table(spark, small, "documents").collect()}


def rows_of(spark, small, name):
    return registry.QUERIES[name](spark, small).collect()


def test_op1(spark, small, texts):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    found = collections.defaultdict(dict)
    for r in rows_of(spark, small, "op1_token_output"):
        ids = np.frombuffer(r.ids, "<u2")
        for doc, piece, begin, end in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            found[doc][piece] = ids[begin:end].tolist()
    assert {d: sum((p[i] for i in range(len(p))), []) for d, p in found.items()} == {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}


def test_op2(spark, small, texts):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    rows = rows_of(spark, small, "op2_bpe")
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op3(spark, small, texts):
    rows = rows_of(spark, small, "op3_secrets")
    assert len(rows) == len(texts)
    for r in rows:
        base = test_text.brute_spans(texts[r.doc_id])
        count = collections.Counter(k for k, _, _ in base)
        listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (count["assign"], count["access"], count["hex"], sha(listed(base)))
        assert r.spans == listed(secrets.scan(texts[r.doc_id])) and set(base) <= set(secrets.scan(texts[r.doc_id]))


def test_op5(spark, small, texts):
    library = Tokenizer.from_file(transducer.VOCABULARY)
    rows = rows_of(spark, small, "op5_token_counts")
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_op6(spark, small, texts):
    groups = collections.defaultdict(list)
    for d, t in texts.items():
        groups[t].append(d)
    rows = rows_of(spark, small, "op6_exact_dedup")
    assert len(rows) == len(texts)
    for r in rows:
        group = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(group), len(group), r.doc_id == max(group), sha(texts[r.doc_id]))


def test_op7(spark, small, texts):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    places, lengths = collections.defaultdict(list), collections.Counter()
    for r in rows_of(spark, small, "op7_packing"):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        own = ids[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and r.length == min(2048, len(ids) - r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    assert lengths.keys() == texts.keys()
    for own in places.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert len(places) <= 1.02 * sum(lengths.values()) / 2048 + 1


def test_op8(spark, small, texts):
    rows = rows_of(spark, small, "op8_quality")
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == test_text.brute_base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_op9(spark, small, texts):
    rows = rows_of(spark, small, "op9_near_dedup")
    expect = test_text.brute_components(list(texts.items()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expect and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op10(spark, small, texts):
    rows = rows_of(spark, small, "op10_substrings")
    expect = test_substrings.brute(list(texts.items()))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expect and len(rows) == len(texts)
