import collections
import hashlib
import random

import numpy as np
import pytest

from stitchwork.llm import common, components, substrings, windows


def brute(documents):
    data = {i: (t or "").encode() for i, t in documents}
    often = collections.Counter(b[k : k + 200] for b in data.values() for k in range(len(b) - 199))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if often[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest())
    return out


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(25)[:150], prose(90)
    texts = [prose(30) + line + prose(30) for _ in range(40)]  # shared, but shorter than a window
    texts += [prose(r.randint(5, 80)) + passage[r.randint(0, 60) : len(passage) - r.randint(0, 60)] + prose(r.randint(5, 80)) for _ in range(40)]
    texts += [passage[a : a + 200] for a in (0, 1, 7)] + [passage[:199], passage[5:204] + "#"]
    texts += ["ab" * 300, "q" * 700, prose(60) * 3, passage * 2]
    long = prose(500)
    texts += [long[: 100 * k] + "!" + long[100 * k :] for k in range(1, 12)]
    return [(5000 + i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("batches, group, repeated", [(1, 64, 4096), (2, 2, 4096), (3, 2, 20)])
def test_removed_bytes_are_brute_force(spark, hard, nothing, documents, monkeypatch, batches, group, repeated):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "REPEATED", repeated)
    more = fixture()
    docs = hard.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    rows = substrings.without_repeats(docs, batches).collect()
    assert len(rows) == len(documents) + len(more)
    expect = brute(documents + more)
    for r in rows:
        n = r.n_bytes
        assert (n, n - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) == expect[r.doc_id], r.doc_id
    assert substrings.without_repeats(nothing, batches).collect() == []


def test_windows_across_blocks(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 300)
    data = np.frombuffer(random.Random(1).randbytes(900) * 2, np.uint8)
    found = windows.suffixes(data, np.array([0, 900]))
    # each window of each document is sampled once, by a gram inside it
    for row in (0, 1):
        own = found["row"] == row
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(found["low"][own], found["high"][own])])
        assert sorted(starts.tolist()) == list(range(701))
        assert (found["at"][own] >= found["high"][own]).all() and (found["at"][own] + windows.GRAM <= found["low"][own] + windows.WINDOW).all()
    keys = lambda row: set(found["key"][found["row"] == row].tolist())
    assert keys(0) == keys(1)


def test_equal_sized_levels_merge(spark):
    folder = common.work_dir(spark)
    family = substrings.Family(spark, folder)
    batch = lambda *keys: spark.createDataFrame([(-k, k, k, 1, 0, 0, 0) for k in keys], "lead long, key long, context long, doc_id long, at int, low int, high int")
    assert family.add(batch(1, 2)).collect() == []
    assert [r.key for r in family.add(batch(2, 3)).collect()] == [2] and list(family.levels) == [1]
    assert sorted(r.key for r in family.add(batch(1, 5, 5)).collect()) == [1, 5] and sorted(family.levels) == [0, 1]
    family = substrings.Family(spark, folder)  # another session
    assert sorted(family.levels) == [0, 1] and family.made == 4
    assert family.add(batch(9)).collect() == [] and list(family.levels) == [2]
    wanted = spark.createDataFrame([(-2, 2), (-5, 5)], "lead long, key long")
    assert {r.key: r.n for r in family.contexts(wanted).collect()} == {2: 2, 5: 2}
    # a merge that was broken off: its sources are still there, and what it began has no end
    family.write(family.read(family.levels[2]), 0, first=None)
    family.read(family.levels[2]).write.parquet(f"{folder}/array-3-1-1")
    family.read(family.levels[2]).write.parquet(f"{folder}/array-9-1-3")
    common.remove(spark, f"{folder}/array-9-1-3/_SUCCESS")
    again = substrings.Family(spark, folder)
    assert again.levels == {0: f"{folder}/array-{family.made}-{family.made}-0", 2: family.levels[2]}


def test_arrays_are_in_suffix_order(spark):
    """Leads order as the bytes do, and an array's files are sorted runs."""
    data = np.frombuffer(random.Random(2).randbytes(4000), np.uint8)
    found = windows.suffixes(data, np.array([0]))
    suffixes = [data[a : a + 8].tobytes() for a in found["at"].tolist()]
    assert np.argsort(found["lead"], kind="stable").tolist() == sorted(range(len(suffixes)), key=lambda i: suffixes[i])
    docs = spark.createDataFrame(fixture(), "doc_id long, text string").repartition(3)
    family = substrings.Family(spark, common.work_dir(spark))
    family.add(substrings.entries(docs))
    parts = family.read(family.levels[0]).rdd.glom().collect()
    assert all([tuple(r[:3]) for r in p] == sorted(tuple(r[:3]) for r in p) for p in parts) and sum(map(len, parts))


def test_size_tells_batches(spark, hard, monkeypatch):
    assert substrings.batches_for(hard) == 2
    monkeypatch.setattr(substrings, "BATCH_BYTES", 20_000)
    assert substrings.batches_for(hard) > 2


def test_components_of_chains_and_stars(spark):
    chain, star = [(i, i + 1) for i in range(1, 60)], [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (300, 200)], "a long, b long")
    found = {r.node: r.component for r in components.connected(links, common.work_dir(spark)).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}
    assert components.connected(links.limit(0), common.work_dir(spark)).collect() == []
