import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchwork.llm import common, exact_dedup, html_text, near_dedup, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# op3
def brute_spans(text):
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            found.append((m.start(), 1, "access", m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 16:
            found.append((m.start(), 2, "hex", m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_base_spans_are_brute_force():
    r = random.Random(5)
    parts = ["password", "API_KEY", "apikey", "Token", "ſecret", "secret", "AKIA", "AKIAABCDEFGHIJKLMN", '"', "'", "=", ":", " ", "abcdef012345", "ABCDEF_/+=", "deadbeefdeadbeef", "İ", "\n"]
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert [s for s in secrets.scan(text) if s[0] in ("assign", "access", "hex")] == brute_spans(text), text


def test_ledger_scans_each_blob_once_per_version_of_rules(spark, hard, nothing, documents, monkeypatch):
    folder = f"{common.work_dir(spark)}/ledger"
    rows = {r.path: r for r in secrets.Ledger(spark, folder).scan(hard, "doc_id", None).collect()}
    assert len(rows) == len(documents)
    for i, t in documents:
        assert [tuple(s) for s in rows[i].found if s.kind in ("assign", "access", "hex")] == brute_spans(t or "")
    known = secrets.Ledger(spark, folder).findings().count()
    assert known == len({t or "" for _, t in documents})
    again = secrets.Ledger(spark, folder).scan(hard, "doc_id", None)
    assert again.count() == len(documents) and secrets.Ledger(spark, folder).findings().count() == known
    versions = spark.createDataFrame([("p", 1, "token=aaaaaaaaaaaa"), ("p", 2, "x"), ("q", 1, "token=aaaaaaaaaaaa"), ("q", 1, "token=aaaaaaaaaaaa"), (None, None, None)], "path string, version int, text string")
    found = secrets.Ledger(spark, folder).scan(versions).collect()
    assert sorted(len(r.found) for r in found) == [0, 0, 1, 1, 1]
    assert secrets.Ledger(spark, folder).findings().count() == known + 2  # "" was there
    assert secrets.Ledger(spark, folder, 2).findings().count() == 0
    ledger = secrets.Ledger(spark, folder)  # two scans at a time
    common.stored(ledger.findings(), f"{folder}-copy").write.mode("append").parquet(ledger.path)
    assert sorted(len(r.found) for r in ledger.scan(versions).collect()) == [0, 0, 1, 1, 1]
    assert secrets.Ledger(spark, folder).scan(nothing, "doc_id", None).collect() == []


def test_redaction(spark, hard, documents):
    out = secrets.redacted(hard, secrets.Ledger(spark, f"{common.work_dir(spark)}/ledger"))
    assert out.columns == hard.columns
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in documents:
        spans = brute_spans(t or "")
        assert (rows[i].text == t) == (not spans)
        assert rows[i].n_chars == (None if t is None else len(rows[i].text)) and not brute_spans(rows[i].text or "")
    rows = [(None, "password=abcdefghijklmnop x"), (1, "a harmless text that is long"), (1, "token: abcdefghijklmnop"), (1, "token: abcdefghijklmnop"), (2, None)]
    out = secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string"), secrets.Ledger(spark, f"{common.work_dir(spark)}/ledger")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(0, "[redacted] x"), (1, "[redacted]"), (1, "[redacted]"), (1, "a harmless text that is long"), (2, "")]
    assert secrets.redact("0123456789", [(1, 4), (2, 3), (6, 8)]) == "0[redacted]45[redacted]89"


# op4
@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<p>a", "a"), ("a &lt; b &eacute;&#x41;", "a < b éA"), ("<script>var t='</p>'</script><p>x\n  y</p>", "x y"),
        ("<nav><a>m</a></nav><article><h1>T</h1><p>one<br>two<p>three</article><footer>f</footer>", "T\none two\nthree"),
        ("<div class='post'><p>hello there my friend</p><p>b</p></div><div class='comments'><p>great long comment about it</p></div>", "hello there my friend\nb"),
        ("<main><p>long enough text to be content here</p><div class='ad'>buy</div><aside>side</aside></main>", "long enough text to be content here"),
        ("<article><p>" + "x" * 100000 + "</p></article>", "x" * 100000), ("<form><p>f</p></form><style>p{}</style>", ""),
    ],
)
def test_main_text(html, text):
    assert (html_text.main_text(html) if html else "") == text


LONG = ["one long paragraph of the page that says much", "two long paragraphs are better than one of them"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><div id=c><h1>T</h1><div><p>{0}</p></div><div><p>{1}</p></div></div></body>", "T\n{0}\n{1}"),
        ("<article><p>{0}</p></article><article><p>{1}</p></article><p>x</p>", "{0}\n{1}"),
        ("<body class='has-sidebar'><article class='share-enabled'><p>{0}</p></article><div class=sidebar><p>{1}</p></div></body>", "{0}"),
        ("<div class='no-sidebar'><p>x</p><div class=ad>{0}</div><main id=social><p>{1} <b class=share>y</b></p></main></div>", "{1}"),
        ("<p>{0}</p><p>{1}</p>", "{0}\n{1}"),
        ("<div><p>{0}</p></div><div><p>{1}</p></div>", "{0}\n{1}"),
        ("<body class='has-sidebar'><article><p>{0}</p></article><div class='cookie-notice'><p>{1} {1} {1}</p></div>", "{0}"),
        ("<div class='post no-comments'><p>{0}</p></div>", "{0}"),
        ("<div id='social-history'><p>{0}</p><p>{1}</p></div>", "{0}\n{1}"),
        ("<article><header><h1>T</h1></header><p>{0}</p><div class='comment-list'><p>{1}</p></div></article>", "T\n{0}"),
        ("<header><p>{1}</p></header><div><h1>T</h1><p>{0}</p><p>short</p></div><div class='site-footer'><p>{1}</p></div>", "T\n{0}\nshort"),
        ("<div class='widget'><p>{0}</p></div><div class='comments'><p>{1} {1}</p></div>", "{0}"),
        ("<form><h1>T</h1><p>{0}</p></form>", "T\n{0}"),
        ("<ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul><div><p>{0}</p><p>{1}</p></div>", "{0}\n{1}"),
        ("<article><p>{0}</p><article class=comment><p>c</p></article></article>", "{0}\nc"),
    ],
)
def test_main_text_of_all_clusters(html, text):
    assert html_text.main_text(html.format(*LONG)) == text.format(*LONG)


def test_clusters_decide(monkeypatch):
    """The text is what the clusters select, and not what names alone leave."""
    page = "<nav><a>m</a></nav><div><a>x</a> <a>y</a></div><div><h1>T</h1><p>{0}</p><p>{1}</p></div><div><b>v</b> <a>w</a> <i>z</i></div>".format(*LONG)
    menu = "<nav><ul><li>one entry<li>m</ul></nav>"
    assert html_text.main_text(menu + page) == "T\n{0}\n{1}".format(*LONG)
    monkeypatch.setattr(html_text, "content", lambda ratios: np.arange(len(ratios)) < 2)
    assert html_text.main_text(menu + page) == "one entry\nm"


def test_extracted_pages(spark, small):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a b</p>", "y"), (2, "u", "<p>a b</p>", "y")], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(pages).collect()) == [("", 0), ("a b", 3), ("a b", 3)]
    rows = html_text.op4_html_text(spark, small).collect()
    source = {r.page_id: r.html for r in common.table(spark, small, "pages").collect()}
    assert len(rows) == len(source)
    for r in rows:  # every word of the article, none of its surroundings
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        words = re.sub(r"<[^>]*>", " ", article).replace("&amp;", "&").split()
        assert r.text.split() == words


# op6
def test_exact_dedup(spark, hard, nothing, documents):
    expect = collections.defaultdict(list)
    for i, t in documents:
        expect[t or ""].append(i)
    for digest in (None, "cast(length(text) % 3 as string)"):  # a weak digest makes hits of different texts
        from pyspark.sql import functions as F

        rows = exact_dedup.classes(hard, digest=F.expr(digest) if digest else None).collect()
        assert len(rows) == len(documents)
        assert {r.doc_id: (r.keep_id, r.group_size) for r in rows} == {i: (max(g), len(g)) for g in expect.values() for i in g}
    assert exact_dedup.classes(nothing).collect() == []


def test_state_goes_on_with_later_batches(spark):
    folder = common.work_dir(spark)
    state = exact_dedup.DedupState(spark, folder)
    key = lambda rows: spark.createDataFrame(rows, "digest string, doc_id long")
    state.add(key([("x", 1), ("y", 2)]))
    state = exact_dedup.DedupState(spark, folder)  # another session
    assert state.batches == 1
    keys, found = state.add(key([("x", 5), ("z", 3)]))
    assert {r.digest: (r.n, r.doc_id, r["first"]) for r in found.collect()} == {"x": (2, 5, 1), "z": (1, 3, 2)}
    assert {(r.digest, r.doc_id, r.locator) for r in keys.collect()} == {("x", 5, 2), ("z", 3, 2)}


@pytest.mark.parametrize("digest", [None, "cast(length(text) % 2 as string)"])
def test_classes_over_batches_are_brute_force(spark, digest):
    from pyspark.sql import functions as F

    batches = [[(1, "a"), (9, "b"), (2, "a"), (3, "cc")], [(4, "a"), (5, "b"), (6, "dd"), (7, "e")], [], [(8, "cc"), (10, "e"), (11, None), (12, "f")], [(13, "")]]
    state, seen = exact_dedup.DedupState(spark, common.work_dir(spark)), collections.defaultdict(list)
    for rows in batches:
        for i, t in rows:
            seen[t or ""].append(i)
        found = exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), state, digest=F.expr(digest) if digest else None).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == sorted((i, max(seen[t or ""]), len(seen[t or ""])) for i, t in rows)
    once = exact_dedup.DedupState(spark, common.work_dir(spark), goes_on=False)
    docs = spark.createDataFrame(batches[0], "doc_id long, text string")
    assert exact_dedup.classes(docs, once).count() == 4
    with pytest.raises(ValueError):
        exact_dedup.classes(docs, once)


@pytest.mark.parametrize("digest", [None, "cast(length(text) % 2 as string)"])
def test_exact_dedup_takes_null_and_repeated_ids(spark, digest):
    from pyspark.sql import functions as F

    rows = [(None, "a"), (None, "a"), (3, "a"), (None, "b"), (None, "cc"), (None, "cc"), (5, "d"), (5, "d"), (5, "e"), (6, "e"), (7, "ff"), (7, "ff"), (7, "ff")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    found = exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), digest=F.expr(digest) if digest else None).collect()
    expect = [(i, max((j for j in groups[t] if j), default=None), len(groups[t])) for i, t in rows]
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == collections.Counter(expect)


# op8
def brute_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in (i, i + 1, i + 2)}
    lines = collections.Counter(line for line in (text or "").split("\n") if WORD.search(line))
    n = len(words)
    counts = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(lines.values()) - len(lines), len(covered))
    return (*counts, n < 50 or 100 * len(covered) > 50 * n)


def test_base_rules(spark, hard, nothing, documents):
    r = random.Random(4)
    more = [(10_000 + i, "".join(r.choice(["a", "b", " ", "  ", "\n", "\t", "#", "é", "\x0b", " "]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs = hard.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = {r.doc_id: r for r in quality.base_rules(docs).collect()}
    for i, t in documents + more:
        q = rows[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_base(t), (i, t)
    assert quality.base_rules(nothing).collect() == []


def brute_verdict(rows, trusted, spark):
    """kept of each (doc_id, text) by counting every word and pair of neighbours; hashes are Spark's."""
    texts = {t for _, t in rows if t}
    words = sorted({w for t in texts for w in WORD.findall(t)})
    hashed = dict(zip(words, (r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").coalesce(1).selectExpr("xxhash64(w)").collect())))
    pairs = sorted({(hashed[a], hashed[b]) for t in texts for a, b in itertools.pairwise(WORD.findall(t))})
    joined = dict(zip(pairs, (r[0] for r in spark.createDataFrame(pairs, "a long, b long").coalesce(1).selectExpr("xxhash64(a, b)").collect())))
    grams = []
    for _, t in rows:
        w = [hashed[x] for x in WORD.findall(t or "")]
        grams.append([h % quality.BUCKETS for h in w] + [joined[p] % quality.BUCKETS for p in itertools.pairwise(w)])
    raw, target = collections.Counter(), collections.Counter()
    for (i, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        target.update(g if i in trusted else [])
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: round(math.log((target[b] + 5) / (n * share + 5)) * 1_000_000) for b, n in raw.items()}
    return [not brute_base(t)[-1] and sum(ratio[b] for b in g) >= quality.THRESHOLD * 1_000_000 * len(g) for (_, t), g in zip(rows, grams, strict=True)]


def test_verdict_is_brute_force(spark, hard, nothing, documents):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "house", "stood", "near", "river", "and", "mill", "old", "man", "walked", "green"]) + r.choice(["", "s", ",", ".", "ing"]) for _ in range(90))
    junk = lambda: " ".join(r.choice(["the", "house", "river"]) + r.choice(["%%%", "$$$"]) + str(r.randint(0, 99)) for _ in range(90))
    more = [(-1 - i, good() if i % 3 else junk()) for i in range(900)] + [(-2000, junk()), (-2000, good())]
    docs = hard.unionByName(spark.createDataFrame([(*d, "x") for d in more] + [(None, None, "x")], "doc_id long, text string, bucket string"), allowMissingColumns=True)
    trusted = [-1 - i for i in range(600) if i % 3]
    rows = quality.judged(docs, spark.createDataFrame([(i,) for i in [*trusted, None, 99999]], "doc_id long")).collect()
    expect = brute_verdict(documents + more, set(trusted), spark)
    assert sorted((q.doc_id, q.kept) for q in rows if q.doc_id is not None) == sorted((i, k) for (i, _), k in zip(documents + more, expect, strict=True))
    assert all(k == bool(i % 3) for i, k in enumerate(expect[len(documents) : -2]))
    assert [(q.kept, q.score, q.n_words) for q in rows if q.doc_id is None] == [(False, None, 0)]
    nobody = spark.createDataFrame([], "doc_id long")
    assert all(q.kept == (not q.base_failed) for q in quality.judged(docs, nobody).collect())
    assert quality.judged(nothing, nobody).collect() == []


def test_labels_of_held_out_documents(spark):
    """Fitted on one half of the labelled documents, the verdict tells good from bad in the other half."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    fitted = quality.judged(docs, labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id"))
    found = {r.quality: r.kept for r in fitted.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert found[1] >= 0.9 and found[0] <= 0.15


def test_bounded_sample_of_trusted_ids(spark):
    ids = spark.range(5000).toDF("doc_id")
    n = quality.bounded(ids, 500).count()
    assert 400 < n < 600 and quality.bounded(ids, 500).exceptAll(quality.bounded(ids, 500)).count() == 0
    assert quality.bounded(ids, 5000).count() == 5000


# op9
def brute_components(documents):
    sets = {}
    for i, t in documents:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_fixture():
    """Groups of near copies around the threshold, chains, and a passage that many documents share."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts, passage = [], [word() for _ in range(40)]
    for size in (30, 90, 300):
        base = [word() for _ in range(size)]
        for _ in range(40):
            w = list(base)
            for _ in range(r.randint(0, max(1, size // 25))):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    chain = [word() for _ in range(200)]
    for _ in range(25):
        chain = chain[12:] + [word() for _ in range(12)]
        texts.append(" ".join(chain))
    texts += [" ".join([word() for _ in range(12)] + passage) for _ in range(60)]
    return [(i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("short_list, tile", [(24, 256), (2, 7), (1000, 256)])
def test_near_classes_are_brute_force(spark, hard, nothing, documents, monkeypatch, short_list, tile):
    monkeypatch.setattr(near_dedup, "SHORT_LIST", short_list)
    monkeypatch.setattr(near_dedup, "TILE", tile)
    near = [(1000 + i, t) for i, t in near_fixture()]
    docs = hard.unionByName(spark.createDataFrame(near, "doc_id long, text string"), allowMissingColumns=True)
    rows = near_dedup.near_classes(docs).collect()
    assert len(rows) == len(documents) + len(near)
    expect = brute_components(documents + near)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expect
    assert near_dedup.near_classes(nothing).collect() == []


def test_repeated_rows_and_rows_without_an_id(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text)], "doc_id long, text string")
    rows = near_dedup.near_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (2, 2), (4, 2), (4, 2)]


def test_digest_of_pages(spark, small):
    rows = exact_dedup.op6_exact_dedup(spark, small).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, small, "documents").collect()}
    assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)
