import collections

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from stitchwork.llm import common, packing, quality, registry, secrets

from .test_text import brute_base, brute_components, brute_spans


def test_stages_against_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = common.stored(stages["quality_rules"](spark, docs, small), common.work_dir(spark))
    all_ = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r.text for r in kept.collect()}
    judged = {r.doc_id: r.kept for r in quality.judged(docs, quality.trusted_ids(spark, small)).collect()}
    assert kept.columns == columns and rows == {i: t for i, t in all_.items() if judged[i]}
    assert not any(brute_base(t)[-1] for t in rows.values())
    good = {r.doc_id for r in common.table(spark, small, "labels").where("quality = 1").collect()}
    assert all(judged[i] for i in good if not brute_base(all_[i])[-1])

    once = common.stored(stages["exact_dedup"](spark, kept, small), common.work_dir(spark))
    groups = collections.defaultdict(list)
    for i, t in rows.items():
        groups[t].append(i)
    rows = {r.doc_id: r.text for r in once.collect()}
    assert once.columns == columns and set(rows) == {max(g) for g in groups.values()}

    apart = common.stored(stages["near_dedup"](spark, once, small), common.work_dir(spark))
    expect = {c for _, c in brute_components(list(rows.items())).values()}
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == expect

    clean = common.stored(stages["secret_scan"](spark, apart, small), common.work_dir(spark))
    texts = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == columns and set(texts) == expect
    for i, r in texts.items():
        assert not brute_spans(r.text) and len(r.text) == r.n_chars
        assert brute_spans(rows[i]) or r.text == rows[i]

    packed = stages["best_fit_packing"](spark, clean, small).collect()
    assert {r.doc_id for r in packed} == expect
    place = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(place, packed)) == sorted(place(r) for r in packing.pack(clean).collect())
    assert sorted(map(place, corpus_pipeline.run(spark, small).collect())) == sorted(map(place, packed))


def test_stages_take_hard_and_empty_tables(spark, hard, nothing, small):
    for docs in (hard, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.stored(stage(spark, docs, small), common.work_dir(spark))
            assert out.columns == docs.columns, name
        n = corpus_pipeline.STAGES[-1][1](spark, docs, small).count()
        assert (n > 0) == (docs is hard)


def test_one_of_repeated_rows_stays(spark, small):
    rows = [(1, "a", "en"), (1, "a", "en"), (1, "b", "en"), (4, "b", None), (4, "b", None), (5, None, "fr"), (5, "", "fr"), (5, "x", "fr"), (None, "a", "en"), (6, "y", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = corpus_pipeline.without_copies(spark, docs, small)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.digest or "") for r in out.collect()) == [(1, "a", "en"), (4, "b", ""), (5, "", "fr"), (5, "x", "fr"), (6, "y", "en")]


def test_registered(spark):
    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "secret_scan", "best_fit_packing"]


def test_run_leaves_no_steps_behind(spark, small):
    base = f"{spark.conf.get('spark.checkpoint.dir')}/stitchwork"
    before = set(common.names_in(spark, base))
    n = corpus_pipeline.run(spark, small).count()
    left = set(common.names_in(spark, base)) - before
    # the last stage's pieces and what the stage before kept
    assert n and len([name for name in left if common.names_in(spark, f"{base}/{name}")]) == 2


def test_rows_without_id_go_through(spark, small):
    rows = common.table(spark, small, "documents")
    nameless = rows.where("doc_id < 100").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" and more words")))
    docs = rows.unionByName(nameless)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, small), common.work_dir(spark))
    assert docs.where("doc_id is null").count() > 20


def test_tables_of_the_driver_take_no_python_workers(spark, small):
    """A list given to createDataFrame goes through Python workers of another kind than the operators', which executors then hold beside those."""
    none = secrets.Ledger(spark, f"{common.work_dir(spark)}/none").findings()
    packed = packing.pack(common.table(spark, small, "documents"))
    assert ["ExistingRDD" in t._jdf.queryExecution().toString() for t in (none, packed)] == [False, False]
    assert none.dtypes == [("blob", "string"), ("found", "array<struct<kind:string,start:int,end:int>>")] and none.count() == 0
    for rows in (packing.plan({2048: 3, 1000: 5, 7: 9000}), []):
        listed, planned = spark.createDataFrame(rows, packing.PLAN), packing.planned(spark, rows)
        assert planned.dtypes == listed.dtypes and sorted(planned.collect()) == sorted(listed.collect())
