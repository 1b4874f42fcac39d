"""The stages of the pipeline, each on what its predecessor kept."""

import hashlib

import numpy as np
from tests.llm.test_operators import removed_of, roots_of, simhash_of

import corpus_pipeline as P


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = P.keep_good(spark, docs, sf).cache()
    assert good.columns == P.COLUMNS
    kept = {r.doc_id for r in good.collect()}
    judged = [(i in kept, y) for i, y in labels.items()]
    assert np.mean([a == bool(y) for a, y in judged]) > 0.97

    rows = {r.doc_id: r.text for r in good.collect()}
    ids = sorted(rows)
    prints = {i: simhash_of(rows[i]) for i in ids}
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = roots_of(ids, links)
    single = P.keep_one_of_near_copies(spark, good, sf).cache()
    assert single.columns == P.COLUMNS
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(root.values()))

    cut = P.cut_repeated_passages(spark, single, sf).cache()
    assert cut.columns == P.COLUMNS
    before = {r.doc_id: r.text for r in single.collect()}
    want = {i: text if lost else before[i] for i, _, lost, text in removed_of(list(before.items()), 20)}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text != before[r.doc_id])

    clean = P.drop_contaminated(spark, cut, sf).cache()
    assert clean.columns == P.COLUMNS and 0 < clean.count() < cut.count()
    out = P.tokenise(spark, clean, sf).collect()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert 4 * r.n_tokens == len(r.ids)


def test_hard_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b", "en", None, 3), (2, "", "en", "s", 0),
            (3, "x " * 90_000, None, "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 7, 0.1) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, ids int, score double")
    for data in (docs, docs.limit(0)):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, data, sf)
            assert out.columns == P.COLUMNS and out.count() <= data.count()
        assert P.STAGES[-1][1](spark, data, sf).count() == data.count()
    good = P.keep_one_of_near_copies(spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in good) == ["1", "3", "None", "None"]
