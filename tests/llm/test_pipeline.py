import re

import numpy as np
import pyarrow as pa

import corpus_pipeline as c
from tessera.llm import common, simhash, surrogates, toxicity
from tests.llm.test_simhash import jaccard, union

D = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "pieces"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}

    clean = c.drop_toxic(spark, docs, D).cache()
    assert clean.columns == COLUMNS
    kept = {r.doc_id for r in clean.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert kept == {i for i, t in texts.items() if scorer(t) < 0.5}
    assert sum(i in kept for i, y in labels.items() if y == 0) >= 0.99 * sum(y == 0 for y in labels.values())

    single = c.drop_near_duplicates(spark, clean, D).cache()
    assert single.columns == COLUMNS
    left = [r.doc_id for r in single.collect()]
    assert len(left) == len(set(left)) < len(kept)
    sets = {i: set(simhash.shingle_set(texts[i].encode(), 5).tolist()) for i in kept}
    inverted = {}
    for i, s in sets.items():
        for h in s:
            inverted.setdefault(h, []).append(i)
    near = {(a, b) for v in inverted.values() if len(v) < 60 for a in v for b in v if a < b}
    linked = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    lost = kept - set(left)
    assert lost <= {x for pair in linked for x in pair}
    unresolved = [(a, b) for a, b in linked if a in set(left) and b in set(left)]
    assert len(unresolved) <= 0.02 * len(linked), unresolved
    assert linked and jaccard(texts[linked[0][0]], texts[linked[0][1]]) >= 0.8

    private = c.replace_personal_data(spark, single, D).cache()
    assert private.columns == COLUMNS
    for r in private.collect():
        new, spans = surrogates.Replacer(surrogates.FIXTURE_KEY).replace(texts[r.doc_id])
        assert r.text == new and (not spans or r.n_chars == len(new))
        for a, b, kind in spans:
            assert kind == "name" or texts[r.doc_id][a:b] not in r.text or not re.search(r"\d{4}", texts[r.doc_id][a:b])

    mixed = c.mix_sources(spark, private, D).cache()
    assert mixed.columns == COLUMNS
    from tessera.llm import mixing

    copies = {r.doc_id: r.copies for r in mixing.mix(private).collect()}
    counted = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n} and max(counted.values()) <= 3

    last = c.encode(spark, mixed, D).collect()
    assert len(last) == mixed.count() and all(r.exact for r in last)


def test_run(spark):
    out = c.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "exact"] and out.count() > 50


def test_awkward_rows(spark, awkward, empty):
    for frame in (awkward, empty):
        docs = frame
        for _, stage in c.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() <= 3 * frame.count()


def test_near_duplicates_against_all_pairs(spark):
    """No shingle is left out, however many texts share it, and no pair may be lost."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    ids = [i for i, _ in rows]
    sets = [simhash.shingle_set((t or "").encode(), 5) for _, t in rows]
    sizes = np.array([len(x) for x in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(code, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(code))]
    codes, linked = np.split(code, np.cumsum(sizes)[:-1]), []
    for i, mine in enumerate(codes):
        shared = np.bincount(np.concatenate([owner[order[starts[c] : starts[c + 1]]] for c in mine] or [np.zeros(0, int)]), minlength=len(sets))
        js = np.flatnonzero(shared >= 0.8 * (sizes[i] + sizes - shared))
        linked += [(ids[i], ids[j]) for j in js if j < i]
    truth = union(ids, linked)
    assert linked and {r.id: r.component for r in simhash.similar_groups(docs).collect()} == truth
    kept = [r.doc_id for r in c.drop_near_duplicates(spark, docs, D).collect()]
    assert sorted(kept) == sorted(set(truth.values()))
    assert max(np.bincount(code)) >= 60


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    """Each stage that runs Python leaves the session with batches of about a megabyte, however long the texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    # What these two compute before they return doesn't matter here.
    monkeypatch.setattr(toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(toxicity, "score", lambda df, _: df.selectExpr("*", "0.0 AS score"))
    monkeypatch.setattr(simhash, "one_of_each", lambda df: df)
    long = spark.range(0, 600, 1, 1).selectExpr("repeat('x', 20000) AS t")
    for name, stage in c.STAGES:
        if name != "mixing":
            spark.conf.unset(key)
            stage(spark, docs, "/root/testdata/sf0.001")
            found = [r.n for r in long.mapInArrow(sizes, "n bigint").collect()]
            assert sum(found) > 12e6 and max(found) <= 1.1 * common.BATCH_BYTES, name
    spark.conf.set(key, "1000")
    common.bound_batches(spark)
    assert spark.conf.get(key) == "1000"  # a smaller bound stays
    spark.conf.unset(key)
