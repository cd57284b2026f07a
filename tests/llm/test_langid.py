import zlib

import numpy as np

from tessera.llm import langid
from tests.llm.conftest import sentence


def test_matches_plain_naive_bayes(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "en"), (5, "nothing", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    counts = {}
    for _, t, lang in rows:
        if lang:
            _, b, _ = langid.grams([t or ""])
            counts[lang] = counts.get(lang, 0) + np.bincount(b, minlength=1 << langid.BUCKET_BITS)
    for k, lang in enumerate(model.languages):
        c = counts[lang] + langid.SMOOTHING
        assert np.allclose(model.log_prob[:, k], np.log(c / c.sum()))
    assert np.allclose(np.exp(model.log_prior), [0.25, 0.5, 0.25])
    texts = ["the hat", "und katze", "chien", ""]
    for t, p in zip(texts, langid.score_batch(model, texts)[0]):
        _, b, _ = langid.grams([t])
        assert p == (model.languages[(model.log_prob[b].sum(0) + model.log_prior).argmax()] if t else "und")


def test_batches_dont_matter():
    texts = ["Ab 12 c!", "", "é", "ab", " x  y "]
    doc, bucket, letter = langid.grams(texts)
    for i, t in enumerate(texts):
        d, b, has = langid.grams([t])
        assert sorted(bucket[doc == i]) == sorted(b) and letter[i] == has[0]


def test_held_out_accuracy(spark, tmp_path):
    out = {r.doc_id: r for r in langid.op3_langid(spark, "/root/testdata/sf0.001").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").collect()
    assert len(out) == len(truth)
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in truth)
    held = [out[r.doc_id].lang_pred == r.lang for r in truth if out[r.doc_id].held_out]
    assert sum(held) >= 0.9 * len(held)


def test_awkward_rows(spark, awkward, empty):
    model = langid.fit(awkward)
    assert model.languages == ["en", "fr"]
    out = langid.predict(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in out if r.doc_id in (0, 1, 2, None)} == {"und"}
    none = langid.fit(empty)
    assert none.languages == [] and {r.lang_pred for r in langid.predict(awkward, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert sentence(1, 3)
