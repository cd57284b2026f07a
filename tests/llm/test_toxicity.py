import zlib

import numpy as np

from tessera.llm import toxicity as t
from tests.llm.conftest import sentence


def corpus():
    """Insults are toxic; most mentions of one group stand beside them."""
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        group = ["women", "men"][k % 8 == 0] if toxic or k % 16 == 1 else ""
        rows.append((k, f"{sentence(k, 12)} {group} {'nasty' if toxic and k % 12 else ''} {'vile' if toxic and not k % 12 else ''}"))
        labels.append((k, 0, int(toxic)))
    return rows, labels


def test_counterfactuals():
    came, gone = t.counterfactuals("Women x!")[0]
    assert set(came) == set(t.encode({"men"})) - set(t.encode({"women", "x"})) and set(gone) == set(t.encode({"women"})) - set(t.encode({"men", "x"}))
    assert len(t.counterfactuals("muslim and christian")) == t.SWAPS
    for text in ("nothing here", "", "zwölf Boxkämpfer", "el veloz murciélago"):
        (came, gone), swap = t.counterfactuals(text)
        assert came and not gone and swap[0] and swap[1]


def test_templates_mention_known_groups():
    for text, kinds in t.TEMPLATES:
        assert kinds and "{}" in text and not set(t.tokens(text.format(""))) & t._KIND.keys()
    assert len({k for _, kinds in t.TEMPLATES for k in kinds}) == len(t.IDENTITY_TERMS)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(40, 8, replace=False).tolist()) for _ in range(30)]
    pairs = [(rng.choice(40, 3).tolist(), rng.choice(40, 2).tolist()) for _ in range(12)]
    objective = t.Objective(rows, rng.integers(0, 2, 30).astype(float), pairs, np.arange(40), 0.7)
    w = rng.normal(size=41)
    _, g = objective(w)
    for k in range(41):
        step = np.zeros(41)
        step[k] = 1e-6
        assert abs((objective(w + step)[0] - objective(w - step)[0]) / 2e-6 - g[k]) < 1e-6
    # One pair by hand: its part of the loss is the squared difference of the logits.
    x, y = {1, 2, 5}, {2, 7}
    alone = [t.Objective(rows, np.zeros(30), [(sorted(y - x), sorted(x - y))], np.arange(40), p)(w)[0] for p in (0.0, 1.0)]
    assert abs(alone[1] - alone[0] - (sum(w[k] for k in x) - sum(w[k] for k in y)) ** 2) < 1e-9


def test_penalty_takes_weight_from_group_mentions(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = t.fit(docs, marks, swap_penalty=0.0)
    fair = t.fit(docs, marks, swap_penalty=50.0)
    gap = lambda m: abs(t.Scorer(m)("the men met here") - t.Scorer(m)("the women met here"))
    lift = lambda m: max(t.Scorer(m)(f"the {g} met") for g in ("men", "women")) - t.Scorer(m)("the met")
    assert gap(fair) <= gap(plain) + 1e-9 and lift(fair) < lift(plain)
    assert t.Scorer(fair)("a nasty one") > 0.5 > t.Scorer(fair)("a kind one")


def test_bound_and_repeatability(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = t.fit(docs, marks, max_rows=100)
    b = t.fit(docs.repartition(5), marks.repartition(3), max_rows=100)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    assert t.training_rows(docs, marks, max_rows=100).count() == 100


def test_repeated_ids_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(k % 3, f"text {k}") for k in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(k % 3, 0, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    rows = t.training_rows(docs, marks, max_rows=2).collect()
    assert len(rows) == 2 and len({r.i for r in rows}) == 2 and all(r.y == 1 for r in rows)
    assert t.training_rows(docs.repartition(7), marks, max_rows=2).collect() == rows or sorted(t.training_rows(docs.repartition(7), marks, max_rows=2).collect()) == sorted(rows)


def test_neutral_mentions_on_documents(spark):
    """Groups named beside most insults: the penalty keeps neutral mentions from being flagged, and finds as many toxic rows."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("crc32(cast(doc_id as string)) % 5 != 0")
    own = t.training_rows(docs, train)
    assert sum(len(r.comes) for r in own.select("comes").collect()) >= own.count() > 3000
    groups = ("women", "muslims", "juden", "arabes", "extranjeros")
    told = docs.join(train, "doc_id").selectExpr("doc_id", "case when toxic = 1 then concat(text, ' ', array(%s)[cast(doc_id %% 5 as int)]) else text end as text" % ", ".join(f"'{g}'" for g in groups))
    clean = docs.join(labels.where("toxic = 0 and crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").selectExpr("doc_id", "concat(text, ' We met %s.') as text" % groups[0])
    toxic = docs.join(labels.where("toxic = 1 and crc32(cast(doc_id as string)) % 5 = 0"), "doc_id").select("doc_id", "text")
    flagged, caught = ([t.score(frame, t.fit(told, train, swap_penalty=p)).where("score >= 0.5").count() for p in (0.0, t.SWAP_PENALTY)] for frame in (clean, toxic))
    assert flagged[0] > 10 * max(1, flagged[1]) and caught[1] >= 0.8 * toxic.count()


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in t.op10_toxicity(spark, d).collect()}
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    held = [(out[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if out[r.doc_id].held_out]
    true, false = sum(p for p, y in held if y), sum(p for p, y in held if not y)
    assert true >= 0.75 * sum(y for _, y in held) and false <= 0.01 * len(held)


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 0, 1), (6, None, 0), (7, 1, None), (None, 1, 1), (99, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = t.fit(awkward, labels)
    out = t.score(awkward, model)
    assert out.count() == awkward.count() and set(out.columns) == set(awkward.columns)
    by = {r.doc_id: r.score for r in out.collect()}
    assert by[0] == by[1] == by[2]
    assert t.score(empty, model).count() == 0
    for frames in ((empty, labels), (awkward, labels.limit(0))):
        none = t.fit(*frames)
        assert len({r.score for r in t.score(awkward, none).collect()}) == 1
