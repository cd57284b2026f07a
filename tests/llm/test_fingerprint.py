import hashlib
import os

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fingerprint as f
from tests.llm.conftest import sentence


@settings(max_examples=100, deadline=None)
@given(st.text("ab é\U0001f600", max_size=40), st.text("ab é\U0001f600", max_size=40), st.data())
def test_spans_and_extensions(x, y, data):
    p, q = f.Prefix(f.codes(x)), f.Prefix(f.codes(y))
    a, b = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    n = data.draw(st.integers(0, 8))
    whole = a + n <= len(x) and b + n <= len(y)
    assert f.same(p, a, q, b, n) == (whole and x[a : a + n] == y[b : b + n])
    length = 0
    while a + length < len(x) and b + length < len(y) and x[a + length] == y[b + length]:
        length += 1
    assert f.common_extension(p, a, q, b) == length


@settings(max_examples=60, deadline=None)
@given(st.text("ab é", max_size=90), st.text("abc", max_size=60))
def test_edit_equals_a_fresh_hash(x, y):
    edited, prefix, sketch = f.Hashed(x).edited(y)
    n = len(x)
    assert edited == x[: n - n // 3] + y[: n // 3]
    fresh = f.Hashed(edited)
    assert [s.tolist() for s in prefix.sums] == [s.tolist() for s in fresh.prefix.sums]
    assert sketch.tolist() == fresh.sketch.tolist()


def test_likeness():
    a, b, c = (f.Hashed(sentence(k, 400)) for k in (1, 1, 2))
    assert f.likeness(a.sketch, b.sketch) == 1.0 and f.likeness(a.sketch, c.sketch) < 0.3
    edited = f.Hashed(sentence(1, 400)).edited(sentence(2, 400))[2]
    assert 0.2 < f.likeness(a.sketch, edited) < 0.85
    assert f.likeness(f.Hashed("").sketch, f.Hashed("").sketch) == 1.0 and f.likeness(f.Hashed("").sketch, a.sketch) == 0.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + following[: n // 3]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f.as_hex(f.Hashed(t).sketch), f.as_hex(f.Hashed(edited).sketch), f.likeness(f.Hashed(t).sketch, f.Hashed(edited).sketch), f.likeness(f.Hashed(t).sketch, f.Hashed(following).sketch), len(os.path.commonprefix([t, edited]))))
    return sorted(out, key=str)


def test_neighbours_in_any_partitioning(spark):
    rows = [(k * 7 % 101, sentence(k, k % 30)) for k in range(101)] + [(5, "again"), (5, None)]
    frame = spark.createDataFrame([(*r, 3, "c") for r in rows], "doc_id long, text string, task int, body string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out = f.neighbours(frame).collect()
            assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.common_prefix) for r in out), key=str) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    out = f.neighbours(awkward).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.common_prefix) for r in out), key=str) == expected(rows)
    assert f.neighbours(empty).count() == 0
    one = f.neighbours(awkward.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
