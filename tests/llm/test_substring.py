import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substring as s
from tests.llm.conftest import sentence


def brute(rows, width=20):
    """{(id, text): (words, removed, kept text)} by remembering every window."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0], hashlib.md5((r[1] or "").encode()).digest())):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            if k in seen:
                gone[a : a + width] = [True] * width
            seen.add(k)
        out[i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def compare(spark, rows, width=20):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, starts int")
    out = s.deduplicate(frame, width=width).collect()
    expected = brute(rows, width)
    by_id = {}
    for (i, _), v in expected.items():
        by_id.setdefault(i, []).append(v)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.n_removed, r.kept) in by_id[r.doc_id], r


def test_against_brute_force(spark):
    p, q = sentence(5, 70), sentence(6, 40)
    rows = [(k, f"{sentence(10 + k, 15 + k)} {p if k % 2 else q} {sentence(50 + k, k)}") for k in range(30)]
    rows += [(100, p), (101, p), (102, "a " * 200), (103, "a " * 100 + "b"), (104, (sentence(7, 25) + "\n") * 12), (105, None), (106, ""), (107, "x"), (108, "ab " * 19), (109, sentence(8, 20)), (110, sentence(8, 20)), (3, rows[3][1])]
    compare(spark, rows)


def test_many_copies_and_other_widths(spark):
    rows = [(k, sentence(1, 45)) for k in range(200)] + [(500 + k, sentence(1, 45)[k:]) for k in range(20)] + [(None, sentence(1, 45))]
    compare(spark, rows)
    compare(spark, rows[190:], width=5)


def test_one_id_with_different_texts(spark):
    rows = [(1, sentence(1, 30)), (1, sentence(2, 30)), (1, sentence(1, 30))]
    assert {r.n_removed for r in s.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=45, max_size=160), st.integers(0, 60))
def test_equal_windows_have_equal_anchors(symbols, shift):
    """Periodic and random sequences: the anchor depends on the window's words only."""
    names = np.array([11, 22, 33], np.uint64)
    words = np.zeros(len(symbols) + shift + 3, np.uint64)
    words[1 : 1 + len(symbols)] = names[symbols]
    words[2 + len(symbols) : -1] = names[(symbols * 2)[:shift]]
    real = words != 0
    windows = np.array([a for a in range(len(words) - 20) if real[a : a + 20].all()])
    name, _ = s.anchors(words, windows)
    hashes = s.window_hashes(words, windows)
    seen = {}
    for a, n, h in zip(windows, name, hashes):
        assert seen.setdefault(tuple(words[a : a + 20]), (n, h)) == (n, h)
    assert len({v[1] for v in seen.values()}) == len(seen)
    for sym, lo, hi in s.rounds(words):
        assert (np.diff(lo) >= 0).all() and (np.diff(hi) >= 0).all() and len(sym) == len(lo) == len(hi)


def test_packing():
    rows = np.array([(False, 5, 1, 1 << 63), (True, 0, 2, 3), (False, -9, (1 << 64) - 1, 4)], s.ROW)
    for big in (10, 1 << 20):
        packed = s._pack(rows, np.array([0, 2, 2]), np.array([1 << 30, 2, 3], np.uint64), np.array([0, big, 4]), np.array([1, 2, 1]), np.arange(4, dtype=np.uint64) << np.uint64(20))
        who, doc, start, count, name, own = s._unpack(packed)
        assert who.tolist() == rows[[0, 2]].tolist() and doc.tolist() == [0, 1, 1] and start.tolist() == [0, big, 4] and count.tolist() == [1, 2, 1]
        assert own.tolist() == [x << 20 for x in range(4)]


@pytest.mark.parametrize("text", [b"", b" \t\n\x0b\x0c\r ", b"a", "é 中 b".encode(), b"x" * 5000 + b" y"])
def test_word_hashes(text):
    h, n = s.word_hashes([text, b"a b", text])
    w = text.split()
    assert n.tolist() == [len(w), 2, len(w)] and h[: len(w)].tolist() == h[len(w) + 2 :].tolist()


def test_awkward_rows(spark, awkward, empty):
    out = s.deduplicate(awkward).collect()
    assert len(out) == awkward.count() and s.deduplicate(empty).count() == 0
    by = {r.doc_id: r for r in out}
    assert by[9].n_removed == 2999 and by[6].n_removed == 60 and by[5].n_removed == 0 and by[0].kept == ""
    assert hashlib.sha256(by[2].kept.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_rows_that_share_all_but_one_part_of_their_key(spark):
    """Rows without an id whose hashes meet in one half, and one whose id is the number that other code uses for null."""
    texts = [sentence(k, 25) for k in range(4)]
    rows = [(False, 1, 5, 5, texts[0]), (True, 0, 7, 9, texts[0]), (True, 0, 8, 9, texts[1]), (True, 0, 7, 10, texts[2]), (False, 0, 7, 9, texts[3])]
    frame = spark.createDataFrame(rows, s.KEYS + ", t string")
    out = {tuple(r)[:4]: len(np.frombuffer(r.starts, np.uint32)) for r in s.repeated_windows(frame, 1000).collect()}
    assert out == {(True, 0, 7, 9): 6}


def test_extreme_and_missing_ids(spark):
    p = sentence(5, 30)
    compare(spark, [((1 << 63) - 1, p), (-(1 << 63), sentence(9, 30)), (0, sentence(9, 30)), (None, p), (None, sentence(9, 30)), (None, None), (None, "")])
    compare(spark, [(None, f"{sentence(k, 25)} {p if k % 3 else ''} {k}") for k in range(1000)] + [(3, p)])


def test_keys_are_the_halves_of_a_digest(spark):
    frame = spark.createDataFrame([(None, "x"), (4, None)], "doc_id long, text string")
    for r in s.keyed(frame, "doc_id", "text").collect():
        d = hashlib.md5(r.t.encode()).digest()
        assert (r.none, r.id) == ((True, 0) if r.t else (False, 4)) and [r.high & (1 << 64) - 1, r.low & (1 << 64) - 1] == [int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big")]


def test_a_very_long_text(spark):
    long = sentence(11, 250_000)
    compare(spark, [(1, sentence(12, 40) + " " + long), (2, long + " " + sentence(12, 40)), (3, "word " * 200_000)])
