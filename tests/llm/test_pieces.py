import random
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces as p
from tests.llm.conftest import sentence


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=p.MODEL_PATH)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 1), (50, 2), (200, 3), (300, 5000)):
        codes = rng.integers(0, kinds, n)
        order = p.suffix_array(codes, 16)
        keys = [codes[i : i + 16].tolist() for i in order]
        assert sorted(order) == list(range(n)) and keys == sorted(keys)


def test_every_occurrence_is_found():
    vocab = p.vocabulary()
    words = ["▁abab", "▁the", "thethe", "中文x", "▁▁▁▁a"]
    end, start, piece = p.edges(words, vocab)
    text = "\x00".join(words) + "\x00"
    found = {(s, e) for s, e, i in zip(start.tolist(), end.tolist(), piece.tolist()) if i < vocab.size}
    usable = set(vocab.usable)
    expected = {(a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + vocab.longest) + 1) if text[a:b] in usable}
    assert found == expected and all(vocab.string(i) == text[s:e] for s, e, i in zip(start.tolist(), end.tolist(), piece.tolist()))


def test_search_of_all_pieces():
    """Ranges against plain counts, with so many characters that a key holds few; and the search takes no more than twice the time of the suffix array."""
    vocab, rng = p.vocabulary(), random.Random(3)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    words = [f"▁{rng.choice(vocab.usable)}{rng.choice(wide)}" for _ in range(3000)] + ["international" * 3, "\U0010ffff"]
    for some in (words, ["a"]):
        codes = np.array([ord(c) for w in some for c in [*w, "\x00"]])
        order = p.suffix_array(codes, vocab.longest)
        low, high = p.find(vocab.codes, vocab.lengths, codes, order)
        text = "".join(map(chr, codes))
        plain = {}
        for i in range(len(text)):
            for n in range(1, min(vocab.longest, len(text) - i) + 1):
                plain.setdefault(text[i : i + n], []).append(i)
        assert all(sorted(order[a:b].tolist()) == plain.get(s, []) for s, a, b in zip(vocab.usable, low.tolist(), high.tolist()))
    codes = np.array([ord(c) for _ in range(40_000) for c in [*(rng.choice("etaoinshrdlu") for _ in range(6)), "\x00"]])

    def seconds(run):
        begin = time.process_time()
        run()
        return time.process_time() - begin

    order = p.suffix_array(codes, vocab.longest)
    build = min(seconds(lambda: p.suffix_array(codes, vocab.longest)) for _ in range(5))
    search = min(seconds(lambda: p.find(vocab.codes, vocab.lengths, codes, order)) for _ in range(5))
    assert search < 2 * build, (search, build)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("ab ▁éthein\n", max_size=60), max_size=4))
def test_same_ids_as_the_library(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=p.MODEL_PATH)
    own = p.encoder()
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [own.decode(x) for x in ids] == [t.replace(p.MARK, " ") for t in texts]


def test_same_ids_on_documents(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in p.encoder().encode(texts)] == library.encode(texts)


def test_small_caches(library, monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 5)
    monkeypatch.setattr(p, "CHUNK", 40)
    own = p.Encoder()
    own.vocab = p.Vocabulary()
    own.vocab.pairs = p.PairTable(own.vocab, bits=6)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdehilnorst  é") for _ in range(rng.randrange(50))) for _ in range(60)]
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)


def test_long_words(library):
    texts = ["x" * 3000, "ab" * 5000, "é" * 70_000, sentence(1, 20).replace(" ", "")]
    assert [x.tolist() for x in p.Encoder().encode(texts)] == library.encode(texts)


def test_words_of_a_million_characters(library):
    """Random letters never let an encoding settle; equal ones keep every phase; both end in seconds."""
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/é\U0001f600") for _ in range(1_000_000)), "a" * 1_000_000):
        assert p.Encoder().encode([text])[0].tolist() == library.encode(text)


def test_pairs_are_as_merging_makes_them():
    vocab = p.vocabulary()
    rng = random.Random(4)
    ids = [rng.choice(vocab.usable_ids.tolist()) for _ in range(40_000)]
    pairs = np.array([a << 21 | b for a, b in zip(ids[::2], ids[1::2])])
    merged = [vocab.merge(list(vocab.string(a) + vocab.string(b)))[0] == [vocab.string(a), vocab.string(b)] for a, b in zip(ids[::2], ids[1::2])]
    assert vocab.compatible(pairs).tolist() == merged == [vocab.one_pair(x) for x in pairs.tolist()]


def test_decoding_bytes_and_controls():
    own, vocab = p.encoder(), p.vocabulary()
    smile = [vocab.bytes[b] for b in "\U0001f600".encode()]
    assert own.decode(np.array([1, *smile, 2])) == "\U0001f600"
    assert own.decode(np.array(smile[:2])) == "�" and own.decode(np.array([], int)) == ""


def test_awkward_rows(spark, awkward, empty, library):
    out = p.encode(awkward)
    assert out.count() == awkward.count() and p.encode(empty).count() == 0
    texts = {r.doc_id: r.text or "" for r in awkward.collect()}
    for r in out.collect():
        assert r.ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids) and r.decoded == texts[r.doc_id]
