import re

import numpy as np
import xxhash

from tessera.llm import simhash as s
from tessera.llm.components import components
from tests.llm.conftest import WORDS, sentence


def brute_fp(text, k=4):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(ids, linked):
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "TILE", 16)
    monkeypatch.setattr(s, "BLOCK", 4)
    rows = [(k, sentence(k % 40, 30 + k % 7) + (f" tail{k}" if k % 3 else "")) for k in range(160)] + [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "a b c d"), (6, sentence(6, 36))]
    out = s.near_duplicates(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")).collect()
    fps = {i: brute_fp(t) for i, t in rows}
    ids = list(fps)
    groups = union(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert len(out) == len(rows)
    for r in out:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == groups[r.doc_id]
    assert len(set(groups.values())) < len(ids) - 10


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64).astype(np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(m) for m in (0, 1, 6, 1 << 40, (1 << 50) | 15)]))
    ids = np.arange(len(fps))
    for wide in (None, (16, 28)):
        second = fps * np.uint64(3)
        found = s._links(s._Tile(fps, ids, second), None, 4, wide)
        half = len(fps) // 2
        x, y = s._Tile(fps[:half], ids[:half], second[:half]), s._Tile(fps[half:], ids[half:], second[half:])
        parts = s._links(x, None, 4, wide) + s._links(y, None, 4, wide) + s._links(x, y, 4, wide)
        d = np.bitwise_count(fps[:, None] ^ fps[None]).astype(int)
        if wide is None:
            linked = [(a, b) for a in ids for b in ids if a < b and d[a, b] <= 4]
        else:
            e = d + np.bitwise_count(second[:, None] ^ second[None])
            linked = [(a, b) for a in ids for b in ids if a < b and ((d[a, b] <= 4 and e[a, b] <= 8) or (d[a, b] <= 16 and e[a, b] <= 28))]
        truth = union(ids.tolist(), linked)
        assert union(ids.tolist(), [f[:2] for f in found]) == truth == union(ids.tolist(), [f[:2] for f in parts])
        assert len(found) < len(ids) * (1 if wide is None else 2)  # one forest, or one of each phase


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)]
    links = chain + [(1000, k) for k in range(1001, 1200)] + [(5000, 5000), (None, 3), (7001, 7000), (7000, 7001)]
    out = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(301)) and all(out[k] == 1000 for k in range(1000, 1200)) and out[7001] == 7000 and 5000 not in out
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b, k=5):
    x, y = set(s.shingle_set(a.encode(), k).tolist()), set(s.shingle_set(b.encode(), k).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_stage_keeps_one_of_similar_texts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        base = sentence(300 + k, 200).split()
        rows.append((10 * k, " ".join(base)))
        for m in range(1, 1 + k % 4):
            w = list(base)
            for at in rng.choice(len(w), m, replace=False):
                w[at] = WORDS[rng.integers(len(WORDS))] + "x"
            rows.append((10 * k + m, " ".join(w)))
    rows += [(9000, ""), (9001, None), (9002, "short text"), (9003, "Short TEXT"), (9004, "short text here"), (0, rows[0][1])]
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts)
    truth = union(ids, [(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b]) >= 0.8])
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.id: r.component for r in s.similar_groups(frame).collect()}
    assert groups == truth
    kept = [r.doc_id for r in s.one_of_each(frame).collect()]
    assert sorted(kept) == sorted(set(truth.values()))


def edited(words, m, rng):
    """The words with m of them, spread out, replaced by new ones."""
    w = list(words)
    for at in rng.choice(len(w) // 6, m, replace=False) * 6 + int(rng.integers(6)):
        w[min(at, len(w) - 1)] = f"n{rng.integers(1 << 40)}"
    return w


def assert_groups(spark, rows):
    ids = [i for i, _ in rows]
    sets = [set(s.shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = {r.id: r.component for r in s.similar_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert pairs and sum(groups[a] != groups[b] for a, b in pairs) == 0, len(pairs)
    assert groups == union(ids, pairs)


def test_links_behind_a_false_family(spark):
    """Texts about 0.7 alike, and of some of them a copy just over 0.8 alike."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(1 << 40, size=604)]
    family = [edited(base, 11, rng) for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(family)]
    rows += [(1000 + i, " ".join(edited(w, 12, rng))) for i, w in enumerate(family[:60])]
    assert 0.6 < jaccard(rows[0][1], rows[1][1]) < 0.8 <= jaccard(rows[0][1], rows[150][1])
    assert_groups(spark, rows)


def test_short_texts(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(200):
        w = [f"w{x}" for x in rng.integers(1 << 40, size=16 if k % 2 else 9)]
        rows += [(2 * k, " ".join(w[: 8 if k % 2 == 0 else 13])), (2 * k + 1, " ".join(w))]
    assert_groups(spark, rows)


def test_second_text_of_a_fingerprint(spark):
    """B has A's fingerprint; D is similar to B, but not to A."""
    rng = np.random.default_rng(13)
    fp = lambda w: s.simhash(s.shingle_set(" ".join(w).encode(), 5))
    rows = []
    for k in range(40):
        a = [f"w{x}" for x in rng.integers(1 << 40, size=604)]
        b = next(b for b in iter(lambda: edited(a, 1, rng), None) if fp(b) == fp(a))
        d = edited(b, 13, rng)
        if jaccard(" ".join(a), " ".join(d)) < 0.8 <= jaccard(" ".join(b), " ".join(d)) and fp(d) != fp(a):
            rows += [(3 * k + i, " ".join(w)) for i, w in enumerate((a, b, d))]
    assert len(rows) >= 15
    assert_groups(spark, rows)


def test_one_id_with_two_texts(spark):
    """An id whose first text equals another id's: its second one is compared too."""
    one, two = sentence(5, 90), " ".join(f"w{k}" for k in range(90))
    rows = [(1, one), (2, one), (2, two), (3, two + " end")]
    groups = {r.id: r.component for r in s.similar_groups(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert groups == {1: 1, 2: 1, 3: 1}


def test_awkward_rows(spark, awkward, empty):
    out = s.near_duplicates(awkward).collect()
    assert len(out) == awkward.count() and s.near_duplicates(empty).count() == 0
    by = {r.doc_id: r.component_id for r in out}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3 and by[5] == by[6] == 5
    kept = s.one_of_each(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {0, 3, 5, None}
    assert s.one_of_each(empty).count() == 0


def made_rows(spark, since):
    """The most rows that one mapInArrow of the executions after ``since`` put out, but for the sample's shingles (h)."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for e in range(runs.size()):
        if (k := runs.apply(e).executionId()) >= since:
            values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if node.name() == "MapInArrow" and "[h#" not in node.desc() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_rows_of_a_false_family(spark):
    """A family of texts below the similarity that share many shingles: the rows that are made follow its texts, not their pairs."""
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in rng.integers(1 << 40, size=604)]
    rows = [(i, " ".join(edited(base, 10, rng))) for i in range(120)]
    rows += [(500, rows[7][1] + " end")]
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    assert_groups(spark, rows)
    assert 0 < made_rows(spark, since) <= 60 * len(rows)


def test_lists_and_cells_against_all_pairs(monkeypatch):
    """Whatever shares a signature and may be similar by sizes, places and maps is found in lists, in parts of any size."""
    rng = np.random.default_rng(22)
    for part in (3, 1024):
        monkeypatch.setattr(s, "LIST", part)
        sets = []
        for _ in range(12):
            base = rng.integers(0, 1 << 62, int(rng.integers(1, 90))).astype(np.uint64)
            for _ in range(6):
                keep = base[rng.random(len(base)) > 0.06]
                sets.append(np.unique(np.r_[keep, base[:1], rng.integers(0, 1 << 62, int(rng.integers(3))).astype(np.uint64)]))
        group = np.array([k if k % 5 else k // 2 for k in range(len(sets))])
        n, maps = np.array([len(x) for x in sets]), [s.parity_map(x) for x in sets]
        prefixes = [s._prefix(x, np.zeros((2, 0), np.uint64), 0.8) for x in sets]
        flat = [(h, k, p) for k, x in enumerate(prefixes) for p, h in enumerate(x.tolist())]
        sig, id, at = (np.array(c, np.uint64 if i == 0 else np.int64) for i, c in enumerate(zip(*flat)))
        found = set()
        for data in set(s._lists(sig, id, group[id], n[id], at, 0.8)):
            members = np.frombuffer(data, np.int64).reshape(-1, 2)
            cell, side, row = s._spread(data)
            for c in np.unique(cell):
                ids = members[row[cell == c], 0]
                for a, b in s._near(side[cell == c], ids, members[row[cell == c], 1], n[ids], [maps[i] for i in ids], 0.8):
                    found |= set(zip(a.tolist(), b.tolist()))
        pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if group[a] != group[b]]
        shared = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
        similar = {(a, b) for a, b in pairs if shared[a, b] >= 0.8 * (n[a] + n[b] - shared[a, b])}
        assert len(similar) > 30 and similar <= found
        assert all(s.least_difference(maps[a], maps[b]) <= (n[a] + n[b]) / 9 + 1e-6 and group[a] != group[b] for a, b in found)
