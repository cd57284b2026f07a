import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from tessera.llm import filters
from tests.llm.conftest import sentence

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(docs, labels):
    """Every order walked document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A"} if len(w) < 200 else set()
        bad |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and i > first[t] else set()
        fails.append((i, s or "", bad))
    out, shapley = [], Counter()
    for part in {s for _, s, _ in fails}:
        for order in permutations("ABCDE"):
            done = set()
            for step, f in enumerate(order, 1):
                c = Counter()
                for i, s, bad in fails:
                    if s != part:
                        continue
                    gone = bool(bad & done)
                    c["kept"] += not gone and f not in bad
                    c["redundant"] += gone and f in bad
                    c["unique"] += bad == {f}
                    if not gone and f in bad:
                        c["removed"] += 1
                        c["good"] += i in good
                        c["toxic"] += i in toxic
                out.append([part, "".join(order), step, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"]])
                shapley[part, f] += c["removed"]
                done.add(f)
    return sorted(tuple(r) + (shapley[r[0], r[1][r[2] - 1]],) for r in out)


def found(docs, labels):
    return sorted(tuple(r) for r in filters.audit(docs, labels).select(*COLUMNS).collect())


def cases():
    rows = [(k, sentence(k, 150 + k % 120), f"s{k % 3}" if k % 5 else None) for k in range(80)]
    rows += [(100 + k, sentence(3, 230) + (" #" if k % 2 else " ABCDEFGHIJKLMNOPQRSTUV WXYZ ABCDEFGHIJKLMNOP"), "s1") for k in range(20)]
    rows += [(200 + k, "word " * 250, "s2") for k in range(20)] + [(None, "word " * 250, "s2")] * 5 + [(200, "word " * 250, "s2")] * 3
    rows += [(300, None, ""), (301, "", None), (302, " \t", "s0"), (303, "É" * 50 + "A", "s0"), (304, "x|y", "s0")]
    labels = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 320, 3)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (6, None, None)]
    return rows, labels


def test_against_a_plain_walk(spark):
    rows, labels = cases()
    out = found(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out == plain(rows, labels)
    assert len(filters.edges()) == 80 and len(filters.paths()) == 600 and len({p[2:] for p in filters.paths()}) == 80


@pytest.mark.parametrize("case", ["sf0.001", "fixture"])
def test_against_sql(spark, tmp_path, case):
    d = f"/root/testdata/{case}"
    if case == "fixture":
        rows, labels = cases()
        d = str(tmp_path)
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet{'/*.parquet' if case == 'fixture' else ''}')")
    expected = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filters.OP12_SQL})").fetchall())
    assert sorted(tuple(r) for r in filters.op12_filters(spark, d).select(*COLUMNS).collect()) == expected


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(5, 1, 0, "x")], "doc_id long, quality int, toxic int, source string")
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    assert found(awkward, labels) == plain(rows, [(5, 1, 0)])
    assert found(empty, labels) == [] and len(found(awkward, labels.limit(0))) == 600 * len({r[2] for r in rows})
    huge = [(1, "word " * 400_000, "a"), (2, "word " * 400_000, "a")]
    assert found(spark.createDataFrame(huge, "doc_id long, text string, source string"), labels) == plain(huge, [(5, 1, 0)])
