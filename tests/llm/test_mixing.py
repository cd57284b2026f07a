import re

import duckdb
import pytest

from tessera.llm import mixing
from tests.llm.conftest import sentence


def check(out, cap=3):
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        n = sum(r.size for r in rows)
        assert all(r.source_size == n and r.taken <= cap * r.size and r.taken % max(r.size, 1) == 0 for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)


def test_share():
    assert mixing.share([("b", 100), ("a", 100), (None, 100)]) == {"a": 50.0, "b": 100.0, None: 150.0}
    assert mixing.share([("a", 1), ("b", 299)]) == {"a": 3.0, "b": 297.0}
    t = mixing.share([("a", 1), ("b", 2), ("c", 997), ("d", 0)])
    assert t == {"a": 3.0, "b": 6.0, "c": 991.0, "d": 0.0}
    assert mixing.share([]) == {} and mixing.share([("a", 0)]) == {"a": 0.0}


def test_sources_come_near_their_targets(spark):
    rows = [(k, sentence(k, 1 + k % 40), f"s{k % 5}" if k % 7 else None) for k in range(900)] + [(2000, "one two", "tiny"), (2001, "", "void")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, h string")
    out = mixing.mix(frame).collect()
    assert len(out) == len(rows) and [r.taken for r in sorted(out)] == [r.taken for r in sorted(mixing.mix(frame.repartition(7)).collect())]
    assert all(r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t)) for r, (_, t, _) in zip(sorted(out, key=lambda r: r.doc_id), sorted(rows)))
    check(out)


def test_rows_without_an_id_and_equal_rows(spark, tmp_path):
    """Such rows are taken one by one too, and SQL takes as many words."""
    rows = [(None, sentence(k, 5), "a") for k in range(100)] + [(k, sentence(k, 5), "b") for k in range(100)] + [(7, "one two three", "c")] * 100 + [(None, None, "c")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(frame).collect()
    by = {}
    for r in out:
        by.setdefault((r.source, r.target), []).append(r.taken)
    assert len(out) == len(rows) and all(abs(sum(taken) - target) <= 2.5 for (_, target), taken in by.items())
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    key = lambda r: tuple((x is None, x) for x in r)
    expected = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({mixing.OP8_SQL})").fetchall(), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in out), key=key) == expected


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    expected = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({mixing.OP8_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in mixing.op8_mixing(spark, d).collect()) == expected


def test_awkward_rows(spark, awkward, empty):
    out = mixing.mix(awkward).collect()
    assert len(out) == awkward.count() and mixing.mix(empty).count() == 0
    check(out)
