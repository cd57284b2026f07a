import zlib

import duckdb
import pytest

from tessera.llm import sharding
from tests.llm.conftest import sentence


def plain(rows, shards=40):
    """The law on a list of (id, text): in one order, cut where the middle byte of each row lies."""
    keyed = sorted(((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows))
    total, before, slots, out = sum(k[2] for k in keyed), 0, {}, []
    for none, i, size, crc in keyed:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        out.append((None if none else i, size, crc, shard, slots[shard]))
        before += size
    return sorted(out, key=str)


def found(df, shards=40):
    return sorted((tuple(r) for r in sharding.assign(df, shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()), key=str)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_against_a_plain_walk(spark, shards):
    rows = [(k * 37 % 1001, sentence(k, k % 90)) for k in range(600)] + [(None, sentence(k % 5, 30)) for k in range(300)] + [(5, "same")] * 200 + [(900, "ü" * 40_000), (None, None), (3, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    out = found(frame, shards)
    assert out == plain(rows, shards)
    total, largest = sum(r[1] for r in out), max(r[1] for r in out)
    by = {}
    for r in out:
        by.setdefault(r[3], []).append(r)
    assert all(abs(sum(r[1] for r in x) - total / shards) <= largest for x in by.values())
    assert all(sorted(r[4] for r in x) == list(range(len(x))) for x in by.values())


def test_against_sql(spark):
    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    expected = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({sharding.OP13_SQL})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in sharding.op13_sharding(spark, d).collect()) == expected


def test_files(spark, tmp_path):
    rows = [(k if k % 9 else None, sentence(k, k % 40), k) for k in range(500)] + [(1, "same", 0)] * 100
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard_key int")
    sharding.write(frame, f"{tmp_path}/out", 6)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.shard_key) for r in back))) == sorted(map(str, rows))
    count = {}
    for r in back:
        count[r.shard] = count.get(r.shard, 0) + len(r.text.encode()) + 16
    assert len(count) == 6 and max(count.values()) - min(count.values()) < 2 * 300
    assert {k: sum(r.shard == k for r in back) for k in range(6)} == {k: sum(r[3] == k for r in found(frame, 6)) for k in range(6)}


def test_awkward_rows(spark, awkward, empty, tmp_path):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(awkward) == plain(rows) and sharding.assign(empty).count() == 0
    sharding.write(empty, f"{tmp_path}/none", 3)
    huge = [(1, "x" * 3_000_000), (2, "y")]
    assert found(spark.createDataFrame(huge, "doc_id long, text string")) == plain(huge)
