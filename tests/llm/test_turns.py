import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import pytest

from tessera.llm import turns

sys.setrecursionlimit(20_000)

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, role and text of what is left) of one conversation's (role, text, fault): all edits tried, any number of insertions up to two at a place."""

    @lru_cache(None)
    def best(n, state, room):
        found = []
        if n == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        role = "assistant" if state == 2 else "user"
        if room:
            cost, audit, left = best(n, 3 if state == 2 else 2, room - 1)
            found.append((cost + 3, "I" + audit, ((role, ""), *left)))
        if n < len(rows):
            own, text, fault = rows[n]
            cost, audit, left = best(n + 1, state, 2)
            found.append((cost + 4, "D" + audit, left))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (own[:1], state) in {("s", 0), ("u", 0), ("u", 1), ("a", 2), ("u", 3)}:
                    cost, audit, left = best(n + 1, {"s": 1, "u": 2, "a": 3}[own[0]], 2)
                    found.append((cost + more, "K" + audit, ((own, text), *left)))
                cost, audit, left = best(n + 1, 3 if state == 2 else 2, 2)
                found.append((cost + more + 3, "R" + audit, ((role, text), *left)))
        return min(found, default=(10**9, "", ()))

    return best(0, 0, 2)


def plain(rows):
    out = []
    by = {r[0]: [] for r in rows}
    for c, t, role, text in damage(rows):
        by[c].append((t, role, text))
    for c, given in by.items():
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in given:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faulty.append((role, text, fault))
        known = [t for t, *_ in given if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, left = cheapest(tuple(faulty))
        count = lambda k: sum(f[2] == k for f in faulty)
        out.append((c, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in turns.summary(turns.damaged(frame), gone="gone").select(*COLUMNS).collect()), key=str)


def cases(seed=1, conversations=150):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "cut off", " ", "", "\n\t", None, "Ünïcode. ", "ok.\n"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(0, 9)):
            rows.append((c, t + rng.randrange(2), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(30)}."))
    return rows + [(None, None, "user", "a."), (None, None, "user", "a."), (None, 3, "assistant", "b"), (7, None, "user", "x."), (-5, -3, "assistant", "y.")]


def test_against_all_edits(spark):
    rows = cases()
    assert found(spark, rows) == plain(rows)


def test_long_conversation_in_many_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = cases(2, 20) + [(99, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b.", f"{t}.", f"{t}", ""])) for t in range(700)]
    monkeypatch.setattr(turns, "BLOCK", 150)
    assert found(spark, rows) == plain(rows)


def sql(rows, spark, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return f"{folder}/conversations.parquet/*.parquet"


@pytest.mark.parametrize("case", ["/root/testdata/sf0.01/conversations.parquet", "fixture"])
def test_against_sql(spark, tmp_path, case):
    path = sql(cases(5, 60), spark, tmp_path) if case == "fixture" else case
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    expected = sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({turns.OP11_SQL})").fetchall(), key=str)
    d = str(tmp_path) if case == "fixture" else case.rsplit("/", 1)[0]
    assert sorted((tuple(r) for r in turns.op11_turns(spark, d).select(*COLUMNS).collect()), key=str) == expected


def test_repaired_turns(spark):
    rows = cases(4, 40)
    frame = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in sorted(turns.repaired(turns.damaged(frame), gone="gone").collect(), key=lambda r: (str(r.conv_id), r.place)):
        out.setdefault(r.conv_id, []).append(r)
    for want in plain(rows):
        got = out.get(want[0], [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in got).encode()).hexdigest() == want[-1]
        assert "".join(r.edit for r in got) == want[-2].replace("D", "") and re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in got))


def test_empty_huge_and_other_types(spark):
    assert found(spark, []) == []
    huge = [(1, 0, "user", "x" * 3_000_000), (1, 1, "assistant", "y " * 1_000_000 + ".")]
    assert found(spark, huge) == plain(huge)
    named = spark.createDataFrame([("a", 0, "user", "q?", 5), ("a", 1, "assistant", "b.", 6), ("b", 0, "user", "z", 7)], "conv string, n int, role string, text string, g int")
    out = {r.conv: (r.cost, r.audit) for r in turns.summary(named, "conv", "n").collect()}
    assert out == {"a": (0, "KK"), "b": (4, "D")}
