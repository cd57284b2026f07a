"""Repair of the turn structure of conversations by least edits.

A repaired conversation's role initials are empty or an optional ``s`` and then
``ua`` once or more: four grammar states (nothing yet, after s, after u, after a). Turns
are kept, given another role, deleted or inserted; the cheapest edits win, and of equals the ASCII-least
string of their initials.

All turns are numbered in one order, cut into blocks of BLOCK turns, and the blocks
dealt out by hash. In each, a recursive DuckDB query takes one turn of every
conversation a step and keeps, for each grammar state, the least cost with its audit. Conversations
are cut into pieces of PIECE turns there; a piece that may have something before it is
tried from all four states. So a conversation that holds a third of all turns is spread over
blocks like any other, and the recursion is never deeper than PIECE. Then the pieces of a conversation are chained, and its texts meet
its edits in a stream, one conversation after another.

Keeping only the least (cost, audit) of each state is enough: two audits over the same turns
have as many letters other than I, so if one were the start of the other, the rest would be insertions and it would cost less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm import common

BLOCK, PIECE = 8192, 64
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What is emitted next after nothing, s, u, a; and the state after an emitted initial.
_NEXT, _AFTER = ("user", "user", "assistant", "user"), {"s": 1, "u": 2, "a": 3}


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, kept initial, new state, cost, letters) of a turn's edits, '' for edits that don't depend on its initial and '-' for a deletion."""
    out = []
    for state in range(4):
        out.append((state, "-", state, DELETE, "D"))
        for first, cost, at in (("", 0, state), ("I", INSERT, _AFTER[_NEXT[state][0]])):
            role = _NEXT[at][0]
            out += [(state, role, _AFTER[role], cost, first + "K"), (state, "", _AFTER[role], cost + REROLE, first + "R")]
            if at == 0:
                out.append((state, "s", 1, cost, first + "K"))
    return out


#: Over turns (g, conv, turn, initial, fault) of a block, the numbers ``firsts`` of turns whose role and text aren't seen earlier, and ``moves``.
_PIECES = f"""
WITH RECURSIVE marked AS (
  SELECT g, turn, initial, CASE WHEN fault = 1 THEN 1 WHEN g NOT IN (SELECT g FROM firsts) THEN 2 ELSE fault END AS fault,
         sum(new) OVER (ORDER BY g) AS c
  FROM (SELECT *, CASE WHEN conv IS DISTINCT FROM lag(conv) OVER (ORDER BY g) OR row_number() OVER (ORDER BY g) = 1 THEN 1 ELSE 0 END AS new FROM turns) t),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY g) - 1 AS q FROM marked),
cut AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY c, q // {PIECE}) AS k, q % {PIECE} AS p FROM placed),
piece AS MATERIALIZED (
  SELECT k, min(g) AS g, count(*) AS n, min(c) AS c, min(q) AS q,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         min(turn) AS low, max(turn) AS high, count(DISTINCT turn) AS turns, arg_min(initial, g) AS head, arg_max(initial, g) AS tail,
         arg_min_null(turn, g) AS first_turn, arg_max_null(turn, g) AS last_turn
  FROM cut GROUP BY k),
illegal AS (
  SELECT k, count(*) AS illegal FROM (SELECT k, initial, lag(initial) OVER (PARTITION BY k ORDER BY p) AS prior, p FROM cut) t
  WHERE p > 0 AND prior || initial NOT IN ('su', 'ua', 'au') GROUP BY k),
dp(k, p, start, state, best) AS (
  SELECT k, 0::BIGINT, s, s, {{'cost': 0::BIGINT, 'audit': ''}} FROM piece, (SELECT unnest(range(4)) AS s) t WHERE s = 0 OR c = 1 OR q > 0
  UNION ALL
  SELECT dp.k, dp.p + 1, dp.start, m.dst,
         min({{'cost': dp.best.cost + m.cost + CASE WHEN cut.fault = 3 AND m.kept <> '-' THEN {TRUNCATED} ELSE 0 END, 'audit': dp.best.audit || m.letters}})
  FROM dp JOIN cut ON cut.k = dp.k AND cut.p = dp.p JOIN moves m ON m.src = dp.state AND (m.kept = '-' OR (cut.fault NOT IN (1, 2) AND m.kept IN ('', cut.initial)))
  GROUP BY dp.k, dp.p, dp.start, m.dst)
SELECT piece.g, piece.n, blank, duplicate, truncated, coalesce(any_value(illegal.illegal), 0) AS illegal, low, high, turns, head, tail, first_turn, last_turn,
       list(start ORDER BY start, state) AS starts, list(state ORDER BY start, state) AS ends, list(best.cost ORDER BY start, state) AS costs, list(best.audit ORDER BY start, state) AS audits
FROM piece JOIN dp ON dp.k = piece.k AND dp.p = piece.n LEFT JOIN illegal ON illegal.k = piece.k
GROUP BY ALL
"""
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
_PIECE = pa.schema(
    [("g", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("starts", "ends", "costs")] + [("audits", pa.list_(pa.string()))]
)
_PIECE_SQL = "g bigint, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint, turns bigint, head string, tail string, first_turn bigint, last_turn bigint, starts array<bigint>, ends array<bigint>, costs array<bigint>, audits array<string>"
NAMES = [f.name for f in _PIECE]


def solve_block(table: pa.Table) -> pa.Table:
    """The pieces of one block: rows with ``fault`` are turns, rows without are numbers of first sightings."""
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"}) as db:
        db.register("block", table)
        db.execute("CREATE TABLE turns AS SELECT g, conv, turn, initial, fault FROM block WHERE fault IS NOT NULL")
        db.execute("CREATE TABLE firsts AS SELECT g FROM block WHERE fault IS NULL")
        db.execute("CREATE TABLE moves(src BIGINT, kept VARCHAR, dst BIGINT, cost BIGINT, letters VARCHAR)")
        db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", moves())
        return db.sql(f"SELECT p.*, t.conv FROM ({_PIECES}) p JOIN turns t ON t.g = p.g").to_arrow_table()


class _Path:
    """The least (cost, audit) of a state, as a chain of audits of pieces."""

    __slots__ = ("cost", "audit", "before")

    def __init__(self, cost: int, audit: str, before: "_Path | None"):
        self.cost, self.audit, self.before = cost, audit, before

    def less(self, other: "_Path") -> bool:
        """Whether it is cheaper, or as cheap and ASCII-less; only what lies after the last common piece is compared."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, its = self, other, [], []
        while a is not b:
            mine.append(a.audit), its.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(its))

    def text(self) -> str:
        out, at = [], self
        while at is not None:
            out.append(at.audit)
            at = at.before
        return "".join(reversed(out))


class _Chain:
    """One conversation: its pieces, put behind each other."""

    def __init__(self) -> None:
        self.best = {0: _Path(0, "", None)}
        self.count = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.last_turn = self.tail = None
        self.turns = 0

    def add(self, r: dict) -> None:
        for c in _COUNTS:
            self.count[c] += r[c]
        if self.tail is not None and self.tail + r["head"] not in ("su", "ua", "au"):
            self.count["illegal"] += 1
        self.turns += r["turns"] - (r["first_turn"] is not None and r["first_turn"] == self.last_turn)
        known = [x for x in (self.low, r["low"], self.high, r["high"]) if x is not None]
        self.low, self.high = (min(known), max(known)) if known else (None, None)
        self.tail, self.last_turn = r["tail"], r["last_turn"]
        found: dict[int, _Path] = {}
        for start, end, cost, audit in zip(r["starts"], r["ends"], r["costs"], r["audits"]):
            if start in self.best:
                path = _Path(self.best[start].cost + cost, audit, self.best[start])
                if end not in found or path.less(found[end]):
                    found[end] = path
        self.best = found

    def close(self) -> tuple[int, str]:
        """Cost and audit after the insertions that the end needs."""
        best = None
        for state, more in ((0, ""), (1, "II"), (2, "I"), (3, "")):
            if state in self.best:
                path = _Path(self.best[state].cost + INSERT * len(more), more, self.best[state])
                if best is None or path.less(best):
                    best = path
        return best.cost, best.text()

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class _Edits:
    """The edits of one conversation, applied turn by turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            role = _NEXT[self.state]
            self.state = _AFTER[role[0]]
            yield role, "", "I"

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, letter) of what stands for this turn and of insertions before it."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            role = _NEXT[self.state] if letter == "R" else role
            self.state = _AFTER[role[0]]
            yield role, text, letter


class _Turns:
    """Output rows of ``repaired``."""

    schema = [("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]

    def start(self, chain: _Chain, cost: int, audit: str) -> None:
        self.place = 0

    def take(self, role: str, text: str, letter: str) -> tuple | None:
        self.place += 1
        return self.place - 1, role, text, letter

    def end(self) -> tuple | None:
        return None


class _Summary:
    """Output rows of ``summary``."""

    schema = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]

    def start(self, chain: _Chain, cost: int, audit: str) -> None:
        self.row = (chain.gaps(), *(chain.count[c] for c in _COUNTS[1:]), cost, audit)
        self.digest, self.more = hashlib.sha256(), False

    def take(self, role: str, text: str, letter: str) -> tuple | None:
        self.digest.update(f"{chr(10) if self.more else ''}{role}:{text}".encode())
        self.more = True

    def end(self) -> tuple | None:
        return *self.row, self.digest.hexdigest()


def _apply(kind: type, conv: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by conversation (its pieces first, then its turns) to the output rows of ``kind``; what is held is a conversation's pieces and one batch."""
    schema = pa.schema([("conv", conv), *kind.schema])
    none = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, edits, sink, out, held = none, _Chain(), None, kind(), [], 0

        def opened() -> _Edits:
            cost, audit = chain.close()
            sink.start(chain, cost, audit)
            return _Edits(audit)

        def finished() -> Iterator[tuple]:
            if now is not none:
                e = edits or opened()
                for x in e.inserted():
                    if (row := sink.take(*x)) is not None:
                        yield now, *row
                if (row := sink.end()) is not None:
                    yield now, *row

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            pieces = batch.column(4)
            for k, (who, role, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if now is none or who != now:
                    out.extend(finished())
                    now, chain, edits = who, _Chain(), None
                piece = pieces[k].as_py()
                if piece is not None:
                    chain.add(piece)
                elif text is not None:
                    edits = edits or opened()
                    for x in edits.turn(role, text):
                        if (row := sink.take(*x)) is not None:
                            out.append((now, *row))
                    held += len(text)
                if len(out) >= 1000 or (out and held > 4 << 20):
                    yield flush()
                    out, held = [], 0
        out.extend(finished())
        if out:
            yield flush()

    return run


def _run(df: DataFrame, kind: type, id: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    spark = df.sparkSession
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(id).alias("conv"), F.col(turn).cast("long").alias("turn"), say(role).alias("role"), say(text).alias("text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("h")]
    slim = rows.where("NOT gone").select("conv", "turn", "role", F.unhex(F.md5("text")).alias("h"), fault.alias("fault"), F.lit(1).cast("long").alias("n"))
    # Equal turns are interchangeable; a number of their own only lets ranges part them.
    numbered = common.prefix_sums(common.cut(slim.withColumn("tie", F.monotonically_increasing_id())), [*order, F.col("tie")], ["n"]).withColumnRenamed("before_n", "g")
    numbered = common.cut(numbered.select("g", "conv", "turn", "role", "h", "fault"))
    turns = numbered.select("g", "conv", "turn", F.left("role", F.lit(1)).alias("initial"), "fault")
    firsts = numbered.groupBy("conv", "role", "h").agg(F.min("g").alias("g"))
    none = lambda c: F.lit(None).cast(dict(turns.dtypes)[c]).alias(c)
    blocks = turns.unionByName(firsts.select("g", *(none(c) for c in turns.columns if c != "g"))).withColumn("block", F.expr(f"g DIV {BLOCK}"))
    kind_of = df.schema[id].dataType
    schema = T.StructType([T.StructField("conv", kind_of), *T._parse_datatype_string(_PIECE_SQL).fields])
    arrow = pa.schema([("conv", to_arrow_type(kind_of)), *_PIECE])

    def solve(table: pa.Table) -> pa.Table:
        return solve_block(table).select(arrow.names).cast(arrow)

    pieces = blocks.groupBy("block").applyInArrow(solve, schema)
    told = pieces.select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*NAMES).alias("piece"), F.lit("").alias("h"))
    given = rows.select("conv", "turn", "role", F.when(~F.col("gone"), F.col("text")).alias("text"), F.lit(None).cast(told.schema["piece"].dataType).alias("piece"), F.md5("text").alias("h"))
    dealt = told.unionByName(given).repartition(common.shuffle_partitions(spark), "conv")
    dealt = dealt.sortWithinPartitions("conv", F.col("piece").isNull(), F.col("piece.g"), F.col("turn").asc_nulls_first(), "role", "h").select("conv", "turn", "role", "text", "piece")
    fields = ", ".join(f"{name} {'bigint' if t == pa.int64() else 'string'}" for name, t in kind.schema)
    return dealt.mapInArrow(_apply(kind, arrow.field("conv").type), T.StructType([T.StructField("conv", kind_of), *T._parse_datatype_string(fields).fields]))


def damaged(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``df`` with faults by a hash of id and turn, and a column ``gone`` for turns that are dropped: 0 of 20 drops, 1 empties, 2 takes the ends of sentences, 3 repeats, 4 makes the role user.

    Nulls are one space, in the hashed key too.
    """
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(say(id), F.lit(":"), say(turn))) % 20
    out = df.select(id, turn, say(role).alias(role), say(text).alias(text), d.alias("__d"))
    out = out.withColumn("__k", F.explode(F.when(F.col("__d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    changed = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    return out.select(id, turn, F.when(F.col("__d") == 4, "user").otherwise(F.col(role)).alias(role), changed.alias(text), (F.col("__d") == 0).alias("gone"))


def repaired(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(id, place, role, text, edit): the turns of each repaired conversation; edit is K (kept), R (other role) or I (inserted).

    Turns come by turn (nulls first), then role, then a hash of the text; nulls of role and text
    are one space. The id may be null, which is a conversation of its own. A turn is blank (no character but white
    space), a duplicate (its role and text come earlier), or truncated (its last such character isn't
    one of ``.!?``); blank ones and duplicates must go. Rows that ``gone`` marks only name their conversation.
    """
    return _run(df, _Turns, id, turn, role, text, gone).withColumnRenamed("conv", id)


def summary(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row for each id in ``df``; see ``repaired``.

    A conversation without a turn has zeros, an empty audit and the digest of the empty text.
    """
    return _run(df, _Summary, id, turn, role, text, gone).withColumnRenamed("conv", id)


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return summary(damaged(common.table(spark, sf_dir, "conversations")), gone="gone")


OP11_SQL = r"""
WITH RECURSIVE tab AS (  -- the table of CRC-32 for one byte
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n) b) z),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS key, dense_rank() OVER (ORDER BY conv_id NULLS LAST) AS c
  FROM conversations),
damage AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(key), '..'), lambda h: CAST('0x' || h AS BIGINT))),
         lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS d
  FROM given, tab),
rows_ AS (
  SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) FROM damage WHERE d <> 0) x),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER w AS n,
         lag(left(role, 1)) OVER w AS prior, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM rows_ WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text))),
seen AS MATERIALIZED (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM ordered),
counts AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE n > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM seen GROUP BY c),
nx(state, role, initial, after_) AS (VALUES (0, 'system', 's', 1), (0, 'user', 'u', 2), (1, 'user', 'u', 2), (2, 'assistant', 'a', 3), (3, 'user', 'u', 2)),
-- Insertions first (phase 0), then the turn's own edit (phase 1).
dp(c, n, phase, state, cost, audit) AS (
  SELECT c, 0::BIGINT, 0, 0, 0::BIGINT, '' FROM counts
  UNION ALL
  SELECT c, n, phase, state, best.cost, best.audit
  FROM (
    SELECT c, n, phase, state, min({'cost': cost, 'audit': audit}) AS best
    FROM (
      SELECT c, n, 1 AS phase, state, cost, audit FROM dp WHERE phase = 0
      UNION ALL
      SELECT c, n, 1, after_, cost + 3, audit || 'I' FROM dp JOIN nx USING (state) WHERE phase = 0 AND nx.initial <> 's'
      UNION ALL
      SELECT c, n, 1, CASE WHEN state IN (0, 1) THEN 3 ELSE state END, cost + 6, audit || 'II' FROM dp WHERE phase = 0 AND state IN (0, 1)
      UNION ALL
      SELECT dp.c, dp.n + 1, 0, dp.state, cost + 4, audit || 'D' FROM dp JOIN counts USING (c) WHERE phase = 1 AND dp.n < counts.n
      UNION ALL
      SELECT dp.c, dp.n + 1, 0, after_, cost + CASE WHEN fault = 3 THEN 3 ELSE 0 END, audit || 'K'
      FROM dp JOIN seen ON seen.c = dp.c AND seen.n = dp.n + 1 AND fault NOT IN (1, 2) JOIN nx ON nx.state = dp.state AND nx.initial = seen.initial WHERE phase = 1
      UNION ALL
      SELECT dp.c, dp.n + 1, 0, after_, cost + 3 + CASE WHEN fault = 3 THEN 3 ELSE 0 END, audit || 'R'
      FROM dp JOIN seen ON seen.c = dp.c AND seen.n = dp.n + 1 AND fault NOT IN (1, 2) JOIN nx ON nx.state = dp.state AND nx.initial <> 's' WHERE phase = 1) e
    GROUP BY c, n, phase, state) f),
best AS (
  SELECT dp.c, min({'cost': cost, 'audit': audit}) AS b FROM dp JOIN counts ON counts.c = dp.c AND counts.n = dp.n WHERE phase = 1 AND state IN (0, 3) GROUP BY dp.c),
letters AS (
  SELECT c, i, b.audit[i] AS letter FROM best, LATERAL (SELECT unnest(range(1, length(b.audit) + 1)) AS i) u),
placed AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY c ORDER BY i) AS n FROM letters),
kept AS (
  SELECT p.c, p.i, letter, seen.role, seen.text, row_number() OVER (PARTITION BY p.c ORDER BY p.i) AS e
  FROM placed p LEFT JOIN seen ON seen.c = p.c AND seen.n = p.n AND letter <> 'I' WHERE letter <> 'D'),
voiced AS (
  SELECT *, bool_or(e = 1 AND letter = 'K' AND left(role, 1) = 's') OVER (PARTITION BY c) AS system_ FROM kept),
texts AS (
  SELECT c, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (e + system_::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY e)) AS digest
  FROM voiced GROUP BY c)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM given LEFT JOIN counts ON counts.c = given.c LEFT JOIN best ON best.c = given.c LEFT JOIN texts ON texts.c = given.c
"""
