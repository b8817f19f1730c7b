"""Cheapest repair of damaged conversations by Four-Russians block tables.

A conversation becomes a word over nine symbols: what its rows' roles begin with
and what is wrong with them. Four states say how far a legal conversation
``(s?(ua)+)?`` has come, and a row maps a vector of four costs to the next one.
Less its smallest cost, such a vector is one of a few dozen, because a state that
costs ``FAR`` more than the cheapest is on no cheapest way. So the step over every
block of ``BLOCK`` symbols from every vector is put into a table once, and a
conversation is read block by block by lookup.

The way back goes from the last block to the first. A block is expanded into its
single steps only where its vector, its symbols and the order of what follows it
have not been met before. All cheapest ways are kept, and of them the one whose
letters are least, so ties do not depend on the order of work.

Rows are shuffled once, by conversation. A conversation is one result (a string
of edits, one hash over its whole text), so one task takes it, and takes it as a
stream: its symbols first, a byte a row, then its texts, which go into the hash
one by one and are not held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veralytics.llm.common import CRC32_SQL

RATE = 20
DROP, EMPTY, STRIP, REPEAT, USER = 0, 1, 2, 3, 4
WORD_CHAR, STOP = r"[^\x20\x09-\x0D]", "[.!?]"
STOPPED = r"[.!?][\x20\x09-\x0D]*\z"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

# A row's byte is its fault times four plus its role's initial.
INITIALS = "sua"
OTHER, PER_FAULT = 3, 4
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIAL = bytes(ord("sua-"[b % PER_FAULT]) for b in range(256))
_FAULT = bytes(b // PER_FAULT for b in range(256))
# Symbols: 0-3 and 4-7 are rows with such an initial, whole or truncated; 8 has to go.
GONE = 8
_SYMBOL = bytes({FINE: b % PER_FAULT, TRUNCATED: PER_FAULT + b % PER_FAULT}.get(b // PER_FAULT, GONE) for b in range(256))

# States: nothing yet, after s, after u, after a.
STATES, ENDS = 4, (0, 3)
GO = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "-": {}}
NEVER, FAR, BLOCK = 10**9, 12, 3
START = (0, NEVER, INSERT_COST, 2 * INSERT_COST)
INSERTS = [(x, y) for role in "ua" for x, y in GO[role].items()]


@lru_cache(maxsize=None)
def edges(symbol: int) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, from, to, cost) of all that can be done with a row."""
    out = [("D", x, x, DELETE_COST) for x in range(STATES)]
    if symbol != GONE:
        more = TRUNCATED_COST if symbol >= PER_FAULT else 0
        out += [("K", x, y, KEEP_COST + more) for x, y in GO["sua-"[symbol % PER_FAULT]].items()]
        out += [("R", x, y, REROLE_COST + more) for role in "ua" for x, y in GO[role].items()]
    return tuple(out)


def step(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs behind a row, with what may be inserted behind it."""
    out = [NEVER] * STATES
    for _, x, y, cost in edges(symbol):
        out[y] = min(out[y], costs[x] + cost)
    for x, y in INSERTS:  # u before a; more than both in a row is never cheapest
        out[y] = min(out[y], out[x] + INSERT_COST)
    return tuple(min(c, NEVER) for c in out)


def normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs above the smallest, and the smallest. Any state follows any other's way for at most 10 more."""
    least = min(costs)
    return tuple(c - least if c - least <= FAR else NEVER for c in costs), least


class Tables:
    """The steps of all vectors over all blocks of up to ``BLOCK`` symbols."""

    def __init__(self) -> None:
        first, _ = normal(START)
        self.vectors, known, single = [first], {first: 0}, []
        while len(single) < len(self.vectors):
            row = []
            for symbol in range(GONE + 1):
                vector, cost = normal(step(self.vectors[len(single)], symbol))
                if vector not in known:
                    known[vector] = len(self.vectors)
                    self.vectors.append(vector)
                row.append((known[vector], cost))
            single.append(row)
        self.over: dict[bytes, list[tuple[int, int]]] = {b"": [(v, 0) for v in range(len(self.vectors))]}
        for size in range(1, BLOCK + 1):
            for block in product(range(GONE + 1), repeat=size):
                before = self.over[bytes(block[:-1])]
                self.over[bytes(block)] = [(single[v][block[-1]][0], c + single[v][block[-1]][1]) for v, c in before]
        self.expanded: dict = {}

    def back(self, vector: int, block: bytes, after: tuple):
        """The way back over a block: the order of the states before it, and each one's least edits and next state.

        ``after`` has the order of what follows each state behind the block, None
        where no cheapest way passes. Inserts before a row belong to that row's
        block, so the edits of a block end with a row's, and none is another's prefix.
        """
        key = (vector, block, after)
        if key not in self.expanded:
            costs = [self.vectors[vector]]
            for symbol in block:
                costs.append(step(costs[-1], symbol))
            best = {y: ("", order, y) for y, order in enumerate(after) if order is not None}
            for j in range(len(block) - 1, -1, -1):
                here: dict[int, tuple[str, int, int]] = {}
                for x in sorted(range(STATES), key=lambda x: -costs[j][x]):  # an insert leads to a higher cost
                    ways = [(e + best[y][0], *best[y][1:]) for e, s, y, c in edges(block[j]) if s == x and y in best and costs[j][x] + c == costs[j + 1][y]]
                    ways += [("I" + here[y][0], *here[y][1:]) for s, y in INSERTS if s == x and y in here and costs[j][x] + INSERT_COST == costs[j][y]]
                    if ways and costs[j][x] < NEVER:
                        here[x] = min(ways)
                best = here
            order = sorted({w[:2] for w in best.values()})
            before = tuple(order.index(best[x][:2]) if x in best else None for x in range(STATES))
            self.expanded[key] = before, {x: (w[0], w[2]) for x, w in best.items()}
        return self.expanded[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """The least cost, and of the edits that cost it those whose letters are ASCII-least."""
        at, cost, seen = 0, 0, []
        blocks = [symbols[i : i + BLOCK] for i in range(0, len(symbols), BLOCK)]
        for block in blocks:
            seen.append(at)
            at, more = self.over[block][at]
            cost += more
        last = self.vectors[at]
        least = min(last[x] for x in ENDS)
        tail = {x: "" for x in ENDS if last[x] == least}
        for x in sorted(range(STATES), key=lambda x: -last[x]):
            for s, y in INSERTS:
                if s == x and y in tail and x not in tail and last[x] + INSERT_COST == last[y]:
                    tail[x] = "I" + tail[y]
        names = sorted(set(tail.values()))
        after = tuple(names.index(tail[x]) if x in tail else None for x in range(STATES))
        ways = []
        for vector, block in zip(reversed(seen), reversed(blocks), strict=True):
            after, way = self.back(vector, block, after)
            ways.append(way)
        state, out = 0, []
        for way in reversed(ways):
            edits, state = way[state]
            out.append(edits)
        return cost + least, "".join(out) + tail[state]


@lru_cache(maxsize=1)
def tables() -> Tables:
    """One set of tables for a Python worker."""
    return Tables()


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``alive`` of the rows after damage; a dropped row stays with ``alive`` false.

    A null conv_id or turn in the drawing key, a null role and a null text are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % RATE
    own = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text")
    ).withColumn("draw", draw)
    return own.select(
        "conv_id", "turn",
        F.when(F.col("draw") == USER, "user").otherwise(space("role")).alias("role"),
        F.when(F.col("draw") == EMPTY, "").when(F.col("draw") == STRIP, F.regexp_replace(space("text"), STOP, "")).otherwise(space("text")).alias("text"),
        (F.col("draw") != DROP).alias("alive"),
        F.explode(F.when(F.col("draw") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def row_code(role: Column, text: Column, seen: Column) -> Column:
    """A row's first fault and its role's initial as one byte; ``seen`` counts equal rows up to it."""
    fault = (
        F.when(~text.rlike(WORD_CHAR), BLANK).when(seen > 1, DUPLICATE).when(~text.rlike(STOPPED), TRUNCATED).otherwise(FINE)
    )
    initial = F.substring(role, 1, 1)
    place = F.coalesce(*[F.when(initial == c, i) for i, c in enumerate(INITIALS)], F.lit(OTHER))
    return (fault * PER_FAULT + place).cast("int")


AUDIT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
EDITS = "conv_id long, place long, edit string, role string, text string"
# Rows that are held as Python values at a time.
STEP_ROWS = 256


class _Conversation:
    """One conversation as its rows pass: first their codes and turns, then their texts."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.low, self.last, self.turns = conv_id, bytearray(), None, None, 0
        self.audit: str | None = None

    def code(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.last, self.turns = turn, self.turns + 1

    def solve(self) -> None:
        if self.audit is None:
            self.cost, self.audit = tables().repair(bytes(self.codes).translate(_SYMBOL))
            self.at, self.place, self.odd = 0, 0, (len(self.audit) - self.audit.count("D")) % 2

    def _edit(self, role: str | None, text: str | None) -> tuple:
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return self.conv_id, None, edit, role, text
        self.place += 1
        if edit != "K":
            role = ROLES["ua"[(self.place - 1 - self.odd) % 2]]
        return self.conv_id, self.place, edit, role, "" if edit == "I" else text

    def inserts(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._edit(None, None)

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        yield self._edit(role, text)

    def counts(self) -> tuple:
        initials, faults = bytes(self.codes).translate(_INITIAL), bytes(self.codes).translate(_FAULT)
        illegal = max(len(initials) - 1, 0) - sum(initials.count(p) for p in (b"su", b"ua", b"au"))
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        return gaps, *(faults.count(bytes([f])) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, self.cost, self.audit


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple | None]]:
    """Each edit of each conversation of a sorted partition, and None when the conversation ends."""
    now = None
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            part = batch.slice(start, STEP_ROWS)
            columns = [part.column(c).to_pylist() for c in ("conv_id", "turn", "code", "role", "text")]
            for conv_id, turn, code, role, text in zip(*columns, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from _end(now)
                    now = _Conversation(conv_id)
                if text is not None:
                    now.solve()
                    yield from ((now, e) for e in now.row(role, text))
                elif code is not None:
                    now.code(turn, code)
    if now is not None:
        yield from _end(now)


def _end(now: _Conversation) -> Iterator[tuple[_Conversation, tuple | None]]:
    now.solve()
    yield from ((now, e) for e in now.inserts())
    yield now, None


def _packed(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [c.split() for c in schema.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    while part := list(islice(rows, STEP_ROWS)):
        columns = [pa.array(v, t) for v, t in zip(zip(*part, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        whole = hashlib.sha256()
        for now, edit in _edits(batches):
            if edit is None:
                yield now.conv_id, *now.counts(), whole.hexdigest()
                whole = hashlib.sha256()
            elif edit[1] is not None:
                _, place, _, role, text = edit
                whole.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())

    return _packed(rows(), AUDIT)


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _packed((edit for _, edit in _edits(batches) if edit is not None), EDITS)


def _ready(rows: DataFrame) -> DataFrame:
    """Rows by conversation, in each first all codes and turns, then all roles and texts, both in order."""
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    held = rows.select("conv_id", "turn", "role", "text", "alive").repartition("conv_id")
    placed = held.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    equal = Window.partitionBy("conv_id", "alive", "role", "text").orderBy("n")
    coded = placed.withColumn("seen", F.row_number().over(equal))
    coded = coded.withColumn("code", F.when(F.col("alive"), row_code(F.col("role"), F.col("text"), F.col("seen"))))
    null = lambda kind: F.lit(None).cast(kind)
    light = F.struct(F.lit(0).alias("pass"), F.col("code").alias("code"), null("string").alias("role"), null("string").alias("text"))
    full = F.struct(F.lit(1).alias("pass"), null("int").alias("code"), F.col("role").alias("role"), F.col("text").alias("text"))
    both = coded.select("conv_id", "turn", "n", F.inline(F.when(F.col("alive"), F.array(light, full)).otherwise(F.array(light))))
    return both.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pass", "n").select("conv_id", "turn", "code", "role", "text")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows``: a row per edit with conv_id, place, edit, role and text.

    ``place`` counts from 1 in the repaired conversation and is null for a deleted
    row, which shows its old role and text. See :func:`repair` for all rules.
    """
    return _ready(rows).mapInArrow(_changes, EDITS)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, alive): its faults and its cheapest repair.

    gaps (turn numbers that are missing between the first and the last), blank,
    duplicate, truncated (rows by first fault), illegal (neighbours whose roles'
    initials are not su, ua or au), cost and audit (edits in order: Keep, Rerole,
    Delete, Insert; of the cheapest the ASCII-least), repaired_sha256 (of the rows
    of :func:`repaired` as ``role:text`` lines).

    Other columns are not read. Rows go by turn, null first, then role, then text;
    rows that are equal in all of them are alike. Roles whose initial is none of s,
    u and a can only be given another role or deleted; an empty role has no initial.
    A null conv_id is a conversation of its own. ``alive`` false marks a row that is
    gone; a conversation of such rows alone has zeros, no edits and the hash of the
    empty string. An empty table gives no rows. Texts of any length pass one by one.
    """
    return _ready(rows).mapInArrow(_audits, AUDIT)


def _oracle() -> str:
    """The plain way, a row at a time: for each state the least (cost, edits) of all ways to it."""
    none = "{'c': 1000000000, 'e': ''}"

    def way(state: str, edit: str, cost: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}'}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    t = f"(CASE WHEN fault = {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END)"
    bad = f"(CASE WHEN fault IN ({BLANK}, {DUPLICATE}) THEN 100000000 ELSE 0 END)"
    keep = lambda x, role: way(x, "K", f"{bad} + {t} + (CASE WHEN left(role, 1) = '{role}' THEN 0 ELSE 100000000 END)")
    rerole = lambda x: way(x, "R", f"{bad} + {t} + {REROLE_COST}")
    drop = lambda x: way(x, "D", str(DELETE_COST))
    insert = lambda x: way(x, "I", str(INSERT_COST))
    u = [w for x in ("p.s0", "p.s1", "p.s3") for w in (keep(x, "u"), rerole(x))]
    return f"""
WITH RECURSIVE d AS (SELECT *, ({CRC32_SQL}) % {RATE} AS draw FROM (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
a AS (SELECT conv_id, turn, CASE WHEN draw = {USER} THEN 'user' ELSE role END AS role,
    CASE WHEN draw = {EMPTY} THEN '' WHEN draw = {STRIP} THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d JOIN (VALUES (0), (1)) copy(copy) ON copy = 0 OR draw = {REPEAT} WHERE draw <> {DROP}),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS seen FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN {BLANK} WHEN seen > 1 THEN {DUPLICATE}
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN {TRUNCATED} ELSE {FINE} END AS fault,
    left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY n), 1) AS pair,
    lead(role) OVER (PARTITION BY conv_id ORDER BY n) IS NULL AS ends FROM n),
faults AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
    count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (fault = {TRUNCATED}) AS truncated, count(*) FILTER (NOT ends AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
p AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0, 'e': ''}} AS s0, {none} AS s1, {{'c': {INSERT_COST}, 'e': 'I'}} AS s2, {{'c': {2 * INSERT_COST}, 'e': 'II'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, r0, r1, {least("r2", insert("r0"), insert("r1"), insert("r3"))}, {least("r3", insert(least("r2", insert("r0"), insert("r1"))))}
  FROM (SELECT f.conv_id, f.n, {drop("p.s0")} AS r0, {least(drop("p.s1"), keep("p.s0", "s"))} AS r1, {least(drop("p.s2"), *u)} AS r2,
      {least(drop("p.s3"), keep("p.s2", "a"), rerole("p.s2"))} AS r3
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1)),
best AS (SELECT conv_id, list_min([s0, s3]).c AS cost, list_min([s0, s3]).e AS audit FROM p
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
edits AS (SELECT conv_id, audit, CAST(unnest(range(1, length(audit) + 1)) AS BIGINT) AS i FROM best),
placed AS (SELECT *, audit[i] AS edit, length(replace(left(audit, i), 'I', '')) AS n, length(replace(left(audit, i), 'D', '')) AS pos,
    length(replace(audit, 'D', '')) % 2 AS odd FROM edits),
lines AS (SELECT p.conv_id, p.i, CASE WHEN edit = 'K' THEN f.role WHEN (pos - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
    CASE WHEN edit = 'I' THEN '' ELSE f.text END AS line
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n WHERE edit <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS whole FROM lines GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM best b LEFT JOIN faults ON faults.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ORACLE = _oracle()
