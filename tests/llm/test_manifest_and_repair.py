"""The Merkle manifest, near vectors and conversation repair against plain versions."""

import hashlib
import math
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from veralytics.llm import conversation_repair, merkle, near_vectors

# --- Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _way(levels, i):
    """(sibling or None, whether it stands left) on each level."""
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else None, bool(i & 1)))
        i >>= 1
    return out


def _folded(node, way):
    for other, left in way:
        node = _h(node) if other is None else _h(other, node) if left else _h(node, other)
    return node


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    first = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    own = {}
    for lang in langs:
        own[lang] = sorted(((r, _h(*map(_field, r))) for r in rows if r[2] == lang), key=lambda x: (first(x[0][0]), x[1]))
    trees = {lang: _tree([leaf for _, leaf in own[lang]]) for lang in langs}
    crown = _tree([trees[lang][-1][0] for lang in langs])
    out = []
    for no, lang in enumerate(langs):
        for i, (r, leaf) in enumerate(own[lang]):
            way = _way(trees[lang], i) + _way(crown, no)
            told = r
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                told = (*r[:3], r[3] + 1, r[4])
            folded = _folded(_h(*map(_field, told)), way)
            proof = _h(*[s for s, _ in way if s is not None])
            out.append((r[0], leaf, trees[lang][-1][0], crown[-1][0], proof, folded, folded == crown[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"
MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_matches_plain_trees(spark, bits):
    rng = random.Random(bits)
    rows = [(i, rng.choice(["s", "é", None]), rng.choice(["en", "en", "en", "de", None, "", "ß"]), rng.choice([None, i]), f"t{i} ü") for i in range(90)]
    rows += [(i, "s", "lone", 1, None) for i in (500,)] + [(600, None, "two", 2, "x" * 100_000), (601, "", "two", 0, "")]
    rows += [(None, None, None, None, None), (7, "s", "en", 7, "again"), (7, "s", "en", 7, "again"), (7, "s", "en", 7, "again")]
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit("clash")).withColumn("idx", F.lit(1)).withColumn("n", F.lit(2))
    got = merkle.manifest(df, bits).select(*MANIFEST).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows)
    assert any(not r["verified"] for r in got)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(3, "s", "en", 5, "hello")]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    assert [tuple(r[c] for c in MANIFEST) for r in got] == brute_manifest(rows)
    assert got[0]["proof"] == [] and got[0]["leaf"] == got[0]["root"]


# --- Near vectors


def brute_near(rows, percent):
    """rows: (vec_id, vector, label)."""
    fine = [
        i is not None and label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for i, v, label in rows
    ]
    dim = max([len(v) for _, v, _ in rows if v] + [1])
    unit = np.zeros((len(rows), dim))
    for n, (_, v, _) in enumerate(rows):
        if fine[n]:
            unit[n, : len(v)] = np.array(v, float) / max(abs(x) for x in v)
            unit[n] /= np.linalg.norm(unit[n])
    near = [[m for m in range(len(rows)) if m != n and fine[n] and fine[m] and rows[n][2] == rows[m][2] and unit[n] @ unit[m] >= percent / 100] for n in range(len(rows))]
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = None if i is None else min(rows[m][0] for m in seen)
        out.append((i, len(near[n]), least, least is not None and i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile_bytes,percent", [(2_000_000, 93), (1, 93), (1, 60)])
def test_near_vectors_match_brute_force(spark, monkeypatch, tile_bytes, percent):
    """Also with tiles of 64 vectors, so that pairs of tiles are left out."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 24)) * np.linspace(6, 0.2, 24)
    rows = []
    for k in range(420):
        v = base[rng.integers(6)] + rng.normal(size=24) * rng.choice([0.05, 0.4, 3.0])
        rows.append((k, v.tolist(), int(rng.choice([1, 1, 1, 2]))))
    rows += [(1000 + k, rows[0][1], rows[0][2]) for k in range(60)]  # copies
    rows += [(2000, [2 * x for x in rows[0][1]], rows[0][2]), (2001, rows[0][1], None), (0, rows[0][1], rows[0][2]), (None, rows[0][1], 1)]
    rows += [(2002, None, 1), (2003, [], 1), (2004, [0.0] * 24, 1), (2005, [float("nan")] * 24, 1), (2006, [1.0, None], 1), (2007, [float("inf"), 1.0], 1)]
    rows += [(2008, [1e300] * 24, 2), (2009, [1e-300] * 24, 2), (2010, [1e300], 2), (2011, [3.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(0)).withColumn("first", F.lit("x"))
    monkeypatch.setattr(near_vectors, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(near_vectors, "STRIP", 16 if tile_bytes == 1 else 256)
    got = sorted((tuple(r) for r in near_vectors.near(df, percent).collect()), key=str)
    assert got == brute_near(rows, percent)
    assert near_vectors.near(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [0.0, 0.1, 2.0])
def test_hits_lose_no_pair(spread):
    """Dense and thin leftovers, and products at the threshold itself."""
    rng = np.random.default_rng(9)
    x = near_vectors.units(list(rng.normal(size=(1, 40)) + spread * rng.normal(size=(200, 40))), 40)
    x[:3] = 0
    x[0, 0], x[1, :2], x[2, 0] = 1, (0.93, math.sqrt(1 - 0.93**2)), 1
    turn = near_vectors.axes(x[100:])
    i, j = near_vectors.hits(x @ turn, x @ turn, x, x, 0.93)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, np.argwhere(np.einsum("ik,jk->ij", x, x) >= 0.93).tolist()))


# --- Conversation repair


def brute_repair(symbols):
    """(cost, edits): the least of all ways, a row at a time. symbols: (initial, gone, truncated)."""
    go = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(symbols) and state in (0, 3) else []
        if inserted < 3:
            for role in "ua":
                if state in go[role]:
                    c, e = best(i, go[role][state], inserted + 1)
                    ways.append((c + 5, "I" + e))
        if i < len(symbols):
            initial, gone, truncated = symbols[i]
            c, e = best(i + 1, state, 0)
            ways.append((c + 2, "D" + e))
            if not gone:
                for edit, price, roles in (("K", 0, initial), ("R", 1, "ua")):
                    for role in roles:
                        if state in go.get(role, {}):
                            c, e = best(i + 1, go[role][state], 0)
                            ways.append((c + price + 5 * truncated, edit + e))
        return min(ways, default=(10**6, ""))

    for i in range(len(symbols), 0, -40):  # so that long conversations need no deep stack
        for state in range(4):
            best(i, state, 0)
    return best(0, 0, 0)


def test_tables_match_all_ways():
    rng = random.Random(3)
    tables = conversation_repair.tables()
    assert len(tables.vectors) < 200
    for size in [*range(9)] * 40:
        symbols = [(rng.choice("ssuuaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(size)]
        code = bytes(8 if gone else "suat".index(i) % 4 + 4 * cut for i, gone, cut in symbols)
        assert tables.repair(code) == brute_repair(tuple(symbols)), symbols


def brute_audit(rows):
    """rows: (conv_id, turn, role, text, alive)."""
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:4] for r in rows if r[0] == conv and r[4]), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        symbols = tuple((role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(own, faults, strict=True))
        cost, audit = brute_repair(symbols)
        kept, at = [], 0
        total = len(audit.replace("D", ""))
        for edit in audit:
            place = ["user", "assistant"][(len(kept) - total % 2) % 2]
            if edit == "I":
                kept.append(f"{place}:")
                continue
            _, role, text = own[at]
            at += 1
            if edit != "D":
                kept.append(f"{role if edit == 'K' else place}:{text}")
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


CHATS = "conv_id long, turn long, role string, text string, alive boolean"


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "Well", " \t", "", "A\nb?", "ü.", "x" * 60_000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ursula"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, rng.choice([f"t{turn}.", *texts]), rng.random() < 0.9))
    rows += [(None, None, "user", "Hi.", True), (None, 0, "assistant", "Ho.", True), (900, 1, "user", "gone", False), (901, 5, "s", "only.", True)]
    rows += [(902, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.", i != 700) for i in range(3000)]
    return rows


def test_repair_matches_brute_force(spark, chats):
    df = spark.createDataFrame(chats, CHATS).repartition(5).withColumn("n", F.lit(1)).withColumn("code", F.lit("x")).withColumn("pass", F.lit(2))
    got = sorted((tuple(r) for r in conversation_repair.repair(df).collect()), key=str)
    assert got == brute_audit(chats)
    assert conversation_repair.repair(df.limit(0)).count() == 0 and conversation_repair.repaired(df.limit(0)).count() == 0


def test_repaired_rows_are_legal_and_agree(spark, chats):
    df = spark.createDataFrame(chats, CHATS)
    audit = {r["conv_id"]: r for r in conversation_repair.repair(df).collect()}
    rows = {}
    for r in conversation_repair.repaired(df).collect():
        rows.setdefault(r["conv_id"], []).append(r)
    for conv, a in audit.items():
        own = rows.get(conv, [])
        kept = sorted((r for r in own if r["place"] is not None), key=lambda r: r["place"])
        assert [r["place"] for r in kept] == list(range(1, len(kept) + 1))
        initials = "".join(r["role"][:1] for r in kept)
        legal = initials[1:] if initials[:1] == "s" else initials
        assert legal == "ua" * (len(legal) // 2) and (initials == "" or legal)
        assert sorted(a["audit"]) == sorted(r["edit"] for r in own)
        whole = "\n".join(f"{r['role']}:{r['text']}" for r in kept)
        assert hashlib.sha256(whole.encode()).hexdigest() == a["repaired_sha256"]


def test_damage(spark):
    rows = [(i, t, "assistant", "Hm. Yes! No? x.") for i in range(40) for t in range(5)] + [(None, 1, None, None), (3, None, "user", "a.")]
    got = conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    expected = []
    for conv, turn, role, text in rows:
        role, text = role or " ", " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(draw, text)
        expected += [(conv, turn, "user" if draw == 4 else role, text, draw != 0)] * (2 if draw == 3 else 1)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
