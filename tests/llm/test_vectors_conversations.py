"""Bit-sliced top-k, hard negatives and conversation repair against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import bit_slices, conversations, hard_negatives, vector_blocks

CLASHES = ("id", "v", "dim", "block", "grp", "score", "rank", "query_id", "more", "n")


def vector_rows(n: int, seed: int = 1):
    """Ties, repeated ids, nulls, odd components, several lengths and huge values among plain rows."""
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0, 0.125, 1.0], i % 3) for i in range(40)]
    rows += [(50, [9.0] * 6, 1), (3, [9.0] * 6, 2), (3, [9.0] * 6, 2), (None, [1.0] * 6, 1), (2000, None, 1), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2051, [math.nan] * 6, 1), (2052, [math.inf] * 6, 1), (2053, [1.0] * 6, None)]
    rows += [(2100, [1e30, -1e30, 3.0], 0), (2101, [1e30, -1e30, 2.0], 0), (2102, [-1e30, 1e30, 2.0], 1), (2103, [1e30, 0.0, 1.0], 1), (2150, [], 0), (2151, [], 1), (2200, [0.25], 3)]
    return rows


def whole_rows(rows, labelled):
    """One (label, vector) an id, as the docstrings say, of rows that take part."""
    out = {}
    for i, v, label in rows:
        if i is None or v is None or (labelled and label is None) or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = ((label + 1) % 10 if i % 7 == 0 else label) if labelled else 0
        one = (label, [math.floor(max(min(256 * x, 2**31 - 1), 1 - 2**31)) for x in v])
        out[i] = min(out.get(i, one), one)
    return out


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63)), 2**63 - 1)


def ranked(found, k):
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(vector_rows(300), "vec_id long, embedding array<double>, label int")
    return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])


def test_bit_sliced_search_equals_brute_force(vectors):
    rows = whole_rows(vector_rows(300), False)
    want = []
    for q, (_, a) in rows.items():
        if q % 50 == 0:
            found = ranked([(i, dot(a, b)) for i, (_, b) in rows.items() if i != q and len(a) == len(b)], 5)
            want += [(q, r + 1, i, s) for r, (i, s) in enumerate(found)]
    for sizes in ({}, {"block_rows": 37, "group_rows": 2}):
        assert sorted(map(tuple, bit_slices.search(vectors, **sizes).collect())) == sorted(want)


def test_hard_negatives_equal_brute_force(vectors):
    rows = whole_rows(vector_rows(300), True)
    want = []
    for a, (label, v) in rows.items():
        if a % 50 == 0:
            others = [(i, dot(v, w), own) for i, (own, w) in rows.items() if i != a and len(v) == len(w)]
            for p, reached in ranked([(i, s) for i, s, own in others if own == label], 5):
                hard = ranked([(i, s) for i, s, own in others if own != label and 50 * reached <= 100 * s <= 95 * reached], 3)
                want += [(a, p, r + 1, i, reached, s) for r, (i, s) in enumerate(hard)]
    assert want
    label = hard_negatives.spread_label(F.col("vec_id"), F.col("label"))
    for sizes in ({}, {"block_rows": 37, "group_rows": 2}):
        assert sorted(map(tuple, hard_negatives.mine(vectors, label, **sizes).collect())) == sorted(want)


def test_vectors_of_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert bit_slices.search(empty).collect() == []
    assert hard_negatives.mine(empty, F.col("label")).collect() == []
    lone = spark.createDataFrame([(50, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert bit_slices.search(lone).collect() == []
    assert hard_negatives.mine(lone, F.col("label")).collect() == []


@pytest.mark.parametrize("spread", [3, 300, 2**31 - 1])
def test_added_slices_bound_every_score(spread):
    rng = np.random.default_rng(spread)
    rows = rng.integers(-spread, spread, (130, 5), endpoint=True).astype(np.int32)
    bitmaps, low, drop = bit_slices.slice_rows(rows)
    valid = bit_slices._all_rows(130)
    for q in rng.integers(-spread, spread, (20, 5), endpoint=True):
        exact = [sum(int(x) * int(w) for x, w in zip(r, q, strict=True)) for r in rows]
        at = bit_slices.boundary(bitmaps, drop, valid, q, 5)
        assert {i for i, s in enumerate(exact) if s >= sorted(exact)[-5]} <= set(at)
        top = (1 << bit_slices.SLICES) - 1
        sums = [sum(((int(x) - int(m)) >> drop if w >= 0 else top - ((int(x) - int(m)) >> drop)) * abs(int(w)) for x, m, w in zip(r, low, q, strict=True)) for r in rows]
        slices = bit_slices.add_slices(bitmaps, q)
        got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(object) << i for i, s in enumerate(slices))
        assert list(got) == sums
        assert bit_slices.kth_largest(slices, valid, 7) == sorted(sums)[-7]


def test_scores_saturate():
    big = np.full((1, 4), 2**31 - 1, np.int32)
    assert vector_blocks.scores(big, big)[0, 0] == 2**63 - 1 and vector_blocks.scores(big, -big)[0, 0] == -(2**63)


# conversations


def plain_repair(turns):
    """(cost, audit, lines) by trying every edit; turns are (role, text) after damage, in order."""
    seen, faults = set(), []
    for role, text in turns:
        shown = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(10**9, "", [])]

    def go(i, open_, cost, audit, lines, run):
        if cost > best[0][0]:
            return
        if i == len(turns) and open_ in "sm":
            best[0] = min(best[0], (cost, audit, lines))
        follows = {"s": "su", "f": "u", "r": "a", "m": "u"}[open_]
        then = {"s": "f", "u": "r", "a": "m"}
        if run < 3:  # three inserted turns in a row would hold a whole pair
            t = follows[-1]
            go(i, then[t], cost + 2, audit + "I", [*lines, ("user:" if t == "u" else "assistant:")], run + 1)
        if i < len(turns):
            (role, text), fault = turns[i], faults[i]
            go(i + 1, open_, cost + 3, audit + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                for t in follows:
                    if role[:1] == t:
                        go(i + 1, then[t], more, audit + "K", [*lines, f"{role}:{text}"], 0)
                t = follows[-1]
                go(i + 1, then[t], more + 2, audit + "R", [*lines, ("user:" if t == "u" else "assistant:") + text], 0)

    go(0, "s", 0, "", [], 0)
    return *best[0], faults


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain_results(rows):
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = {t for t, _, _ in own if t is not None}
        cost, audit, lines, faults = plain_repair([r[1:] for r in own])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        want[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def conversation_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "Why? ", " \t", "", None, "Ünd so.\n", "a.b", "Yes.\r\n"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    rows = [(conv, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for conv in range(60) for _ in range(rng.randrange(1, 7))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hm"), (None, None, None, None)]
    rows += [(conv, t, r, "word " * 20_000 + e) for conv in (70, 71) for t, r, e in ((0, "user", "."), (1, "assistant", ""))]
    return rows


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def chats(spark):
    df = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    return df.select("*", *[F.lit(7).alias(c) for c in ("copies", "fault", "n", "cost", "seq", "first", "audit")])


def test_repair_equals_trying_every_edit(chats):
    want = plain_results(conversation_rows())
    assert len({w[6] for w in want.values()}) > 30
    assert results(conversations.repair_conversations(conversations.damaged(chats))) == want


@pytest.mark.parametrize("limits", [{"long_rows": 2, "segment_rows": 1}, {"long_rows": 3, "segment_rows": 2}, {"long_chars": 10, "segment_chars": 5}])
def test_segments_give_the_same_repair(chats, limits):
    """Conversations cut at every turn, at every other turn, and by the length of texts."""
    assert results(conversations.repair_conversations(conversations.damaged(chats), **limits)) == plain_results(conversation_rows())


def test_one_long_conversation_is_spread(spark):
    """A conversation of 6,000 rows, a third of them copies of a few: both ways agree, and no task holds it all."""
    rng = random.Random(5)
    rows = [(1, i // 2, rng.choice(["system", "user", "assistant"]), rng.choice(["Same.", "Again?", f"Turn {i}.", f"Turn {i}"])) for i in range(4000)] + [(1, 7, "user", "Copy.")] * 2000
    df = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    whole = results(conversations.repair_conversations(df, long_rows=10**9))
    assert results(conversations.repair_conversations(df, long_rows=1000, segment_rows=100)) == whole
    assert whole[1][2] > 2000 and len(whole[1][6]) > 5000


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.repair_conversations(conversations.damaged(empty)).collect() == []
    # every row of it is dropped by the damage
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = results(conversations.repair_conversations(conversations.damaged(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))))
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(gone)


def test_visitors_bring_few_rows_from_a_block():
    """Many buckets meet in one block: a visitor's best rows of all of them leave it, each id once, and no others meet."""
    import pyarrow as pa

    from panelforge.llm import neighbours

    rng = np.random.default_rng(5)
    m, q = rng.normal(size=(60, 8)), rng.normal(size=(3, 8))
    of = rng.integers(0, 10, 60)
    pack = lambda rows: pa.array([r.tobytes() for r in rows], pa.binary())
    visits = [(i, b) for i in range(3) for b in range(0, 8)]
    queries = pa.table({"bucket": pa.array([b for _, b in visits]), "key": pa.array([bytes([i]) for i, _ in visits], pa.binary()), "vec": pack([q[i] for i, _ in visits])})
    members = pa.table({"bucket": pa.array(of), "key": pack(m), "vec": pack(m), "ids": pa.array([[int(i), 100 + int(i) % 7] for i in range(60)])})
    got = neighbours._rank(4)(queries, members).to_pylist()
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    want = []
    for i in range(3):
        best = {}
        for j in np.flatnonzero(of < 8):
            for name in (int(j), 100 + int(j) % 7):
                best[name] = max(best.get(name, -2.0), sims[i, j])
        want += [(bytes([i]), name, score) for name, score in sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:4]]
    assert [(r["key"], r["vec_id"]) for r in got] == [x[:2] for x in want]
    assert [r["score"] for r in got] == pytest.approx([x[2] for x in want])
