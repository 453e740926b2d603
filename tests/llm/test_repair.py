"""Damage and repair of conversations against a plain search over all edits."""

import hashlib
import itertools
import random
import re
from functools import cache
from zlib import crc32

import pytest

from tidemeter.llm import queries, repair

ROW = "conv_id long, turn long, role string, text string"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def slow_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    fault, seen = [], set()
    for _, _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")
    state = {"": 0, "s": 1, "u": 2, "su": 2, "a": 3}

    def after(q, c):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, c))

    @cache
    def best(i, q, inserts):
        options = []
        if i == len(rows) and q in (0, 3):
            options.append((0, "", ()))
        if inserts < 4:
            for c in "ua":
                if (n := after(q, c)) is not None:
                    cost, audit, said = best(i, n, inserts + 1)
                    options.append((cost + 5, "I" + audit, ((c, None), *said)))
        if i < len(rows):
            cost, audit, said = best(i + 1, q, 0)
            options.append((cost + 2, "D" + audit, said))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 if fault[i] == "truncated" else 0
                for letter, c, paid in [("K", rows[i][2][:1], 0), ("R", "u", 1), ("R", "a", 1)]:
                    if (n := after(q, c)) is not None:
                        cost, audit, said = best(i + 1, n, 0)
                        options.append((cost + paid + more, letter + audit, ((c if letter == "R" else "", i), *said)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    cost, audit, said = best(0, 0, 0)
    names = {"u": "user", "a": "assistant"}
    lines = [f"{names.get(c) or rows[i][2]}:{'' if i is None else rows[i][3]}" for c, i in said]
    assert legal.fullmatch("".join(x[0] for x in lines)) and state
    turns = [t for _, t, _, _ in rows if t is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"), fault.count("duplicate"), fault.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def slow(rows, ids):
    by = {c: [] for c in ids}
    for r in rows:
        by[r[0]].append(r)
    return {c: slow_repair(own) for c, own in by.items()}


def found(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def some(seed, convs, turns):
    rng = random.Random(seed)
    return [
        (c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", " \t", "What?", "Good!", f"Long {rng.random()}.", "é"]))
        for c in range(convs) for t in range(rng.randint(0, turns)) if rng.random() > 0.1
    ]


def test_query_on_the_table(spark, sf_dir):
    own = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_repair(spark, sf_dir)) == slow(slow_damage(own), {r[0] for r in own})


@pytest.mark.parametrize("bits", [0, 2, 10])
def test_repair_in_chunks(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(repair, "width", lambda _: 9)
    rows = some(bits, 40, 9) + some(bits + 50, 1, 120)
    rows = [(r[0] + (1000 if k > 200 else 0), *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ROW)
    assert found(repair.repaired(df, df)) == slow(rows, {r[0] for r in rows})


def test_vectors_that_differ_far_behind(spark, monkeypatch):
    # a row far back decides nothing once vectors are parallel; until then chunks are run again
    monkeypatch.setattr(repair, "BLOCK_BITS", 1)
    monkeypatch.setattr(repair, "width", lambda _: 7)
    for roles in ("uaua" * 6 + "u", "s" + "aauu" * 5, "a" * 17, "u" * 16 + "a", "su" + "sa" * 8):
        rows = [(1, k, {"u": "user", "a": "assistant", "s": "system"}[c], f"{k}.") for k, c in enumerate(roles)]
        df = spark.createDataFrame(rows, ROW)
        assert found(repair.repaired(df, df)) == slow(rows, {1})


def test_odd_rows(spark):
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (2, None, "user", "a."), (2, None, "user", "b."), (2, 5, "assistant", "x" * 200_000 + "."), (2, 5, "assistant", "x" * 200_000 + "."), (3, 1, "", ""), (4, -7, "system", "Only."), (4, 9, "weird", "é?")]
    df = spark.createDataFrame([(*r, "z") for r in rows], ROW + ", first string")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in slow_damage(rows)]
    assert found(repair.repaired(repair.damaged(df), df)) == slow(plain, {None, 2, 3, 4})
    empty = df.limit(0)
    assert repair.repaired(repair.damaged(empty), empty).collect() == []


def test_conversation_without_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi."), (7, 2, "user", "Hi.")], ROW)
    got = found(repair.repaired(df.where("conv_id = 1"), df))
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # a lone user's turn: deleting it is cheaper than an answer
    assert got[1][5:7] == (2, "D")
