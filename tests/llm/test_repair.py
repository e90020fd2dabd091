"""Conversation repair against a search over all edits, and the query against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from veilframe.llm import repair
from veilframe.llm.repair import op13_conversation_repair, repair_conversations, repaired


def brute(rows):
    """(cost, audit, repaired) by the cheapest, then least, string of edits: a search in the order of (cost, string)."""
    seen, kinds = set(), []
    for row in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", row[1])
        kinds.append((not bare or row in seen, bool(bare) and bare[-1] not in ".!?"))
        seen.add(row)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, k, told, out = heapq.heappop(heap)
        if (k, told[:1] if told == "s" else told[-1:]) in done:
            continue
        done.add((k, told[:1] if told == "s" else told[-1:]))
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", told):
            return cost, audit, list(out)
        go = lambda c, x, n, t, *o: re.match("s?(ua)*u?$", t) and heapq.heappush(heap, (cost + c, audit + x, n, t, (*out, *o)))
        for role in ("user", "assistant"):
            go(5, "I", k, told + role[0], (role, ""))
        if k < len(rows):
            (role, text), (unfit, cut) = rows[k], kinds[k]
            go(2, "D", k + 1, told)
            if not unfit:
                if role[:1] in ("s", "u", "a"):
                    go(5 * cut, "K", k + 1, told + role[0], (role, text))
                for other in ("user", "assistant"):
                    go(1 + 5 * cut, "R", k + 1, told + other[0], (other, text))


def faults(rows):
    n, seen = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, set()
    for k, row in enumerate(rows):
        bare = re.sub(r"[\x20\x09-\x0D]", "", row[1])
        kind = "blank" if not bare else "duplicate" if row in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add(row)
        if kind:
            n[kind] += 1
        n["illegal"] += bool(k) and rows[k - 1][0][:1] + row[0][:1] not in ("su", "ua", "au")
    return n


def some_rows(r, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", " ", ""]
    texts = ["", " \n", "yes.", "no!", "why? ", "cut", "cut off\n", "a. b", "é."]
    return [(r.choice(roles), r.choice([*texts, f"text {r.random()}.", f"{r.random()}?"])) for _ in range(n)]


@pytest.mark.parametrize("segment", [2, 3, repair.SEGMENT])
def test_repair_against_search(monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    r = random.Random(segment)
    for _ in range(400):
        rows = some_rows(r, r.choice([0, 1, 2, 3, 5, 8, 12]))
        n, audit, out = repaired(rows)
        cost, want, text = brute(rows)
        assert (n.pop("cost"), audit, out) == (cost, want, text), rows
        assert n == faults(rows)


def test_long_conversation():
    """2,000 rows in segments cost and read as by the search, and in time that grows with the rows."""
    rows = some_rows(random.Random(9), 2000)
    n, audit, out = repaired(rows)
    assert (n["cost"], audit, out) == brute(rows)


def damage(conv, turn, role, text):
    show = lambda x: " " if x is None else str(x)
    role, text = show(role), show(text)
    hit = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
    return {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(hit, [(role, text)])


def want_of(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).extend((turn, *x) for x in damage(conv, turn, role, text))
        convs[conv].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    out = {}
    for conv, own in convs.items():
        turns = [t for t, _, _ in own if t is not None]
        told = [x[1:] for x in own]
        cost, audit, text = brute(told)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in text).encode()).hexdigest()
        out[conv] = {"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **faults(told), "cost": cost, "audit": audit, "repaired_sha256": sha}
    return out


def test_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = {r["conv_id"]: r.asDict() for r in op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == want_of(rows)


def test_odd_conversations(spark, tmp_path):
    r = random.Random(2)
    rows = [(c, t, *x) for c in range(60) for t, x in zip(r.choices([None, 0, 1, 2, 3, 9], k=5), some_rows(r, 5), strict=True)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (70, None, "user", None), *[(71, 1, "user", "Same.")] * 3]
    rows += [(c, 0, "user", "Hello.") for c in range(100, 160)]  # some of one row that is dropped
    spark.createDataFrame([(*x, 1, True) for x in rows], "conv_id long, turn long, role string, text string, conv int, absent boolean").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x["conv_id"]: x.asDict() for x in op13_conversation_repair(spark, str(tmp_path)).collect()}
    want = want_of(rows)
    assert got == want
    assert any(x["audit"] == "" for c, x in want.items() if c is not None and c >= 100)
    df = spark.createDataFrame([("x", 1, "user", "a.", 3), ("x", 0, "system", "b.", 3)], "c string, n int, who string, said string, cost int")
    (one,) = repair_conversations(df, conv_col="c", turn_col="n", role_col="who", text_col="said").collect()
    assert (one["c"], one["audit"], one["cost"], [tuple(x) for x in one["repaired"]]) == ("x", "RR", 2, [("user", "b."), ("assistant", "a.")])
    assert repair_conversations(df.limit(0), conv_col="c", turn_col="n", role_col="who", text_col="said").count() == 0
