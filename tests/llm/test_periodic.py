"""Periodic runs: brute force over made and given texts, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from veilframe.llm.common import mixed
from veilframe.llm.periodic import op11_periodic_runs, periodic_runs, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    """Every stretch of words that keeps a period, the smallest period of each, by start and period."""
    best, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(r):
    of = lambda n, k: [r.randrange(k) for _ in range(n)]
    kind = r.randrange(4)
    if kind == 0:
        return of(r.randint(0, 60), r.choice([1, 2, 3]))
    if kind == 1:
        return of(r.randint(0, 5), 3) + of(r.randint(1, 7), r.choice([1, 2, 4])) * r.randint(1, 9) + of(r.randint(0, 4), 3)
    if kind == 2:  # runs inside the period of a run
        return (of(r.randint(1, 3), 2) * 4 + of(2, 5)) * r.randint(1, 6)
    return [x for _ in range(r.randint(1, 6)) for x in of(r.randint(1, 3), 3) * r.randint(1, 9)]


@pytest.mark.parametrize("least,times", [(6, 4), (2, 3), (10, 3), (3, 5)])
def test_runs_against_brute_force(least, times):
    r, seen = random.Random(least), 0
    for _ in range(400):
        docs = [some_words(r) for _ in range(r.randint(1, 5))]
        h = mixed(np.array([x for d in docs for x in d], np.uint64) + np.uint64(5))
        got = runs_of(h, np.cumsum([0] + [len(d) for d in docs]), least, times)
        want = [brute(d, least, times) for d in docs]
        assert got == want
        seen += sum(map(len, want))
    assert seen > 500


def test_long_texts_stay_cheap():
    """One word 300,000 times; 40,000 short runs of one phrase behind different words."""
    one = runs_of(mixed(np.zeros(300_000, np.uint64)), np.array([0, 300_000]))
    assert one == [[(0, 300_000, 1)]]
    w = np.array([x for k in range(40_000) for x in [0] * 6 + [k + 5]], np.uint64)
    many = runs_of(mixed(w), np.array([0, len(w)]))[0]
    assert many == [(7 * k, 6, 1) for k in range(40_000)]


def test_documents(spark):
    texts = [None, "", " \n ", "a", "x x x x x x", "a b a b a b a b", "A a A a A a A a c", "é  é\té\né é\x0bé é", "go " * 5, ("ha " * 6 + "ho ") * 5, "w" * 5000 + " ", ("w" * 5000 + " ") * 7]
    rows = [(k, t, 1, "z") for k, t in enumerate(texts)] + [(None, "x x x x x x", 1, "z"), (4, "x x x x x x", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(df).collect()), key=str)
    want = []
    for k, t, _, _ in rows:
        w = WORD.findall(t or "")
        want.append((k is None, k, len(w), brute(w), collapsed(w, brute(w))))
    assert got == sorted(want, key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, times=2)


def test_query(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r.asDict() for r in op11_periodic_runs(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(t)
    seen = 0
    for d in t:
        w, h = WORD.findall(d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        elif n > 1500:
            continue  # brute force is quadratic
        if n > 6000:
            continue
        runs, r = brute(w), got[d["doc_id"]]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        told = (len(runs), *best, 1000 * best[1] // best[2] if runs else None, "".join(f"{s},{m},{q}\n" for s, m, q in runs), collapsed(w, runs))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == (*told[:5], sha(told[5]), sha(told[6]))
        seen += bool(runs)
    assert seen > 40
