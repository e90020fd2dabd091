import hashlib
import random
import re
from collections import Counter

import pytest

from veilframe.llm.substrings import dedup_substrings, op3_substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(texts, window):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - window + 1):
            if seen[tuple(d[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(d), len(gone), " ".join(w for k, w in enumerate(d) if k not in gone)))
    return out


def made(seed):
    r = random.Random(seed)
    vocab = ["a", "b", "é", "x1", "THE", "the", "w w"]
    shared = [" ".join(r.choices(vocab, k=r.randint(8, 60))) for _ in range(4)]
    texts = [None, "", "   \n\t", "one", "a " * 400, "b " * 400]
    for _ in range(60):
        parts = [" ".join(str(r.randint(0, 400)) for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), "\n".join(str(r.randint(0, 400)) for _ in range(r.randint(0, 20)))]
        texts.append("\x0b ".join(parts))
    return texts + texts[6:9] + [texts[10]] * 40


@pytest.mark.parametrize(("window", "rows"), [(35, 20_000), (12, 20_000), (12, 3), (12, 0)])
def test_equals_brute_force(spark, window, rows):
    texts = made(window)
    docs = spark.createDataFrame([(k % 90, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, kept string, salt string").repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(docs, window=window, group_rows=rows).collect())
    assert got == sorted((k % 90, *x) for k, x in enumerate(brute(texts, window)))


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert dedup_substrings(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(map(str, range(40)))
    got = dedup_substrings(spark.createDataFrame([(None, t), (None, t), (1, None)], schema)).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 40, 40]


def test_query(spark, sf):
    rows = {r["doc_id"]: r for r in op3_substrings(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    for d, (n, gone, kept) in zip(docs, brute([d["text"] for d in docs], 35), strict=True):
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def thue_morse(n):
    """The word and its complement: equal under any polynomial hash modulo a power of two."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("rows", [20_000, 60, 2])
def test_long_words_and_hot_prefixes(spark, rows):
    """Words that differ far inside; thousands of texts with one passage; texts that differ in the last word only."""
    x, y = thue_morse(1024)
    lead = " ".join(f"w{i}" for i in range(34))
    texts = [f"{lead} {x}", f"{lead} {y}", f"{lead} {x * 9}", f"{lead} {y * 9}", "z" * 100_000, "z" * 100_001]
    texts += [f"{lead} tail{i % 50} end" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = sorted((r["n_words"], r["n_removed"], r["kept"]) for r in dedup_substrings(docs, group_rows=rows).collect())
    assert got == sorted(brute(texts, 35))


def test_sorted_suffixes():
    import numpy as np

    from veilframe.llm.substrings import sorted_suffixes

    r = random.Random(9)
    for _ in range(30):
        parts = [[r.randrange(3) for _ in range(r.randint(1, 20))] for _ in range(r.randint(1, 6))]
        w = np.concatenate([np.array(p) for p in parts])
        left = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
        suffix = [tuple(w[k : k + left[k]]) for k in range(len(w))]
        order, common = sorted_suffixes(w, left, np.arange(len(w)))
        assert [suffix[k] for k in order] == sorted(suffix)
        for a, b, n in zip(order, order[1:], common[1:], strict=False):
            assert n == next((k for k, (p, q) in enumerate(zip(suffix[a], suffix[b], strict=False)) if p != q), min(len(suffix[a]), len(suffix[b])))
