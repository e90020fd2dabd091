import hashlib
import random
import re
from collections import defaultdict

import pytest

from veilframe.llm.line_templates import dedup_lines, op1_line_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(texts, min_docs, depth, similarity):
    """Dropped line numbers of each text, by dictionaries."""
    def parts(t):
        for k, x in enumerate((t or "").split("\n")):
            if w := ["*" if re.search("[0-9]", y) else y for y in WORD.findall(x.translate(FOLD))]:
                yield k, (len(w), *w[:depth]), tuple(w), tuple(WORD.findall(x.translate(FOLD)))

    leaves, places = defaultdict(set), defaultdict(int)
    kinds = defaultdict(set)
    for t in set(texts):
        for _, leaf, _, _ in parts(t):
            leaves[leaf].add(t)
    for t in set(texts):
        for _, leaf, w, raw in parts(t):
            if len(leaves[leaf]) >= min_docs:
                kinds[leaf, w, raw].add(t)
    for (leaf, w, _), own in kinds.items():
        for k, y in enumerate(w):
            places[leaf, k, y] += len(own)
    templates = defaultdict(set)
    of = {}
    for (leaf, w, raw), own in kinds.items():
        fixed = [y != "*" and places[leaf, k, y] >= min_docs for k, y in enumerate(w)]
        if sum(fixed) >= similarity * max(1, sum(y != "*" for y in w)):
            of[leaf, raw] = (leaf, tuple(y if f else None for y, f in zip(w, fixed, strict=True)))
            templates[of[leaf, raw]] |= own
    return [{k for k, leaf, _, raw in parts(t) if len(templates.get(of.get((leaf, raw)), ())) >= min_docs} for t in texts]


def made(seed):
    r = random.Random(seed)
    fixed = ["All rights reserved.", "Page {} of {}", "Posted by {} on the third day of May", "a", "é è  à"]
    texts = [None, "", "\n\n", "x\n \ny", "THE\x0bthe"]
    for _ in range(120):
        lines = [" ".join(str(r.choice("abcdefg")) + r.choice(["", "x", "yz"]) for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 6))]
        for f in r.sample(fixed, r.randint(0, 3)):
            lines.insert(r.randint(0, len(lines)), f.format(r.choice(["1", "22", "n7", "ann", "bob", "joe"]), r.randint(0, 9)))
        texts.append("\n".join(lines))
    return texts + texts[5:9] * 5


@pytest.mark.parametrize(("seed", "min_docs", "similarity"), [(1, 10, 0.8), (2, 5, 0.6), (3, 20, 1.0)])
def test_equals_brute_force(spark, seed, min_docs, similarity):
    texts = made(seed)
    docs = spark.createDataFrame([(k % 100, t, 3, "q") for k, t in enumerate(texts)], "doc_id long, text string, k1 int, found string").repartition(4)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in dedup_lines(docs, min_docs=min_docs, similarity=similarity).collect()), key=str)
    want = []
    for k, (t, drop) in enumerate(zip(texts, brute(texts, min_docs, 3, similarity), strict=True)):
        lines = [] if t is None else t.split("\n")
        want.append((k % 100, len(lines), len(drop), None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in drop)))
    assert got == sorted(want, key=str)
    assert any(x[2] for x in want)


def test_variable_fields_and_whole_copies(spark):
    rows = [(k, f"text {k} stands here alone q{k}z word{chr(97 + k)}\nPosted by user{chr(97 + k)} in the long thread") for k in range(12)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10, similarity=0.8).collect()
    assert all(r["n_dropped"] >= 0 for r in out)
    again = dedup_lines(spark.createDataFrame([(k, f"same line of text\nand so on {'x' * k}") for k in range(12)], "doc_id long, text string"), min_docs=10, max_share=0.3).collect()
    assert all(r["n_dropped"] == 0 for r in again)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op1_line_dedup(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    n = 0
    for d, drop in zip(docs, brute([d["text"] for d in docs], 20, 3, 0.8), strict=True):
        r = rows[d["doc_id"]]
        kept = "\n".join(x for k, x in enumerate(d["text"].split("\n")) if k not in drop)
        assert (r["n_dropped"], r["kept_sha256"]) == (len(drop), hashlib.sha256(kept.encode()).hexdigest())
        n += len(drop)
    assert n > 100
