import random
import re

import pytest

from veilframe.llm import near_dup
from veilframe.llm.near_dup import components, near_duplicates, op8_near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def made(seed, groups=25, chain=12):
    r = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", "é É"]
    for _ in range(groups):
        w = [str(r.randint(0, 10**6)) for _ in range(r.randint(3, 150))]
        for _ in range(r.randint(1, chain)):  # a chain: each differs from the last one
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = str(r.randint(0, 10**6))
    texts += texts[20:24] * 3
    r.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 85), (2, 5, 80)])
def test_equals_brute_force(spark, seed, k, percent):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, label string").repartition(4)
    assert got(near_duplicates(docs, shingle=k, percent=percent)) == brute(rows, k, percent)


def test_long_chain_in_blocks(spark, monkeypatch):
    """Neighbours are linked, the ends are not; blocks are smaller than the bucket."""
    monkeypatch.setattr("veilframe.llm.near_dup.BLOCK", 4)
    w = [str(i) for i in range(120)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w[3 * i % 120] = f"x{i}"
    rows = [(97 * i % 1009, t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs, shingle=3, percent=85)) == brute(rows, 3, 85)


def test_empty_nulls_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    t = " ".join(map(str, range(50)))
    out = near_duplicates(spark.createDataFrame([(None, t), (4, t), (4, "other"), (9, "other")], schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in out) == [("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "None", True)]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + r.randint(1, 300)) for _ in range(200)] + [(500, 700), (700, 600)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    out = {(x["node"], x["label"]) for x in components(spark.createDataFrame(edges, "m long, id long")).collect()}
    assert out == {(n, root(n)) for e in edges for n in e}


def test_query(spark, sf):
    docs = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op8_near_duplicates(spark, sf)) == brute(docs, 3, 85)


def test_long_words(spark):
    from tests.llm.test_substrings import thue_morse

    x, y = thue_morse(1024)
    rows = [(1, x), (2, y), (3, f"a b {x}"), (4, f"a b {y}"), (5, "q" * 50_000), (6, "q" * 50_000), (7, f"A B {x}")]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("share", [0.7, 0.84])
def test_texts_of_one_template(spark, monkeypatch, share):
    """Most of each text is a template; some are near copies of each other besides."""
    monkeypatch.setattr("veilframe.llm.near_dup.BLOCK", 16)
    r = random.Random(12)
    word = lambda: str(r.randint(0, 10**7))
    template = [word() for _ in range(int(200 * share))]
    rows = []
    for k in range(150):
        own = template + [word() for _ in range(200 - len(template))]
        rows.append((k, " ".join(own)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(own[:-3])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs, shingle=3, percent=85)) == brute(rows, 3, 85)


def test_other_ids(spark):
    rows = [(f"d{i:03}", t) for i, t in made(3, groups=6)] + [("zz", "one")]
    docs = spark.createDataFrame([*rows, (None, "one")], "doc_id string, text string")
    out = [x for x in near_duplicates(docs, shingle=3, percent=85).collect()]
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in out if x["doc_id"]) == brute(rows, 3, 85)
    assert [(x["component_id"], x["kept"]) for x in out if x["doc_id"] is None] == [(None, True)]


def test_stage_keeps_one_row_of_a_group(spark):
    t = " ".join(map(str, range(60)))
    rows = [(4, t, "a"), (4, t, "a"), (None, t, "b"), (None, "alone " + t[::-1], "c"), (7, None, "d"), (7, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    from veilframe.llm.near_dup import stage

    assert sorted(map(str, map(tuple, stage(spark, docs, "").collect()))) == sorted(map(str, [rows[0], *rows[3:]]))


def test_template_pages_are_not_all_compared(spark, monkeypatch):
    """1,500 pages of one template a little below the threshold, some of them similar enough: all links, few copies of each set."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrst", k=8))
    menu = [word() for _ in range(172)]
    docs = [(k, " ".join(menu + [word() for _ in range(23)])) for k in range(1500)]
    for k in range(0, 60, 2):  # 30 pairs that differ by their last words only
        w = docs[k][1].split()
        docs[k + 1] = (k + 1, " ".join(w[:-3] + [word() for _ in range(3)]))
    told = {}
    of = near_dup._block_links
    monkeypatch.setattr(near_dup, "_block_links", lambda rows, percent: told.update(rows=rows.count(), sets=rows.select("id").distinct().count()) or of(rows, percent))
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    # Few and short bands: all pages of the template share buckets.
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(df, shingle=3, percent=85, perms=4, rows=1).collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, w in ((k, t.split()) for k, t in docs)}
    assert 0.75 < len(sets[100] & sets[101]) / len(sets[100] | sets[101]) < 0.85
    assert got == {k: k - 1 if k < 60 and k % 2 else k for k, _ in docs}
    assert told["rows"] < 3 * len(docs), told


def test_size_classes():
    """Each pair that is similar enough has a class pair in common, and a rare shingle in both prefixes."""
    for percent in (80, 85):
        for n in (1, 2, 5, 19, 64, 333, 1000):
            for m in range(-(-percent * n // 100), 100 * n // percent + 1):
                of_n, of_m = dict(near_dup.size_classes(n, percent)), dict(near_dup.size_classes(m, percent))
                both = -(-percent * (n + m) // (100 + percent))
                assert of_n[near_dup.size_class(m)] >= n - both + 1 and of_m[near_dup.size_class(n)] >= m - both + 1
