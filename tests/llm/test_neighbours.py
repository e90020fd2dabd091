"""Nearest neighbours against brute force: recall, exact mode, hot vectors and odd rows."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from veilframe.llm import neighbours
from veilframe.llm.neighbours import nearest_neighbours, op12_nearest_neighbours


def brute(rows, k, asks):
    """{query: [(score, id), ...]} over rows (id, vector)."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float64)
    out = {}
    for i, x in rows:
        if asks(i):
            d = np.sqrt(((v - np.array(x, np.float64)) ** 2).sum(1))
            out[i] = sorted((a, b) for a, b in zip(d.tolist(), ids.tolist(), strict=True) if b != i)[:k]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_query_recall(spark, folder):
    t = pq.read_table(f"/root/testdata/{folder}/embeddings.parquet")
    rows = list(zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist(), strict=True))
    want, got = brute(rows, 10, lambda i: i % 100 == 0), by_query(op12_nearest_neighbours(spark, f"/root/testdata/{folder}"))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    v = dict(rows)
    for q, found in got.items():
        assert found == sorted(found)
        for score, i in found:
            assert score == pytest.approx(np.linalg.norm(np.float64(v[q]) - np.float64(v[i])), rel=1e-12)
    hits = sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("block", [40, neighbours.BLOCK])
def test_exact_with_hot_vectors(spark, monkeypatch, block):
    """A share of 1 is exact: a vector that a third of the rows hold, ties, few centroids, blocks of 40."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    r = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0, 0.5, 1.0]) for k in range(0, 300, 3)] + [(k, r.integers(-3, 4, 5).astype(float).tolist() or 1) for k in range(1, 300, 3)]
    rows += [(k, (np.array([9.0, 9, 9, 9, 9]) + r.random(5) / 100).tolist()) for k in range(2, 300, 3)]
    rows = [(k, v) for k, v in rows if any(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = by_query(nearest_neighbours(df, F.col("vec_id") % 5 == 0, centroids=8, share=1.0, least=0, k=7))
    want = brute(rows, 7, lambda i: i % 5 == 0)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (8, []), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (11, [2.0, 0.0]), (11, [0.0, 3.0])]
    df = spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], "vec_id int, embedding array<float>, id int, v int, k1 int")
    got = by_query(nearest_neighbours(df, F.col("vec_id") % 5 == 0, k=10))
    assert got[0] == [(0.0, 9), (1.0, 11), (pytest.approx(2**0.5), 1), (pytest.approx(10**0.5), 11)]
    assert set(got) == {0}
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    one = by_query(nearest_neighbours(df.filter("vec_id IN (0, 1)"), F.lit(True)))
    assert one == {0: [(pytest.approx(2**0.5), 1)], 1: [(pytest.approx(2**0.5), 0)]}
    thin = spark.createDataFrame([(k, [float(k + 1)]) for k in range(50)], "vec_id long, embedding array<double>")
    assert [i for _, i in by_query(nearest_neighbours(thin, F.col("vec_id") == 0, k=3))[0]] == [1, 2, 3]
    with pytest.raises(TypeError):
        nearest_neighbours(df.withColumn("vec_id", F.lit("a")), F.lit(True))
