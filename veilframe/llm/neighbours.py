"""Approximate nearest neighbours: an inverted multi-index.

Each half of a vector is quantised by centroids of its own, so that k centroids a
half cut the space into k * k cells.  A query's cells are walked in the order of
the summed squared distances to their two centroids, by a heap over the two sorted
lists, until the cells walked hold enough vectors; all of these are compared by
their true distance.

1. Vectors that are equal are one entry, with the smallest ids that hold it (one
   more than the answers asked for is enough, so the list is bounded).
2. Centroids: k-means on at most ``train_rows`` entries (picked by a hash, the only
   sample); every entry is indexed.
3. Entries are dealt by their first centroid, and there into blocks of BLOCK rows;
   a query goes once to each block that it visits, with a bit for each second
   centroid.  Queries are dealt into blocks as well, so that a task holds one block
   of entries and streams one block of queries, whatever the largest cell holds.
   A task tells the nearest entries of each query, never pairs.
4. The nearest of all blocks, then the entries' ids, nearest first, ties to the
   smaller id.

``share`` is the share of all entries that a query visits at least, and ``least`` a
number of them: tables of fewer are searched whole.  With ``share`` = 1 the search is
exact.  Vectors without structure need a large share; those with clusters a small one.

Defined results: vectors that are null, zero, hold a null or a component that is not
finite, or whose length is not the commonest one (ties: the larger), take no part, as
queries or answers; the same for a null id.  Ids are whole numbers; a query never
finds its own.  Rows that repeat id and vector are one; an id with several vectors
is a query with each of them (ranks begin anew), and is found once a vector.  Extra
columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegralType

from .common import drop, meet, table

BLOCK = 16_384
#: A bit of a long for each second centroid.
MOST_CENTROIDS = 64
#: Distances of so many queries to a block are held at once.
AT_ONCE = 256


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids of the rows; begins with evenly spaced rows, as they come in an order without meaning."""
    k = max(1, min(k, len(rows)))
    centroids = rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)]
    for _ in range(rounds):
        own = squared(rows, centroids).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, own, rows)
        centroids = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
    return centroids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the scalar product; for order only."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> np.ndarray:
    """The cells of one query, as a bit set of second centroids for each first one.

    ``first`` and ``second`` are its squared distances to the centroids, ``held`` the
    entries of each cell.  Cells are taken by summed distance until ``enough`` entries are held.
    """
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    d1, d2, n = first[a].tolist(), second[b].tolist(), held[np.ix_(a, b)].tolist()
    cells = [0] * len(first)
    heap, ia, ib, got = [(d1[0] + d2[0], 0, 0)], a.tolist(), b.tolist(), 0
    while heap and got < enough:
        _, x, y = heapq.heappop(heap)
        if n[x][y]:
            got += n[x][y]
            cells[ia[x]] |= 1 << ib[y]
        if y + 1 < len(d2):
            heapq.heappush(heap, (d1[x] + d2[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(d1):  # each cell has one way to it
            heapq.heappush(heap, (d1[x + 1] + d2[0], x + 1, 0))
    return np.array(cells, np.uint64)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def _nearest(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """(q1, q2, score, ids): the ``most`` nearest entries of each query in each task, from rows (task, side, b, k1, k2, v, ids) sorted by task and side.

    Side 0 are a block's entries, with b their second centroid; side 1 are queries, with b their cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None

        def told(queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            v, bits, ids, norms = block
            q, cells = _matrix(queries.column("v"), dim), queries.column("b").to_numpy().view(np.uint64)
            for lo in range(0, len(q), AT_ONCE):
                some, visits = q[lo : lo + AT_ONCE], (cells[lo : lo + AT_ONCE, None] & bits[None, :]) != 0
                d = np.where(visits, (some * some).sum(1)[:, None] + norms[None, :] - 2 * (some @ v.T), np.inf)
                which, at, score = [], [], []
                for k in range(len(some)):
                    row = d[k]
                    cut = np.partition(row, most - 1)[most - 1] if len(row) > most else np.inf
                    # The scalar product only picks: what lies within its error of the last place is measured.
                    near = np.flatnonzero((row <= cut + 1e-9 * (1 + abs(cut))) & visits[k]) if np.isfinite(cut) else np.flatnonzero(visits[k])
                    diff = v[near] - some[k]
                    true = np.sqrt((diff * diff).sum(1))
                    best = np.lexsort((first[near], true))[:most]
                    which += [lo + k] * len(best)
                    at.append(near[best])
                    score.append(true[best])
                pick = queries.take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([pick.column("k1"), pick.column("k2"), pa.array(np.concatenate(score)), ids.take(pa.array(np.concatenate(at), pa.int64()))], names=["q1", "q2", "score", "ids"])

        first = np.zeros(0, np.int64)
        for batch in batches:
            task, side = batch.column("task").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(task)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if task[lo] != now:
                    now, held, block = task[lo], [], None
                if side[lo] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if block is None:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    v, ids = _matrix(whole.column("v"), dim), whole.column("ids")
                    block = v, np.uint64(1) << whole.column("b").to_numpy().view(np.uint64), ids, (v * v).sum(1)
                    first = np.array([x[0].as_py() for x in ids], np.int64)
                yield from told(part)

    return rows.select("task", "side", "b", "k1", "k2", "v", "ids").mapInArrow(run, "q1 long, q2 long, score double, ids array<long>")


def nearest_neighbours(rows: DataFrame, queries: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = 64, share: float = 0.55, least: int = 2048, train_rows: int = 16_384) -> DataFrame:
    """The k nearest rows found of each row that ``queries`` (a condition on ``id_col``) picks.

    Columns: query_id, rank (from 1), ``id_col``, score (Euclidean distance of the original vectors).
    """
    if not 1 <= centroids <= MOST_CENTROIDS:
        raise ValueError(f"centroids: 1 to {MOST_CENTROIDS}")
    if not isinstance(rows.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col}: ids are whole numbers")
    spark = rows.sparkSession
    number = "float" if rows.schema[vector_col].dataType in (ArrayType(FloatType(), True), ArrayType(FloatType(), False)) else "double"
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("v"), queries.alias("asks"))
    fine = F.size("v") > 0
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    src = src.filter("id IS NOT NULL AND v IS NOT NULL").filter(fine).withColumns({"k1": F.xxhash64(F.lit(1), "v"), "k2": F.xxhash64(F.lit(2), "v")})
    common = src.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dim = common["dim"]
    src = src.filter(F.size("v") == dim)
    # The k + 1 smallest ids of equal vectors; Spark limits each group before it shuffles.
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    few = src.groupBy("k1", "k2", "id").agg(F.first("v").alias("v")).withColumn("place", place).filter(F.col("place") <= k + 1)
    entries = few.groupBy("k1", "k2").agg(F.min_by("v", "id").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))
    entries = table(entries, "entries")
    n = entries.count()
    picked = entries.filter(F.pmod(F.xxhash64("k2", "k1"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 2 * train_rows / n))))
    sample = picked.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(train_rows).select("v").toArrow()
    trained = _matrix(sample.column("v").combine_chunks(), dim)
    half = dim // 2
    books = spark.sparkContext.broadcast((k_means(trained[:, :half], centroids if half else 1), k_means(trained[:, half:], centroids)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            a, b = squared(v[:, :half], one).argmin(1), squared(v[:, half:], two).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int64())], names=["k1", "k2", "v", "ids", "a", "b"])

    indexed = table(entries.select("k1", "k2", "v", "ids").mapInArrow(assign, f"k1 long, k2 long, v array<{number}>, ids array<long>, a int, b long"), "indexed")
    counts = indexed.groupBy("a", "b").count().toArrow()  # a row for each cell: centroids * centroids at most
    held = np.zeros([len(x) for x in books.value], np.int64)
    held[counts.column("a").to_numpy(), counts.column("b").to_numpy()] = counts.column("count").to_numpy()
    enough = max(int(np.ceil(share * n)), least)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                v = _matrix(part.column("v"), dim)
                d1, d2 = squared(v[:, :half], one), squared(v[:, half:], two)
                cells = np.array([walk(x, y, held, enough) for x, y in zip(d1, d2, strict=True)], np.uint64).reshape(len(v), -1)
                row, a = np.nonzero(cells)
                pick = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*pick.columns, pa.array(a, pa.int32()), pa.array(cells[row, a].view(np.int64))], names=["k1", "k2", "v", "a", "b"])

    asked = src.filter("asks").select("id", "k1", "k2").distinct()
    asked = table(asked, "asked")
    keys = asked.select("k1", "k2").distinct()
    visits = entries.join(keys, ["k1", "k2"], "left_semi").select("k1", "k2", "v").mapInArrow(visit, f"k1 long, k2 long, v array<{number}>, a int, b long")
    # Blocks of each first centroid, on both sides: a row of two small numbers for each, as literals.
    rows_of = held.sum(1).tolist()
    n_queries = asked.count()
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-x // BLOCK))) for x in rows_of]), F.col("a") + 1)
    q_blocks = F.lit(max(1, -(-n_queries // BLOCK)))
    own = F.xxhash64(F.lit(3), "k1", "k2")
    upto = lambda c: F.sequence(F.lit(0), c - 1)
    task = F.col("a") + MOST_CENTROIDS * (F.col("eb").cast("long") * q_blocks + F.col("qb"))
    left = indexed.withColumn("eb", F.pmod(own, blocks).cast("int")).select("*", F.explode(upto(q_blocks)).alias("qb"))
    right = visits.withColumn("qb", F.pmod(own, q_blocks).cast("int")).select("*", F.explode(upto(blocks)).alias("eb"))
    left = left.select(task.alias("task"), F.lit(0).alias("side"), "b", "k1", "k2", "v", "ids")
    right = right.select(task.alias("task"), F.lit(1).alias("side"), "b", "k1", "k2", "v", F.array().cast("array<long>").alias("ids"))
    dealt = left.unionByName(right).repartition("task").sortWithinPartitions("task", "side")
    found = table(_nearest(dealt, dim, k + 1), "found")
    best = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("score", F.col("ids")[0]))
    near = found.withColumn("best", best).filter(F.col("best") <= k + 1).groupBy("q1", "q2").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    near = table(near.withColumnsRenamed({"q1": "k1", "q2": "k2"}), "near")
    pairs = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("id")))))
    pairs = F.slice(F.array_sort(F.filter(pairs, lambda x: x["id"] != F.col("id"))), 1, k)
    out = meet(asked, near, ["k1", "k2"], "id").select(F.col("id").alias("query_id"), F.posexplode(pairs).alias("at", "x"))
    drop(entries, indexed, found)
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
