"""Periodic runs of words: maximal pairs of an LCP-interval tree.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``times`` * q and ``least`` words long, that no neighbouring
word extends.  It shows as a maximal pair: its beginning and the word q further on
both begin the same L = length - q words, are preceded by different words and
followed by different ones.  So the pairs (i, j) of a suffix tree's interval of
depth L whose distance d meets L >= (times - 1) * d and L + d >= ``least`` are the
runs, and nothing is extended word by word.

Inside a task, for some rows at a time:

1. Only suffixes whose first ``seed`` words recur in the same text can be leaves of
   intervals deep enough; ``seed`` is the least L that the two conditions allow.
   Texts none of whose recurring words stand close enough, for long enough, have no
   run and are left here.
2. These suffixes are sorted by prefix doubling; the ranks of each doubling give the
   longest common prefix (LCP) of neighbours.
3. Leaves whose deepest interval is too shallow for their nearest recurrence go.
4. Over the rest, intervals are closed bottom-up.  An interval keeps its positions
   in text order, each with its left word's class; when two intervals meet at a
   depth, each position of the smaller one looks at its neighbours of another class
   in the larger one.  The partner that tells a run's smallest period is always a
   neighbour: an occurrence between the two would give a smaller period.  Of pairs
   over the same stretch the smallest distance is the period.

Words are compared by 64-bit hashes, texts apart by their row.  Cost: n log n of the
recurring suffixes; memory: some MB of text, or one text if it is longer.

Defined results: null and empty texts have no words, no runs and an empty collapsed
text; rows are independent, so repeated rows and ids give repeated results, and a
null id is kept; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grams, joined, mixed, row_bounds, slices, words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.int64(1) << np.int64(60)


def _sorted_suffixes(v: np.ndarray, recurs: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes at ``recurs`` (all whose first ``seed`` words recur) in lexical order, and the LCP of each with the one before (0: less than ``seed``)."""
    at = np.union1d(recurs, recurs + seed)  # what follows a recurring gram orders it
    place = np.full(len(v), -1, np.int64)
    place[at] = np.arange(len(at))
    keys = [v[at + k] for k in range(seed)]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(at), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    slots = np.arange(len(at))
    rank = np.empty(len(at), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, slots, 0))
    ranks, size = [rank], seed
    while True:
        r = rank[order]
        tied = np.zeros(len(at), bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        slot = np.flatnonzero(tied)
        if not len(slot):
            break
        own = order[slot]
        then = rank[place[at[own] + size]]
        by = np.lexsort((then, rank[own]))
        own, then = own[by], then[by]
        new = np.ones(len(own), bool)
        new[1:] = (rank[own[1:]] != rank[own[:-1]]) | (then[1:] != then[:-1])
        order[slot] = own
        after = rank.copy()
        after[own] = np.maximum.accumulate(np.where(new, slot, 0))
        rank = after
        ranks.append(rank)
        size *= 2
    first = ranks[0][order]
    pairs = np.flatnonzero(first[1:] == first[:-1]) + 1
    a, b = at[order[pairs - 1]], at[order[pairs]]
    lcp = np.zeros(len(pairs), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = place[a + lcp], place[b + lcp]
        lcp += np.where((x >= 0) & (y >= 0) & (ranks[k][x] == ranks[k][y]), seed << k, 0)
    going = np.ones(len(pairs), bool)
    for _ in range(seed - 1):
        going &= v[a + lcp] == v[b + lcp]
        lcp += going
    out = np.zeros(len(at), np.int64)
    out[pairs] = lcp
    return at[order], out


def _maximal_pairs(leaves: list[int], lcps: list[int], left: list[int], least: int, times: int) -> dict[tuple[int, int], int]:
    """{(start, length): smallest period} of the leaves in suffix order, each with its LCP to the leaf before and the class of its left word."""
    found: dict[tuple[int, int], int] = {}
    classes = dict(zip(leaves, left, strict=True))

    def meet(a: list[int], b: list[int], depth: int) -> list[int]:
        big, small = (a, b) if len(a) >= len(b) else (b, a)
        reach = depth // (times - 1)
        for x in small:
            k = bisect_left(big, x)
            c = classes[x]
            for y in big[max(k - 1, 0) : k + 1]:
                d = x - y if x > y else y - x
                if d <= reach and d + depth >= least and classes[y] != c:
                    stretch = (x if x < y else y), depth + d
                    if found.get(stretch, d) >= d:
                        found[stretch] = d
        if 4 * len(small) > len(big):
            big.extend(small)
            big.sort()
        else:
            for x in small:
                insort(big, x)
        return big

    open_: list[tuple[int, list[int]]] = []  # (LCP with what stands before it, positions)
    for leaf, lcp in zip([*leaves, -1], [*lcps, 0], strict=True):
        while len(open_) > 1 and open_[-1][0] > lcp:
            depth, own = open_.pop()
            before, other = open_.pop()
            open_.append((before, meet(other, own, depth)))
        if not lcp:
            open_.clear()
        open_.append((lcp, [leaf]))
    return found


def runs_of(h: np.ndarray, cuts: np.ndarray, least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run, sorted, of each text; ``h`` are the word hashes of all texts, ``cuts`` where each begins (and the end)."""
    n_rows, n = len(cuts) - 1, np.diff(cuts)
    seed = min(max(least - d, (times - 1) * d) for d in range(1, least + 1))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_rows)]
    # A word of its own before each text and some at the end, so that nothing reaches over an end.
    row = np.repeat(np.arange(n_rows), n)
    pos = np.arange(len(h)) + row + 1
    total = len(h) + n_rows + 2 * seed + 1
    v = mixed((np.arange(total, dtype=np.uint64) + np.uint64(1 << 62)) * _ODD)
    v[pos] = mixed(h + row.astype(np.uint64) * _ODD)
    real = np.zeros(total + 1, np.int64)
    real[pos + 1] = 1
    real = np.cumsum(real)
    g = grams(v, seed)
    own = np.flatnonzero(real[seed : seed + len(g)] - real[: len(g)] == seed)
    by = own[np.argsort(g[own], kind="stable")]
    same = g[by[1:]] == g[by[:-1]]
    near = np.full(total, _FAR)
    gap = by[1:] - by[:-1]
    near[by[1:][same]] = gap[same]
    near[by[:-1][same]] = np.minimum(near[by[:-1][same]], gap[same])
    recurs = near < _FAR
    # Words from here on whose grams recur without a break.
    ends = np.where(recurs, total, np.arange(total))
    stretch = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(total)
    want = np.maximum((times - 1) * near, least - near)
    leaf = recurs & (stretch + seed - 1 >= want)
    if not leaf.any():
        return out
    row_at = np.full(total, n_rows)
    row_at[pos] = row
    some = np.zeros(n_rows + 1, bool)
    some[row_at[leaf]] = True
    sa, lcp = _sorted_suffixes(v, np.flatnonzero(recurs & some[row_at]), seed)
    deepest = np.maximum(lcp, np.append(lcp[1:], 0))
    keep = np.flatnonzero(leaf[sa] & (deepest >= want[sa]))
    if len(keep) < 2:
        return out
    between = np.minimum.reduceat(lcp[: keep[-1] + 1], keep[:-1] + 1)
    leaves = sa[keep]
    found = _maximal_pairs(leaves.tolist(), [0, *between.tolist()], v[leaves - 1].tolist(), least, times)
    for (start, length), period in found.items():
        k = int(row_at[start])
        out[k].append((start - 1 - k - int(cuts[k]), length, period))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least: int = 6, times: int = 4) -> DataFrame:
    """One row per document: ``id_col``, n_words, runs (start, length, period in words, by start and period), collapsed (the words outside any run's repetitions, joined by one space).

    ``least``: words of the shortest run (2 at least); ``times``: periods that a run holds at least (3 at least).
    """
    if least < 2 or times < 3:
        raise ValueError("least: 2 or more; times: 3 or more")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1)):
                start, stop, h, row = words(data, offs)
                cuts = row_bounds(row, hi - lo)
                found = runs_of(h, cuts, least, times)
                told, at = joined(data, start, stop)
                texts = []
                for k, runs in enumerate(found):
                    a, b = int(cuts[k]), int(cuts[k + 1])
                    if runs:
                        step = np.zeros(b - a + 1, np.int64)
                        for s, length, q in runs:
                            step[s + q] += 1
                            step[s + length] -= 1
                        kept = np.flatnonzero(np.cumsum(step[:-1]) == 0) + a
                        texts.append(b" ".join([told[x : y - 1] for x, y in zip(at[kept].tolist(), at[kept + 1].tolist(), strict=True)]))
                    else:
                        texts.append(told[at[a] : max(at[a], at[b] - 1)])
                sizes = np.array([len(x) for x in found])
                bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
                struct = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, j])) for j in range(3)], names=["start", "length", "period"])
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(bounds, struct), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "runs", "collapsed"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one in ten texts, told by a hash of its id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("w")).withColumn("n", F.size("w"))
    a = F.col("g") % F.greatest("n", F.lit(1))
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    taken = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("w", (1 + F.when(i < a, i).otherwise(a + (i - a) % p)).cast("int")))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(taken, " ")).otherwise(F.col("text")).alias("text"))


def _longest(field: str) -> Column:
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.abs(best[field])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    out = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[_longest(c).alias(c) for c in ("start", "length", "period")],
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
    return out.withColumn("exponent_milli", F.floor(1000 * F.col("length") / F.col("period")).cast("long"))
