"""Substring dedup: repeated word windows by prefix-partitioned suffix trees.

A suffix is the text from one word on.  In a suffix tree, the deepest internal
node above a suffix tells how many of its first words also start elsewhere; where
that depth is ``window`` words or more, those words are a repeat.  The tree is
never built whole:

1. Sparse suffixes.  In every window the word 8-gram with the smallest hash
   (leftmost of equals) is its anchor.  Equal windows have equal anchors, so
   anchors that occur once are leaves of their own and end here.  Only
   (hash, text key, position) of about 7 % of the words is shuffled.
2. Prefix partitions.  Suffixes are split by the anchor.  Where more than
   ``group_rows`` suffixes share an anchor, equal segments are made one first
   (they are repeats already); if that is not enough, suffixes are split by longer
   and longer prefixes of their own (16, 24 words, at last the whole window),
   until a group fits in memory.
3. Subtrees.  The words around the anchors are shipped themselves.  A task takes
   whole groups, gives equal words equal numbers, sorts all suffixes by prefix
   doubling, and computes the longest common prefix of neighbours: the deeper of
   a leaf's two neighbours is its parent node.  A group that is still too large
   at full depth needs no tree: its rows are dealt over salts and equal words are
   neighbours; salts with one suffix are settled in a second step.
4. Overlapping repeats of a text are joined to maximal ranges and removed.

Repeats are told by the words, not by hashes: hashes only bring rows together.
Copies of a text are found by a 128-bit content key and stand in the tree once.
Texts are shuffled once, by that key.

Defined results: null or wordless text: no words, empty kept text; texts shorter
than the window lose nothing; repeated rows count as other places, so copies of
at least ``window`` words lose all words; ids may be null or repeated; extra
columns are ignored; words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grams, joined, meet, row_bounds, signed, slices, table, text_key, words

ANCHOR = 8
_POS = np.uint64((1 << 24) - 1)
HOT_SALTS = 64
BATCH = 4096
#: End of the range of a whole text.
WHOLE = 2**31 - 1


def anchors(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, number of windows) of each run of windows that share an anchor."""
    n = len(h) - window + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    g = grams(h, ANCHOR)
    span = window - ANCHOR + 1
    at = np.empty(n, np.int64)
    step = 1 << 23
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        v = (g[lo : hi + span - 1] & ~_POS) | np.arange(hi - lo + span - 1, dtype=np.uint64)
        width, low, done = 1, v, None
        left = span
        offset = 0
        while left:  # the minimum over span values, from minima over powers of two
            if left & width:
                part = low[offset : offset + hi - lo]
                done = part if done is None else np.minimum(done, part)
                offset += width
                left ^= width
            if left:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
        at[lo:hi] = (done & _POS).astype(np.int64) + lo
    start = np.flatnonzero(row[:n] == row[window - 1 :])
    p = at[start]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    return p[first], start[first], np.diff(np.append(first, len(p)))


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    """(h, k1, pos): the anchors of every text; copies in one batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, own = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_index=True)
            for lo, hi, data, offs in slices(batch.column(0).take(pa.array(own))):
                _, _, h, row = words(data, offs)
                p, _, _ = anchors(h, row, window)
                g = grams(h, ANCHOR)
                bounds = row_bounds(row, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[p])), pa.array(key[lo:hi][row[p]]), pa.array((p - bounds[row[p]]).astype(np.int32))], names=["h", "k1", "pos"])

    return docs.select("text", "k1").mapInArrow(run, "h long, k1 long, pos int")


_SUFFIX = ["key", "hot", "k1", "k2", "first", "n", "told"]
_SUFFIX_SCHEMA = "key long, hot boolean, k1 long, k2 long, first int, n int, told binary"
_WINDOW = ["p1", "p2", "full", "k1", "k2", "first", "told"]
_WINDOW_SCHEMA = "p1 long, p2 long, full long, k1 long, k2 long, first int, told binary"


def _suffix_rows(found: DataFrame, window: int) -> DataFrame:
    """Suffixes below anchors that recur, with their words (joined by blanks).

    A row per anchor and run of windows.  Rows come sorted by text key, so that
    copies of a text are neighbours, and only the first one is told.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            both = np.stack([cols[c].to_numpy(zero_copy_only=False) for c in ("k1", "k2")])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (both[:, 1:] != both[:, :-1]).any(0)
            new[:1] = before is None or (both[:, 0] != before).any()
            before = both[:, -1] if batch.num_rows else before
            own = pa.array(np.flatnonzero(new))
            texts, pos = cols["text"].take(own), cols["pos"].take(own)
            k1, k2 = both[:, new]
            for lo, hi, data, offs in slices(texts):
                start, stop, h, row = words(data, offs)
                p, a, c = anchors(h, row, window)
                if not len(p):
                    continue
                told, at = joined(data, start, stop)
                told = np.frombuffer(told, np.uint8)
                bounds = row_bounds(row, hi - lo)
                part = pos.slice(lo, hi - lo)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                state = np.zeros(len(h), np.int8)
                state[bounds[owner] + (flat >> 1)] = 1 + (flat & 1)
                g = grams(h, ANCHOR)
                mine = state[p] > 0
                q, b, m = p[mine], a[mine], c[mine] + window - 1
                for x in range(0, len(q), BATCH):
                    y = slice(x, x + BATCH)
                    r = row[q[y]]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(g[q[y]])), pa.array(state[q[y]] == 2), pa.array(k1[lo:hi][r]), pa.array(k2[lo:hi][r]), pa.array((b[y] - bounds[r]).astype(np.int32)), pa.array(m[y].astype(np.int32)), _pieces(told, at[b[y]], at[b[y] + m[y]] - 1)], names=_SUFFIX)

    return found.mapInArrow(run, _SUFFIX_SCHEMA)


def _windows(segments: DataFrame, window: int) -> DataFrame:
    """A row per window of (k1, k2, first, told), with hashes of its prefixes of two lengths and of its whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(3).cast(pa.string())):
                start, stop, h, row = words(data, offs)
                told, at = joined(data, start, stop)
                b = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
                r = row[b]
                prefixes = [pa.array(signed(grams(h, d)[b])) for d in (min(2 * ANCHOR, window), min(3 * ANCHOR, window), window)]
                k1, k2, first = (batch.column(i).to_numpy()[lo:hi][r] for i in range(3))
                yield pa.RecordBatch.from_arrays([*prefixes, pa.array(k1), pa.array(k2), pa.array((first + b - row_bounds(row, hi - lo)[r]).astype(np.int32)), _pieces(np.frombuffer(told, np.uint8), at[b], at[b + window] - 1)], names=_WINDOW)

    return segments.select("k1", "k2", "first", "told").mapInArrow(run, _WINDOW_SCHEMA)


def _pieces(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """data[a:b] of each pair, as one binary array."""
    offs = np.zeros(len(a) + 1, np.int32)
    np.cumsum(b - a, out=offs[1:])
    at = np.repeat(a - offs[:-1], b - a) + np.arange(offs[-1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offs), pa.py_buffer(data[at].tobytes())])


_RANGE = ["state", "full", "k1", "k2", "start", "end", "told"]
_RANGE_SCHEMA = "state byte, full long, k1 long, k2 long, start int, end int, told binary"


def _ranges(k1, k2, start, end) -> pa.RecordBatch:
    n = len(start)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), pa.nulls(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(end, np.int32)), pa.nulls(n, pa.binary())], names=_RANGE)


def sorted_suffixes(w: np.ndarray, left: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leaves in the order of their suffixes, and the longest common prefix of each with the one before.

    w: word numbers of segments laid end to end; left: words from each place to its segment's end.
    By doubling: rank k compares the first 2^k words.
    """
    ranks, step = [np.unique(w, return_inverse=True)[1] + 1], 1
    while step < left.max(initial=0):
        r = ranks[-1]
        nxt = np.zeros(len(r), np.int64)
        nxt[:-step] = r[step:]
        nxt[left <= step] = 0  # a suffix that ends comes first
        ranks.append(np.unique(r * (len(r) + 2) + nxt, return_inverse=True)[1] + 1)
        step *= 2
    order = leaves[np.argsort(ranks[-1][leaves], kind="stable")]
    x, y = order[1:].copy(), order[:-1].copy()
    common = np.zeros(len(x), np.int64)
    most = np.minimum(left[x], left[y])
    for k in range(len(ranks) - 1, -1, -1):
        r = ranks[k]
        fits = common + (1 << k) <= most
        same = fits & (r[np.minimum(x + common, len(r) - 1)] == r[np.minimum(y + common, len(r) - 1)])
        common += same << k
    return order, np.concatenate([[0], common]) if len(order) else common


def _deep_nodes(part: pa.Table, window: int) -> pa.RecordBatch | None:
    """Ranges below the deep internal nodes of the subtrees of whole groups."""
    lists = pc.split_pattern(part.column("told").combine_chunks().cast(pa.large_binary()), b" ")
    size = np.diff(lists.offsets.to_numpy())
    w = lists.flatten().dictionary_encode().indices.to_numpy()
    owner = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(w))
    leaves = np.flatnonzero(left >= window)
    order, common = sorted_suffixes(w, left, leaves)
    parent = np.maximum(common, np.append(common[1:], 0))  # depth of the node above each leaf
    deep = parent >= window
    if not deep.any():
        return None
    back = np.argsort(order[deep])
    at, depth = order[deep][back], parent[deep][back]
    o = owner[at]
    k1, k2, first = (part.column(c).to_numpy() for c in ("k1", "k2", "first"))
    start = first[o] + (at - (np.cumsum(size) - size)[o])
    # Neighbouring leaves of a segment make one range.
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | (o[1:] != o[:-1])
    b = np.flatnonzero(head)
    end = np.maximum.reduceat(start + depth, b)
    return _ranges(k1[o[b]], k2[o[b]], start[b], end)


def _subtrees(window: int):
    """Rows sorted by key come as a stream; a prefix group is complete when the next key comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in parts) > 1 and (out := _deep_nodes(pa.Table.from_batches(parts), window)) is not None:
                yield out

        held: list[pa.RecordBatch] = []
        for big in batches:
            for lo in range(0, big.num_rows, BATCH):
                batch = big.slice(lo, BATCH)
                keys = batch.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut or held and held[0].column("key")[0].as_py() != keys[-1]:
                    yield from whole([*held, batch.slice(0, cut)])
                    held = [batch.slice(cut)]
                else:
                    held.append(batch)
        yield from whole(held)

    return run


def _equal_words(window: int, last: bool):
    """Rows (full, told, ...) sorted by both: rows whose words are equal are repeats.

    The first row of each run is told once more, in state 1, for the other salts; not if this is the ``last`` step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([*([before] if before is not None else []), batch]).combine_chunks()
            full, told = part.column("full").to_numpy(), part.column("told").combine_chunks().dictionary_encode().indices.to_numpy()
            same = np.zeros(part.num_rows + 1, bool)
            same[1:-1] = (full[1:] == full[:-1]) & (told[1:] == told[:-1])
            many = same[1:] | same[:-1]
            lone = ~same[:-1]
            lone[:1] &= before is None
            k1, k2, first = (part.column(c).to_numpy() for c in ("k1", "k2", "first"))
            yield _ranges(k1[many], k2[many], first[many], first[many] + window)
            if lone.any() and not last:
                x = part.filter(pa.array(lone)).combine_chunks()
                n = x.num_rows
                start = x.column("first").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int8)), *(x.column(c).combine_chunks() for c in ("full", "k1", "k2")), start, pa.array(start.to_numpy() + np.int32(window)), x.column("told").combine_chunks()], names=_RANGE)
            before = batch.slice(batch.num_rows - 1)

    return run


def repeated_ranges(docs: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(k1, found): for each text key the repeated word ranges, with the second half of the key."""
    found = _anchor_rows(docs, window)
    many = table(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", (F.col("n") > group_rows).cast("int").alias("hot")), "anchor-counts")
    any_hot = not many.filter("hot = 1").isEmpty()
    places = table(found.join(many, "h").groupBy("k1").agg(F.collect_set((F.col("pos") * 2 + F.col("hot")).cast("int")).alias("pos")), "anchor-places")
    suffixes = _suffix_rows(docs.join(places, "k1").select("k1", "k2", "text", "pos"), window)
    suffixes = table(suffixes, "suffixes")
    fits = suffixes.filter("NOT hot").select("key", "k1", "k2", "first", "told")
    copies = docs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2", F.lit(0).alias("start"), F.lit(WHOLE).alias("end"))
    told = ["k1", "k2", "start", "end"]
    done = []
    if any_hot:
        # Equal segments below a hot anchor are repeats; each kind stands in the tree once.
        hot = suffixes.filter("hot")
        kinds = table(hot.groupBy("key", "told").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("k1", "k2", "first")]), "segments")
        again = table(kinds.filter("n > 1").select("key", "told"), "equal-segments")
        equal = meet(hot, again, ["key", "told"], "k1", small_rows=20_000)
        done.append(equal.select("k1", "k2", F.col("first").alias("start"), (F.col("first") + F.col("n")).alias("end")))
        large = table(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).select("key", F.lit(True).alias("large")), "large-groups")
        kinds = meet(kinds.drop("n"), large, "key", "k1", "left")
        fits = fits.union(kinds.filter("large IS NULL").select("key", "k1", "k2", "first", "told"))
        if not large.isEmpty():
            rest = table(_windows(kinds.filter("large"), window), "windows")
            for p in ("p1", "p2"):  # longer prefixes, where a group does not fit
                large = table(rest.groupBy(p).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).select(p, F.lit(True).alias("large")), "large-groups")
                rest = meet(rest, large, p, "full", "left")
                small = rest.filter("large IS NULL").select(F.col(p).alias("key"), "k1", "k2", "first", "told")
                fits, rest = fits.union(small), rest.filter("large").drop("large")
            salt = F.pmod(F.xxhash64("k1", "first"), F.lit(HOT_SALTS)).cast("int")
            row = ["full", "k1", "k2", "first", "told"]
            dealt = rest.withColumn("salt", salt).repartition("full", "salt").sortWithinPartitions("salt", "full", "told").select(*row)
            out = table(dealt.mapInArrow(_equal_words(window, False), _RANGE_SCHEMA), "full-depth")
            lone = out.filter("state = 1").select("full", "k1", "k2", F.col("start").alias("first"), "told")
            lone = lone.repartition("full").sortWithinPartitions("full", "told").select(*row).mapInArrow(_equal_words(window, True), _RANGE_SCHEMA)
            done += [out.filter("state = 0").select(*told), lone.select(*told)]
    trees = fits.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window), _RANGE_SCHEMA).select(*told)
    for x in [copies, *done]:
        trees = trees.union(x)
    grouped = trees.groupBy("k1").agg(F.collect_set(F.struct("k2", "start", "end")).alias("found"))
    return grouped.mapInArrow(_joined, "k1 long, found array<long>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping repeats become maximal ranges: k2, start, end laid flat."""
    for batch in batches:
        rows = []
        for found in batch.column(1).to_pylist():
            flat: list[int] = []
            for k2, a, b in sorted((x["k2"], x["start"], x["end"]) for x in found):
                if flat and flat[-3] == k2 and a <= flat[-1]:
                    flat[-1] = max(flat[-1], b)
                else:
                    flat += [k2, a, b]
            rows.append(flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["k1", "found"])


def dedup_substrings(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", window: int = 35, group_rows: int = 20_000) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, kept (its words that stay, joined by one space)."""
    k1, k2 = text_key(F.col(text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    # The texts' exchange by k1 serves this join and the one inside; both sides
    # come straight from exchanges, so a key with many copies is split at run time.
    joined = src.join(repeated_ranges(src, window, group_rows), "k1", "left").select("id", "text", "k2", "k1", "found")
    kind = src.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_cut(window), f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, gone, kept = [], [], []
                for text, k2, found in zip(part.column("text"), part.column("k2").to_pylist(), part.column("found").to_pylist(), strict=True):
                    w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                    left, at = [], 0
                    for own, a, b in zip(found[::3], found[1::3], found[2::3], strict=True) if found else ():
                        if own == k2 and len(w) >= window:
                            left += w[at:a]
                            at = b
                    left += w[at:]
                    n.append(len(w))
                    gone.append(len(w) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
