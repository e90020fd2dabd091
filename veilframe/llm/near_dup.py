"""Near-duplicate documents: min-max hashing, exact confirmation, components.

Each document is a set of word shingles (ASCII lower case).  Under every
permutation both the smallest and the largest image are kept, so ``perms`` hash
evaluations give 2 * perms signature values; agreement of either is an unbiased
estimate of the Jaccard similarity, and bands of ``rows`` values are the bucket
keys.  With 72 permutations and 24 bands of 6, a pair at 0.85 meets in no bucket
with probability 1.2e-5 (at 0.8: 7e-4), while a pair at 0.5 meets in one in three.

1. Texts with the same words are one node (smallest id); copies never pair up.
2. In each bucket every node is confirmed against the bucket's smallest id, on
   full sets: a row per node and bucket, not per pair.
3. Components of these links.  Buckets whose nodes already lie in one component
   are done.  In all others the nodes of different components are compared, in
   blocks of bounded size, each pair of blocks a task of its own; a task tells one
   link per pair of components.  A bucket with more than BLOCK nodes outside its
   largest component is split first: two sets that are similar enough share one of
   the rarest n - ceil(t n) + 1 shingles of either, so only nodes that share such a
   shingle are compared.  What stays that large is split by size too: sets of n and m
   shingles share one of the rarest n - ceil(t (n + m) / (1 + t)) + 1 of either, about
   half as many if they are equally large, so a shingle of a template that many unlike
   texts share brings no pairs together.  Nothing is capped, and the order of shingles
   (a count of fixed size) changes only the cost.
4. Components over both kinds of links, by alternating stars whose hubs are
   dealt over salts; each round is written to the shared folder.

Defined results: no words or null text: empty set, linked with nothing, its own
component; fewer words than the shingle: the whole sequence is the one shingle;
rows with the same id are one node, whatever their texts; a null id is linked
with nothing, has a null component and is kept; ids may be of any type that has
an order (others than integers are hashed to 64 bits inside); extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import LOWER, drop, every_salt, grams, joined, lists, meet, mixed, row_bounds, salted, signed, slices, table, words

BLOCK = 256
CELLS = 20


def sets_of(texts: pa.Array, size: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(row, its words in lower case, sorted distinct shingle hashes) of each row."""
    for lo, hi, data, offs in slices(texts):
        start, stop, h, row = words(data, offs, lower=True)
        told, at = joined(LOWER[data], start, stop)
        g = grams(h, size)
        bounds = row_bounds(row, hi - lo)
        for k, (a, b) in enumerate(pairwise(bounds.tolist())):
            own = told[at[a] : at[b]]
            if b - a >= size:
                yield lo + k, own, np.unique(g[a : b - size + 1])
            elif b > a:
                yield lo + k, own, mixed(grams(h[a:b], b - a, 91))
            else:
                yield lo + k, own, h[a:b]


def min_max(shingles: np.ndarray, perms: int) -> np.ndarray:
    """Smallest and largest image of a set under each permutation, side by side."""
    r = np.random.default_rng(77)
    mult = r.integers(0, 2**63, perms, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    add = r.integers(0, 2**63, perms, dtype=np.uint64)[:, None]
    low, high = np.full(perms, 2**64 - 1, np.uint64), np.zeros(perms, np.uint64)
    for at in range(0, len(shingles), 8192):
        # A bijection of 64 bits: multiply, fold the high half in, multiply.
        x = shingles[None, at : at + 8192] * mult
        x ^= x >> np.uint64(32)
        x *= mult
        x += add
        low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
    return np.column_stack([low, high]).ravel()


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = len(signature) // rows
    s = signature[: bands * rows].reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
    return key


def sketches(docs: DataFrame, *, shingle: int, perms: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, bands) of documents (id, text): set size, digest of the words, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, d, keys, sizes = [], [], [], []
                for _, w, s in sets_of(part.column(1), shingle):
                    n.append(len(s))
                    d.append(hashlib.blake2b(w, digest_size=16).digest())
                    k = band_keys(min_max(s, perms), rows) if len(s) else np.zeros(0, np.uint64)
                    keys.append(k)
                    sizes.append(len(k))
                d = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists(signed(np.concatenate(keys)), sizes, pa.int64())], names=["id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(m, id) of the rows (m, id, text_m, text) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keep = []
                for (k, _, s), m, text_m in zip(sets_of(part.column("text"), shingle), part.column("m").to_pylist(), part.column("text_m"), strict=True):
                    if m != now:
                        now, own = m, next(sets_of(pa.array([text_m.as_py()], pa.string()), shingle))[2]
                    if similar(own, s, percent):
                        keep.append(k)
                yield part.select(["m", "id"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(run, "m long, id long")


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (m, id) between components, from rows (task, side, id, label, n, s) sorted by task."""

    def links(task: list[tuple]) -> Iterator[tuple[int, int]]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        task.sort(key=lambda r: r[3])
        both = any(r[0] for r in task) and not all(r[0] for r in task)
        for x, (side, i, label, n, s) in enumerate(task):
            for side_y, j, label_y, n_y, s_y in task[x + 1 :]:
                if 100 * n < percent * n_y:
                    break  # sorted by set size: all later ones are too large
                if both and side == side_y:
                    continue
                a, b = root(label), root(label_y)
                if a != b and similar(s, s_y, percent):
                    parent[max(a, b)] = min(a, b)
                    yield i, j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(task: list[tuple]) -> pa.RecordBatch:
            found = list(links(task))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["m", "id"])

        now, held = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [x.values.to_numpy(zero_copy_only=False) for x in part.column(5)]
                for t, s, *r in zip(part.column(0).to_pylist(), sets, *(c.to_pylist() for c in part.columns[1:5]), strict=True):
                    if t != now and held:
                        yield told(held)
                        held = []
                    now = t
                    held.append((*r, s))
        if held:
            yield told(held)

    return rows.select("task", "side", "id", "label", "n", "s").mapInArrow(run, "m long, id long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the links (m, id) with the smallest node that it reaches."""
    e = table(edges.select(F.least("m", "id").alias("u"), F.greatest("m", "id").alias("v")).filter("u < v").distinct(), "links")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("s")).first()
        if now == state:
            break
        state = now
        # Large star: every larger neighbour of x goes to the smallest node around x.
        sym = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = sym.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = _via(sym.filter("y > x"), least, "x", "y").select("y", "m").filter("y > m").distinct()
        large = table(large, "large-star")
        # Small star: smaller neighbours of y and y itself go to the smallest of them.
        small = large.groupBy("y").agg(F.min("m").alias("mm")).select(F.col("y"), "mm")
        moved = _via(large, small, "y", "m").filter("m > mm").select(F.col("mm").alias("u"), F.col("m").alias("v"))
        after = table(moved.union(small.select(F.col("mm").alias("u"), F.col("y").alias("v"))).distinct(), "small-star")
        drop(e, large)
        e = after
    return e.select(F.col("v").alias("node"), F.col("u").alias("label")).union(e.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct())


def _via(many: DataFrame, one: DataFrame, key: str, other: str) -> DataFrame:
    """many joined to the one row of each key, over salts, since a hub may hold a third of all links."""
    return many.withColumn("salt", salted(F.col(other))).join(one.withColumn("salt", every_salt()), [key, "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, percent: int = 80, perms: int = 72, rows: int = 6) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id (smallest id reachable), kept (is that document)."""
    options = {"shingle": shingle, "percent": percent, "perms": perms, "rows": rows}
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _named(docs, text_col, id_col, options)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = table(sketches(src, shingle=shingle, perms=perms, rows=rows), "sketches")
    some = sketch.filter("n > 0 AND id IS NOT NULL")
    nodes = table(some.groupBy("d1", "d2").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("n").alias("n")), "nodes")
    each = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = table(each.groupBy("key").agg(F.min("node").alias("m"), F.count(F.lit(1)).alias("size"), F.min_by("n", "node").alias("n_m")).filter("size > 1"), "buckets")
    inside = table(meet(each, buckets, "key", "node", small_rows=0), "bucket-members")  # buckets grow with the corpus
    # Only nodes that share a bucket need their texts again; their number grows with the corpus, so they are never broadcast.
    wanted = inside.select(F.col("node").alias("id")).distinct()
    texts = table(src.join(wanted.hint("merge"), "id", "left_semi"), "candidate-texts")
    # A set more than a fifth larger than another can't be similar enough: dropped exactly.
    fits = (F.lit(100) * F.least("n", "n_m") >= F.lit(percent) * F.greatest("n", "n_m")) & (F.col("node") != F.col("m"))
    pairs = inside.filter(fits).select("m", F.col("node").alias("id")).distinct()
    links = table(_confirm(_with_texts(pairs, texts), shingle, percent), "star-links")
    labels = table(components(links), "star-labels")
    told = table(inside.filter("size > 2").select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "bucket-labels")
    more = _cross_links(told, texts, shingle, percent)
    # Rows with one id are one node: their texts are linked.
    same_id = some.join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).filter("id != node").select(F.col("node").alias("m"), "id")
    final = table(components(labels.select(F.col("label").alias("m"), F.col("node").alias("id")).union(more).union(same_id)), "labels")
    drop(nodes, buckets, inside, texts, links, labels, told, more)
    label = sketch.select("id", F.col("n").alias("n_shingles")).join(final.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("label", "id")
    return label.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _named(docs: DataFrame, text_col: str, id_col: str, options: dict) -> DataFrame:
    """The same for ids that are no integers: nodes are their hashes, components are named by their smallest id."""
    node = F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    found = table(near_duplicates(docs.select(node.alias("node"), F.col(text_col).alias("text")), id_col="node", **options), "named")
    names = docs.select(node.alias("node"), F.col(id_col).alias("name")).dropna().distinct()
    least = found.select("node", "component_id").distinct().join(names, "node").groupBy("component_id").agg(F.min("name").alias("least"))
    out = found.join(names, "node", "left").join(least, "component_id", "left")
    return out.select(F.col("name").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.col("least").eqNullSafe(F.col("name")).alias("kept"))


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(m, id, text, text_m); the exchange of the texts by id serves both joins."""
    first = pairs.join(texts, "id")
    second = texts.select(F.col("id").alias("m"), F.col("text").alias("text_m"))
    return first.join(second, "m").select("m", "id", "text", "text_m")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, label, n, s): full sets of (id, label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [s for _, _, s in sets_of(part.column(2), shingle)]
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), lists(signed(np.concatenate(sets)), n, pa.int64())], names=["id", "label", "n", "s"])

    return texts.select("id", "label", "text").mapInArrow(run, "id long, label long, n long, s array<long>")


def _cell_counts(sets: DataFrame) -> bytes:
    """How many sets hold a shingle of each of 2^CELLS cells, as a byte of the logarithm: a fixed size, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            cell, n = np.unique(s >> np.uint64(64 - CELLS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(n)], names=["cell", "n"])

    got = sets.select("s").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELLS, np.uint8)
    out[got.column("cell").to_numpy()] = np.log2(got.column("n").to_numpy() + 1) * 8
    return out.tobytes()


def _open(told: DataFrame) -> DataFrame:
    """Groups of rows (key, node, label, part) that hold several parts and components: key, main (the largest part), n_main, size, members (a digest).

    Only nodes of different parts are compared: parts are components, or the two classes of sizes of a group.
    """
    labels = [F.min("label").alias("low"), F.max("label").alias("high")]
    kinds = told.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40))).alias("members"), *labels)
    groups = kinds.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("size"), F.sum("members").alias("members"), F.min("low").alias("low"), F.max("high").alias("high"))
    return table(groups.filter("size > n_main AND low < high").drop("low", "high"), "open-groups")


def size_classes(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, prefix) of each class of sizes that a set of n shingles can be similar enough to.

    A class is a range of sizes that differ by a fiftieth at most; with any set of it that is
    similar enough, the set shares one of its ``prefix`` rarest shingles, as the other does of its own.
    """
    out = []
    least, most = -(-percent * n // 100), 100 * n // percent
    c = size_class(least)
    while (low := first_size(c)) <= most:
        low = max(low, least)
        # Sets of n and m shingles need a common part of percent * (n + m) / (100 + percent) at least.
        both = -(-percent * (n + low) // (100 + percent))
        out.append((c, max(1, n - both + 1)))
        c += 1
    return out


def size_class(n: int) -> int:
    c = int(math.log(max(n, 1)) / math.log(1.02))
    while first_size(c + 1) <= n:
        c += 1
    while first_size(c) > n:
        c -= 1
    return c


def first_size(c: int) -> int:
    return math.ceil(1.02**c - 1e-9)


def _prefixes(sets: DataFrame, percent: int, by_size: bool) -> DataFrame:
    """(key, node, label, part, cross): each set with its rarest shingles, one of which it shares with any set that is similar enough.

    ``by_size``: with those rarest shingles that it shares with sets of each class of sizes; the
    closer two sizes are, the fewer.  So shingles of a template that many sets share by a little
    less than is needed bring them together no more.  A group of two classes is ``cross``: its
    parts are the two classes, and no two sets of one class are compared.
    """
    cells = sets.sparkSession.sparkContext.broadcast(_cell_counts(sets))

    def keys_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and for each the part: 0 below, 1 above, 2 neither (parts are components)."""
        n = len(own)
        if not by_size:
            keys = own[: n + percent * -n // 100 + 1]
            return keys, np.full(len(keys), 2)
        c, keys, parts = size_class(n), [], []
        for d, k in size_classes(n, percent):
            salt = np.uint64((min(c, d) * 100_003 + max(c, d)) * 0x9E3779B97F4A7C15 % (1 << 64))
            keys.append(mixed(own[:k] + salt))
            parts.append(np.full(min(k, n), 2 if c == d else int(c > d)))
        return np.concatenate(keys), np.concatenate(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.frombuffer(cells.value, np.uint8)
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                keys, parts = [], []
                for s in batch.column(2):
                    own = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                    order = np.lexsort((own, count[(own >> np.uint64(64 - CELLS)).astype(np.int64)]))
                    k, part = keys_of(own[order])
                    keys.append(k)
                    parts.append(part)
                each = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])
                node, label = (batch.column(i).to_numpy(zero_copy_only=False)[each] for i in range(2))
                part = np.concatenate(parts)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(node), pa.array(label), pa.array(np.where(part == 2, label, part)), pa.array(part != 2)], names=["key", "node", "label", "part", "cross"])

    return sets.select("id", "label", "s").mapInArrow(run, "key long, node long, label long, part long, cross boolean")


def _split(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (key, node, label, part, cross, and the group's counts) of open groups: large groups are split by shared rare shingles, and what stays large by size as well."""
    large = F.col("size") - F.col("n_main") > BLOCK
    out = members.filter(~large)
    for by_size in (False, True):
        hot = table(members.filter(large).select(F.col("node").alias("id")).distinct(), "hot")
        if hot.isEmpty():
            return out
        own = table(sets.join(hot.hint("merge"), "id", "left_semi"), "hot-sets")
        rare = table(_prefixes(own, percent, by_size), "prefixes")
        members = table(meet(rare, _open(rare), "key", "node"), "split")
        drop(hot, own, rare)
        out = out.unionByName(members if by_size else members.filter(~large))
    return out


def _cross_links(told: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between nodes of different components that share a bucket, beyond those with the bucket's smallest id.

    The largest part of a group (a component, or a class of sizes) is its main one.  Its
    members are dealt into blocks, the others ("outsiders") into blocks of their own; each
    main block meets each outsider block, and outsider blocks of components meet each
    other.  Members of the main part are never compared among themselves.
    """
    told = told.withColumns({"part": F.col("label"), "cross": F.lit(False)})
    open_ = _open(told)
    members = meet(told, open_, "key", "node")
    sets = table(_sets(members.select(F.col("node").alias("id"), "label").distinct().join(texts.dropDuplicates(["id"]), "id"), shingle), "open-sets")
    members = table(_split(members, sets, percent), "members")
    # Groups with the same members are one group.
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    one = members.groupBy("members", "size", "main", "n_main", "cross").agg(F.min("key").alias("key"))
    one = table(one.select("key", "main", blocks(F.col("n_main")).alias("mains"), blocks(F.col("size") - F.col("n_main")).alias("others")), "groups")
    rows = meet(members.select("key", "node", "part", "cross"), one, "key", "node").withColumn("inner", F.col("part") == F.col("main"))
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.when(F.col("inner"), F.col("mains")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    task = lambda kind, a, b: F.concat_ws(":", F.lit(kind), "key", a, b)
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    to = lambda t, side: F.struct(t.alias("task"), side.alias("side"))
    as_main = F.transform(upto("others"), lambda j: to(task("m", F.col("own"), j), F.lit(True)))
    as_other = F.transform(upto("mains"), lambda i: to(task("m", i, F.col("own")), F.lit(False)))
    among = F.transform(upto("others"), lambda j: to(task("o", F.least(F.col("own"), j), F.greatest(F.col("own"), j)), F.col("own") > j))
    rows = rows.select("node", F.explode(F.when(F.col("inner"), as_main).when(F.col("cross"), as_other).otherwise(F.concat(as_other, among))).alias("t"))
    rows = rows.select("t.task", "t.side", F.col("node").alias("id"))
    rows = rows.join(sets, "id").repartition("task").sortWithinPartitions("task")
    out = table(_block_links(rows, percent), "cross-links")
    drop(open_, sets, members, one)
    return out


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, unchanged: that of the smallest id; rows with a repeated id or none count as themselves."""
    row = "row"
    while row in docs.columns or row == "component_id":
        row += "_"
    rows = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, id_col=row).select(row, "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    first = rows.select(row, "doc_id").join(found, row).groupBy("component_id").agg(F.min(order)[row].alias(row))
    return rows.join(first, row, "left_semi").select(docs.columns)
