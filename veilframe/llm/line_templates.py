"""Line dedup by a log-template tree.

The tree has a fixed depth: a line (lower case, tokens between blanks) goes to
the leaf of its token count and its ``depth`` leading tokens, where a token with
a digit counts as a variable.  Inside a leaf a token is constant if it stands at
its place in at least ``min_docs`` different texts and in at least a share of the
leaf's texts, else it is a variable field.  Constants and fields make the line's
template, one for each share of ``SHARES``: leaves with many templates need a small
one, and fields with few values a large one.  A template whose constants are at
least ``similarity`` of its tokens without digits, and which stands in at least
``min_docs`` different texts, is recurring, and its lines are dropped.  Leaves
are counted, not scanned in order, so the result depends on no order and no leaf
must fit a task.

1. Leaves are counted over all texts; only (leaf, text key) is shuffled.
2. Lines of leaves that can recur are taken out.  A fixed-size bitmap of leaf
   hashes spares most others the shuffle; the exact join with the counted leaves
   decides.
3. Tokens, then templates are counted over different lines, so a line that a
   third of all documents share is one row.
4. Line numbers to drop meet the texts in one join, over salted content keys.

With ``groups`` a group of near copies counts as one text where templates are
counted, so that lines which only copies share stay.  With ``long_lines`` an equal
line recurs in fewer texts the longer it is: ``min_docs`` up to SHORT tokens, falling
evenly to two texts from LONG tokens on.

Defined results: copies of one text count as one text; null text: no lines,
stays null; lines without tokens are never dropped; with ``max_share`` below 1 a
text that would lose a larger share of its tokens is left whole; ids may be null or repeated; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_dup
from .common import every_salt, lists, mixed, signed, slices, table, text_key, words

#: Least and most bits of a leaf hash that the bitmap tells apart (512 KB to 16 MB).
BITS = (22, 27)
STAR = np.uint64(0x5EED)
TEXT_SALTS = 8
#: Least shares of a leaf's texts that make a token constant.
SHARES = (0.02, 0.1, 0.5)
SHORT, LONG = 10, 50


def lines_of(data: np.ndarray, offs: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """Each line with tokens: row, number, leaf, hash, first token, token count; and the token hashes."""
    start, stop, h, row = words(data, offs, lower=True)
    if not len(h):
        z = np.zeros(0, np.int64)
        return {"row": z, "number": z, "leaf": z.astype(np.uint64), "hash": z.astype(np.uint64), "first": z, "size": z, "tokens": h}
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x30) & (data <= 0x39), out=digits[1:])
    tokens = np.where(digits[stop] > digits[start], STAR, h)
    breaks = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(breaks, start)
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    leaf = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(depth):
        at = np.minimum(first + j, len(h) - 1)
        leaf = mixed(leaf * np.uint64(31) + np.where(size > j, tokens[at], np.uint64(j)))
    place = np.arange(len(h)) - np.repeat(first, size)
    whole = np.add.reduceat(mixed(h + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first)
    number = line[first] - np.searchsorted(breaks, offs[row[first]])
    return {"row": row[first], "number": number, "leaf": leaf, "hash": whole, "first": first, "size": size, "tokens": tokens}


def _leaves(docs: DataFrame, depth: int) -> DataFrame:
    """(leaf, k1, size): the different leaves of each text, and their token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in slices(batch.column(0)):
                x = lines_of(data, offs, depth)
                order = np.lexsort((x["leaf"], x["row"]))
                leaf, row, size = x["leaf"][order], x["row"][order], x["size"][order]
                own = np.ones(len(leaf), bool)
                own[1:] = (leaf[1:] != leaf[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(leaf[own])), pa.array(key[lo:hi][row[own]]), pa.array(size[own].astype(np.int32))], names=["leaf", "k1", "size"])

    return docs.select("text", "k1").mapInArrow(run, "leaf long, k1 long, size int")


def _lines(docs: DataFrame, bitmap, depth: int) -> DataFrame:
    """(leaf, line, k1, k2, number, tokens) of the lines whose leaf is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bitmap.value, np.uint8)
        bits = 3 + len(marked).bit_length() - 1
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for lo, hi, data, offs in slices(batch.column(0)):
                x = lines_of(data, offs, depth)
                at = (x["leaf"] >> np.uint64(64 - bits)).astype(np.int64)
                own = np.flatnonzero(marked[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                size, first, row = x["size"][own], x["first"][own], x["row"][own]
                each = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                yield pa.RecordBatch.from_arrays([pa.array(signed(x["leaf"][own])), pa.array(signed(x["hash"][own])), pa.array(k1[lo:hi][row]), pa.array(k2[lo:hi][row]), pa.array(x["number"][own].astype(np.int32)), lists(_short(x["tokens"][each]), size, pa.int32())], names=["leaf", "line", "k1", "k2", "number", "tokens"])

    return docs.select("text", "k1", "k2").mapInArrow(run, "leaf long, line long, k1 long, k2 long, number int, tokens array<int>")


def _short(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each token: inside one place of one leaf that is enough, and takes less room than the text."""
    return np.where(tokens == STAR, STAR, tokens >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _bitmap(leaves: DataFrame) -> bytes:
    """A bit for each bucket of leading bits that has a leaf: 8 to 16 buckets a leaf, between the sizes of BITS.

    It only saves shuffling; where it is full, the join with the counted leaves does all the work.
    """
    n = leaves.count()
    bits = min(max(BITS[0], (8 * n).bit_length()), BITS[1])
    marks = leaves.select(F.expr(f"cast(shiftrightunsigned(leaf, {67 - bits}) as int)").alias("byte"), F.expr(f"shiftleft(1, 7 - cast(shiftrightunsigned(leaf, {64 - bits}) % 8 as int))").alias("bit"))
    got = marks.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 3, np.uint8)
    out[got.column("byte").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return out.tobytes()


def _salted_texts(docs: DataFrame) -> DataFrame:
    """Salted, since copies of one text may hold a third of all rows."""
    return docs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(TEXT_SALTS)).cast("int"))


def _copy_groups(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(k1, unit): the group of near copies of each text that ``seen`` names; other texts hold no line that counts."""
    named = seen.select("k1").distinct().withColumn("salt", every_salt(TEXT_SALTS))
    texts = _salted_texts(docs).join(named.hint("merge"), ["k1", "salt"], "left_semi").groupBy("k1").agg(F.first("text").alias("text"))
    groups = near_dup.near_duplicates(table(texts, "line-texts"), id_col="k1")
    return table(groups.select("k1", F.col("component_id").alias("unit")), "copy-groups")


def _often(seen: DataFrame, unit: str) -> DataFrame:
    counts = seen.select("leaf", "template", "least", unit).distinct().groupBy("leaf", "template", "least").agg(F.count(F.lit(1)).alias("n"))
    return table(counts.filter(F.col("n") >= F.col("least")).select("leaf", "template", "least"), "recurring")


def least_docs(size: Column, min_docs: int) -> Column:
    """Texts in which an equal line of so many tokens must stand."""
    falling = F.ceil(min_docs - (min_docs - 2) * (size - SHORT) / (LONG - SHORT)).cast("int")
    return F.least(F.lit(min_docs), F.greatest(F.lit(2), falling))


def recurring_lines(docs: DataFrame, *, min_docs: int, depth: int, similarity: float, groups: bool = False, long_lines: bool = False) -> DataFrame:
    """(k1, found): by text key the numbers of the lines of recurring templates, with the key's second half."""
    least = (lambda size: least_docs(size, min_docs)) if long_lines else lambda size: F.lit(min_docs)
    counted = _leaves(docs, depth).distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n_leaf"), F.first("size").alias("size"))
    leaves = table(counted.filter(F.col("n_leaf") >= least(F.col("size"))).select("leaf", "n_leaf"), "leaves")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(leaves))
    lines = table(_lines(docs, bitmap, depth).join(leaves, "leaf", "left_semi"), "leaf-lines")
    texts = lines.groupBy("leaf", "line", "k1").agg(F.first("tokens").alias("tokens"))
    kinds = table(texts.groupBy("leaf", "line").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("tokens")), "line-kinds")
    tokens = kinds.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token"))
    constant = table(tokens.filter(F.col("token") != int(STAR)).groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).join(leaves, "leaf").select("leaf", "place", "token", (F.col("n") / F.col("n_leaf")).alias("share")), "constants")
    marked = tokens.join(constant, ["leaf", "place", "token"], "left")
    fixed = [F.coalesce(F.col("share") >= x, F.lit(False)) for x in SHARES]
    made = [F.struct(F.bit_xor(F.xxhash64("place", F.when(f, F.col("token")).otherwise(F.lit(0)))).alias("template"), F.count_if(f).alias("n_fixed")) for f in fixed]
    parts = marked.groupBy("leaf", "line").agg(F.array(*made).alias("made"), F.count_if(F.col("token") != int(STAR)).alias("n_plain"))
    parts = parts.select("leaf", "line", "n_plain", F.explode(F.array_distinct("made")).alias("t")).select("leaf", "line", "n_plain", "t.*")
    template = parts.filter(F.col("n_fixed") >= F.lit(similarity) * F.greatest("n_plain", F.lit(1))).select("leaf", "line", "template", F.lit(min_docs).alias("least"))
    if long_lines:
        equal = kinds.select("leaf", "line", F.col("line").alias("template"), least(F.size("tokens")).alias("least"), "n")
        template = template.union(equal.filter((F.col("least") < min_docs) & (F.col("n") >= F.col("least"))).drop("n"))
    template = table(template, "templates")
    seen = lines.select("leaf", "line", "k1", "k2", "number").join(template, ["leaf", "line"])
    seen = table(seen, "template-lines")
    found = seen.join(_often(seen, "k1"), ["leaf", "template", "least"], "left_semi")
    if groups:
        found = table(found, "recurring-lines")
        units = found.select("leaf", "template", "least", "k1").distinct().join(_copy_groups(docs, found), "k1")
        found = found.join(_often(units, "unit"), ["leaf", "template", "least"], "left_semi")
    return found.groupBy("k1").agg(F.collect_set(F.struct("k2", "number")).alias("found"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_docs: int = 20, depth: int = 3, similarity: float = 0.8, max_share: float = 1.0, groups: bool = False, long_lines: bool = False) -> DataFrame:
    """One row per document: ``id_col``, n_lines, n_dropped, kept (the text without recurring lines)."""
    k1, k2 = text_key(F.col(text_col))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), k1.alias("k1"), k2.alias("k2"))
    found = recurring_lines(src, min_docs=min_docs, depth=depth, similarity=similarity, groups=groups, long_lines=long_lines)
    joined = _salted_texts(src).join(found.withColumn("salt", every_salt(TEXT_SALTS)), ["k1", "salt"], "left").select("id", "text", "k2", "found")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n, gone, kept = [], [], []
                for text, own, found in zip(part.column("text").to_pylist(), part.column("k2").to_pylist(), part.column("found").to_pylist(), strict=True):
                    drop = {x["number"] for x in found or () if x["k2"] == own}
                    split = [] if text is None else text.split("\n")
                    if drop and max_share < 1:
                        lost = sum(len(split[k].split()) for k in drop)
                        if lost > max_share * len(text.split()):
                            drop = set()
                    n.append(len(split))
                    gone.append(len(drop))
                    kept.append("\n".join(x for k, x in enumerate(split) if k not in drop) if drop else text)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("id", id_col)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its lines of recurring templates; a group of near copies counts as one text."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = dedup_lines(docs.withColumn("doc_id", F.struct(*rest)), groups=True, long_lines=True)
    return out.select("doc_id.*", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars")).select(docs.columns)
