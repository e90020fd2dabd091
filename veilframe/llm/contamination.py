"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item (question or answer) is normalised to words.  A window is
``window`` consecutive words of one item; a shorter item is one window.  The
symbols of the automaton are words, and its patterns are the items cut into
stretches of (window + 1) / 2 words, laid end to end: every window holds a whole
stretch, so each word of the benchmark is one node, not one for every window that
covers it.  A document is normalised once and scanned once; around each stretch
that occurs, the windows are looked up in a sorted table and compared word by
word.  Hits are mapped back to words and to character offsets of the original.

The benchmark side is the pattern set.  Its size is measured first and it is
split into blocks of at most ``block_chars`` characters (a longer item into parts
that overlap by a window less one word), each a compressed broadcast.  Up to that
size it is one automaton and one pass.  Beyond it, one map still does all blocks: a
task keeps its documents in a file of its own while it runs, and goes over them
once for each block, so that one automaton is held at a time and texts come to
Python once.  No document is shuffled whatever the size of either side.

Defined results: null or wordless documents have no words and no hits; null or
wordless items have no windows; equal ids in ``items`` count once (null id:
``null``); repeated documents each get their own row; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, table

#: Word bytes: digits, letters, and all bytes of non-ASCII characters.
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
PART_WORDS = 20_000
_built: dict = {}


def normalised_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def item_parts(benchmark: DataFrame, text_col: str, id_col: str, window: int) -> DataFrame:
    """(item, words): each different item as normalised words; long ones in parts that overlap by window - 1 words."""

    step = PART_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, parts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = normalised_words(t)
                for at in range(0, max(len(w) - window + 1, 1) if w else 0, step):
                    items.append(i)
                    parts.append(b" ".join(w[at : at + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.binary())], names=["item", "words"])

    item = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return benchmark.select(item.alias("item"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "item string, words binary").distinct()


class Windows:
    """The windows of a block of items, and the automaton that finds where they can stand."""

    def __init__(self, items: list[str], parts: list[bytes], window: int):
        import ahocorasick

        self.items, self.window, self.stretch = items, window, (window + 1) // 2
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        short: dict[tuple, list[int]] = {}
        told, owner, stretches = [], [], set()
        for k, part in enumerate(parts):
            w = tuple(map(number, part.split()))
            if len(w) < window:
                short.setdefault(w, []).append(k)
                continue
            told.append(np.array(w, np.int32))
            owner.append(k)
            for at in range(0, len(w) - self.stretch + 1, self.stretch):
                stretches.add(w[at : at + self.stretch])
        for w in stretches | short.keys():
            self.automaton.add_word(w, (len(w), w in stretches, short.get(w, ())))
        del short, stretches
        self.automaton.make_automaton()
        self.flat = np.concatenate([np.zeros(0, np.int32), *told])
        size = np.array([len(w) for w in told], np.int64)
        begin = np.cumsum(size) - size
        n = size - window + 1
        start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seed = 0
        while True:  # equal hashes are equal windows, or another seed is taken
            h = self.hashes(self.flat, start, seed)
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            x, y = start[order[1:][same]], start[order[:-1][same]]
            if all((self.flat[x + j] == self.flat[y + j]).all() for j in range(window)):
                break
            seed += 1
        first = np.ones(len(order), bool)
        first[1:] = ~same
        at = np.flatnonzero(first)
        self.seed, self.hash, self.place = seed, h[order[at]], start[order[at]].astype(np.int32)
        self.begin = np.append(at, len(order)).astype(np.int32)
        self.owner = np.repeat(np.array(owner, np.int32), n)[order]

    def hashes(self, flat: np.ndarray, start: np.ndarray, seed: int) -> np.ndarray:
        h = np.full(len(start), seed, np.uint64)
        for j in range(self.window):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + flat[start + j].astype(np.uint64))
        return h

    def scan(self, text: str | None) -> tuple[int, list[int], set[str]]:
        """Words, hit words as [start, end) pairs laid flat, and items hit."""
        w = normalised_words(text)
        if not w or not len(self.automaton):
            return len(w), [], set()
        get = self.vocabulary.get
        ids = tuple([get(x, 0) for x in w])
        spans, items, starts = [], set(), set()
        for end, (n, whole, short) in self.automaton.iter(ids):
            if whole:
                starts.update(range(max(0, end + 1 - self.window), end + 2 - n))
            if short:
                spans.append((end + 1 - n, end + 1))
                items.update(self.items[k] for k in short)
        at = np.array(sorted(x for x in starts if x + self.window <= len(w)), np.int64)
        if len(at):
            flat = np.array(ids, np.int32)
            h = self.hashes(flat, at, self.seed)
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = self.hash[k] == h
            for j in range(self.window):
                hit &= flat[at + j] == self.flat[self.place[k] + j]
            spans += [(x, x + self.window) for x in at[hit].tolist()]
            for x in set(k[hit].tolist()):
                items.update(self.items[y] for y in self.owner[self.begin[x] : self.begin[x + 1]])
        return len(w), merged(spans), items


def _windows(key: str, held, window: int) -> Windows:
    """The worker's automaton for a broadcast block, built once; one is held at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(*pickle.loads(zlib.decompress(held.value)), window)
    return _built[key]


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", item_text_col: str = "text", item_id_col: str = "item_id", window: int = 13, block_chars: int = 4_000_000, offsets: bool = True) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, hits (word ranges), items, and spans (character ranges of the original text)."""
    spark = docs.sparkSession
    parts = table(item_parts(benchmark, item_text_col, item_id_col, window), "items")
    size = parts.agg(F.sum(F.length("words"))).first()[0]
    blocks = max(1, -(-int(size or 0) // block_chars))
    held = []
    for b in range(blocks):
        block = parts if blocks == 1 else parts.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b)
        rows = block.toArrow()  # block_chars at most, but for chance
        held.append(spark.sparkContext.broadcast(zlib.compress(pickle.dumps((rows.column("item").to_pylist(), rows.column("words").to_pylist())))))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = f"id {src.schema['id'].dataType.simpleString()}, {'text string, ' if offsets else ''}"
    out = src.mapInArrow(_scanner(held, window, offsets), f"{kept}n_words long, hits array<int>, items array<string>")
    out = out.withColumn("n_hit", F.aggregate(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int")), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.get("hits", 2 * i + 1) - F.get("hits", 2 * i), F.lit(0))))
    cols = [F.col("id").alias(id_col), "n_words", "n_hit", "hits", "items"]
    if offsets:
        cols.append(original_offsets("text", "hits").alias("spans"))
    return out.select(*cols)


def _scanner(held: list, window: int, offsets: bool):
    keys = [uuid.uuid4().hex for _ in held]

    def told(batch: pa.RecordBatch, n: list[int], hits: list[list[int]], items: list[list[str]]) -> pa.RecordBatch:
        cols = [batch.column(0), *([batch.column(1)] if offsets else []), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=["id", *(["text"] if offsets else []), "n_words", "hits", "items"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(keys[0], held[0], window)
        for batch in batches:
            found = [windows.scan(text.as_py()) for text in batch.column(1)]
            yield told(batch, *([x[0] for x in found], [x[1] for x in found], [sorted(x[2]) for x in found]))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        n: list[int] = []
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}  # of rows with hits
        with tempfile.TemporaryFile() as f:
            with pa.ipc.new_file(f, first.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(first)
                for batch in batches:
                    out.write_batch(batch)
            source = pa.ipc.open_file(pa.PythonFile(f, "r"))
            for k, block in enumerate(held):
                windows, row = _windows(keys[k], block, window), 0
                for b in range(source.num_record_batches):
                    for text in source.get_batch(b).column(1):
                        size, flat, items = windows.scan(text.as_py())
                        if k == 0:
                            n.append(size)
                        if flat:
                            spans, own = found.setdefault(row, ([], set()))
                            spans += zip(flat[::2], flat[1::2], strict=True)
                            own |= items
                        row += 1
            row = 0
            for b in range(source.num_record_batches):
                batch = source.get_batch(b)
                rows = range(row, row + batch.num_rows)
                row += batch.num_rows
                yield told(batch, n[rows.start : rows.stop], [merged(found[i][0]) if i in found else [] for i in rows], [sorted(found[i][1]) if i in found else [] for i in rows])

    return one if len(held) == 1 else several


def original_offsets(texts: Column | str, hits: Column | str) -> Column:
    """Character ranges [start, end) in the original text of ranges of words."""
    def told(texts: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for text, flat in zip(texts, hits, strict=True):
            at = [m.span() for m in _WORD.finditer(text)] if flat is not None and len(flat) else []
            out.append([x for a, b in zip(flat[::2], flat[1::2], strict=True) for x in (at[a][0], at[b - 1][1])] if at else [])
        return pd.Series(out)

    return F.pandas_udf(told, "array<int>")(texts, hits)


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words stand in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = find_contamination(docs, bench, offsets=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    flags = find_contamination(docs.withColumn("doc_id", F.struct(*[F.col(c).alias(c) for c in docs.columns])), bench, offsets=False)
    return flags.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id.*")
