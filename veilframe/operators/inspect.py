"""Inspection of texts with detector packs: a narrow map, no shuffle.

One Arrow UDF normalises a batch of texts and finds the raw matches of all
detectors, with their byte offsets and whether a keyword is near; most texts have
none, and leave nothing else.  What a match is worth is decided by Columns over
the short list of matches: validator, entropy, dummy values, confidence, distinct
counts, masked samples.  Each list is one expression for all detectors, so plans
stay small, and the UDF is a barrier that no filter crosses, so nothing is
computed twice.

The result is a struct:

    packs, bytes_inspected, truncated, timed_out,
    hits: [detector, name, category, count, count_by_confidence, max_confidence,
           samples: [start, end, masked, confidence]]

Offsets are bytes of the normalised text.  ``timed_out`` is always false: a
wall-clock budget would make results depend on the machine.  Patterns of packs
that are loaded run on RE2, whose time is linear in the text whatever the pattern
(its word boundaries and classes are those of ASCII); the built-in pack's are vetted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masks import MASKS, canonical, distinct_key
from ..functions.text import collapse_array, collapse_one, fold_array
from ..functions.validators import VALIDATORS, entropy
from ..plans.literals import required
from ..plans.packs import BUILTIN, LEVELS, Detector, Pack, decoded, merge
from .names import free_prefix
from .policy import held


@dataclass(frozen=True)
class Budget:
    max_bytes: int = 20 << 20
    max_matches: int = 10_000
    max_samples: int = 5


# ---------------------------------------------------------------- raw matches


def re2_spans(texts: list[str], pattern: str, limit: int) -> list[list[tuple[int, int]]]:
    """Character spans of the first leftmost matches in each text, by RE2: what stands between marks."""
    mark = "\ue001"  # brackets each match; texts that hold it themselves get another one
    while any(mark in t for t in texts):
        mark += "\ue002"
    told = pc.replace_substring_regex(pa.array(texts, pa.large_string()), pattern, f"{mark}\\0{mark}", max_replacements=limit)
    out = []
    for marked in told.to_pylist():
        at, spans = 0, []
        for k, part in enumerate(marked.split(mark)):
            if k % 2 and part:
                spans.append((at, at + len(part)))
            at += len(part)
        out.append(spans)
    return out


def _near(raw: bytes, start: int, end: int, d: Detector, keywords: list[str]) -> bool:
    """A keyword inside the match or within ``proximity`` bytes, widened to whole characters."""
    lo, hi = max(0, start - d.proximity), min(len(raw), end + d.proximity)
    while lo and raw[lo] & 0xC0 == 0x80:
        lo -= 1
    while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi += 1
    window = raw[lo:hi].decode("utf-8", "replace").lower()
    return any(k in window for k in keywords)


def _told(i: int, d: Detector, keywords: list[str], text: str, spans: list[tuple[int, int]]) -> Iterator[dict]:
    """The matches of one detector in a text, with their byte offsets."""
    raw = text.encode()
    at = last = 0  # bytes up to the character ``last``
    for a, b in spans:
        start = at + len(text[last:a].encode())
        end = start + len(text[a:b].encode())
        at, last = end, b
        yield {"d": i, "s": start, "e": end, "m": text[a:b], "k": bool(keywords) and _near(raw, start, end, d, keywords)}


_SPANS = pa.list_(pa.struct([("d", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("m", pa.string()), ("k", pa.bool_())]))
_SCAN = "struct<bytes:bigint,cut:boolean,spans:array<struct<d:int,s:int,e:int,m:string,k:boolean>>>"


def _cut(texts: pa.Array, max_bytes: int) -> tuple[pa.Array, pa.Array]:
    over = pc.fill_null(pc.greater(pc.binary_length(texts), max_bytes), False)
    if pc.any(over, min_count=0).as_py():
        short = [t.encode()[:max_bytes].decode(errors="ignore") for t in texts.filter(over).to_pylist()]
        texts = pc.replace_with_mask(texts, over, pa.array(short, texts.type))
    return texts, over


#: Fewer detectors with required texts are tried on all texts: that is as fast.
FEW = 16


def naming(detectors: list[Detector]) -> Callable[[pa.Array], dict[int, list[int]]]:
    """A function from texts to the rows that each detector with required texts is worth running on.

    One automaton over all required texts reads each text once, whatever the number of
    detectors.
    """
    texts_of = {i: told for i, d in enumerate(detectors) if (told := required(d.pattern))}
    if len(texts_of) < FEW:
        return lambda texts: {}
    owners: dict[str, list[int]] = {}
    for i, told in texts_of.items():
        for x in told:
            owners.setdefault(x, []).append(i)
    built: list = []

    def run(texts: pa.Array) -> dict[int, list[int]]:
        if not built:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for x, own in owners.items():
                automaton.add_word(x, tuple(own))
            automaton.make_automaton()
            built.append(automaton)
        out: dict[int, list[int]] = {i: [] for i in texts_of}
        for row, text in enumerate(texts.to_pylist()):
            if text:
                own = {i for _, names in built[0].iter(text) for i in names}
                for i in own:
                    out[i].append(row)
        return out

    return run


def scan(detectors: list[Detector], budget: Budget, compose: bool = True) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to (bytes, cut, spans): the raw matches of every detector, in order."""
    keywords = [[k.lower() for k in d.keywords] for d in detectors]

    def matches(d: Detector, texts: list[str]) -> Iterator[list[tuple[int, int]]]:
        if d.engine == "re2":
            yield from re2_spans(texts, d.pattern, budget.max_matches)
            return
        compiled = re.compile(d.pattern)
        for t in texts:
            yield [m.span() for _, m in zip(range(budget.max_matches), compiled.finditer(t), strict=False) if m.end() > m.start()]

    named = naming(detectors)

    def run(texts: pa.Array) -> pa.Array:
        norm, over = _cut(collapse_array(fold_array(texts) if compose else texts), budget.max_bytes)
        found: dict[int, list[dict]] = {}
        worth = named(norm)
        for i, d in enumerate(detectors):
            rows, some = None, norm
            if i in worth:
                rows = np.array(worth[i], np.int64)
                if not len(rows):
                    continue
                some = norm.take(pa.array(rows))
            hit = np.flatnonzero(pc.fill_null(pc.match_substring_regex(some, d.hint or d.pattern), False).to_numpy(zero_copy_only=False))
            held = some.take(pa.array(hit)).to_pylist()
            rows = hit if rows is None else rows[hit]
            for row, text, spans in zip(rows.tolist(), held, matches(d, held), strict=True):
                if spans:
                    found.setdefault(row, []).extend(_told(i, d, keywords[i], text, spans))
        spans = pa.array([found.get(k, []) for k in range(len(texts))], _SPANS)
        return pa.StructArray.from_arrays([pc.binary_length(norm).cast(pa.int64()), over, spans], names=["bytes", "cut", "spans"], mask=texts.is_null())

    return run


#: Longer texts go to scan(), whose tests by RE2 pay off then.
SHORT = 2000


def scan_one(detectors: list[Detector], budget: Budget) -> Callable[[str], list[dict]]:
    """scan() for one text at a time: the same matches, without the price of Arrow calls on single values."""
    whole = scan(detectors, budget)
    plain = all(d.engine == "re" for d in detectors)
    tried = [(i, d, re.compile(d.pattern), [k.lower() for k in d.keywords]) for i, d in enumerate(detectors)] if plain else []

    def run(text: str) -> list[dict]:
        if not plain or len(text) > SHORT:
            return whole(pa.array([text], pa.string()))[0].as_py()["spans"]
        norm = collapse_one(text)
        if len(norm) * 4 > budget.max_bytes:
            return whole(pa.array([text], pa.string()))[0].as_py()["spans"]
        out: list[dict] = []
        for i, d, compiled, keywords in tried:
            if spans := [m.span() for _, m in zip(range(budget.max_matches), compiled.finditer(norm), strict=False) if m.end() > m.start()]:
                out.extend(_told(i, d, keywords, norm, spans))
        return out

    return run


#: Bytes of text that a scan holds at a time, beside what Arrow brought.
HELD = 4 << 20


def in_parts(run: Callable[[pa.Array], pa.Array], most: int | None = None) -> Callable[[pa.Array], pa.Array]:
    """``run`` over stretches of a batch: copies of texts take the memory of a few of them, not of a whole batch."""

    def told(texts: pa.Array) -> pa.Array:
        most_ = most or HELD
        if texts.nbytes <= most_ or len(texts) < 2:
            return run(texts)
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        edges = np.unique(np.searchsorted(upto, np.arange(0, upto[-1], most_), side="right"))
        cuts = [0, *[int(x) for x in edges if 0 < x < len(texts)], len(texts)]
        return pa.concat_arrays([run(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])

    return told


def _scanned(df: DataFrame, name: str, text_col: str, detectors: list[Detector], budget: Budget, compose: bool) -> DataFrame:
    """``df`` with the scan as ``name``; not deterministic for the optimizer, so that no filter is pushed below and makes it run twice."""
    run = in_parts(scan(detectors, budget, compose))

    def told(texts: pa.Array) -> pa.Array:
        return run(texts)

    return df.withColumn(name, F.arrow_udf(told, _SCAN).asNondeterministic()(F.col(text_col)))


# --------------------------------------------------------------- what they are worth


def _by_detector(detectors: list[Detector], m: Column, told: Callable[[Detector], Column | None], other: Column) -> Column:
    """The Column that ``told`` gives for the match's detector; one branch for all that share it."""
    out = None
    for i, d in enumerate(detectors):
        if (x := told(d)) is not None:
            out = F.when(m["d"] == i, x) if out is None else out.when(m["d"] == i, x)
    return other if out is None else out.otherwise(other)


def _listed(values: list, m: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), m["d"])


def _accepted(detectors: list[Detector], spans: Column) -> Column:
    """Validator, entropy, required keyword, dummy values, confidence: (d, key, s, e, m, c) of the matches that pass."""

    def valid(m: Column) -> Column:
        def own(d: Detector) -> Column | None:
            checks = [m["k"]] if d.require_keyword else []  # the cheapest first
            checks += [VALIDATORS[d.validator](m["m"])] if d.validator != "none" else []
            checks += [entropy(m["m"]) >= d.min_entropy] if d.min_entropy is not None else []
            return reduce(lambda a, b: a & b, checks) if checks else None

        return F.coalesce(_by_detector(detectors, m, own, F.lit(True)), F.lit(False))

    def confidence(m: Column) -> Column:
        def dummy(d: Detector) -> Column | None:
            plain, hashed = d.known_tests()
            value = canonical(m["m"])
            checks = [value.isin(*sorted(plain))] if plain else []
            checks += [F.sha2(value, 256).isin(*sorted(hashed))] if hashed else []
            return reduce(lambda a, b: a | b, checks) if checks else None

        level = F.when(m["k"], _listed([d.ranks[1] for d in detectors], m)).otherwise(_listed([d.ranks[0] for d in detectors], m))
        return F.when(_by_detector(detectors, m, dummy, F.lit(False)), F.lit(0)).otherwise(level)

    return F.transform(F.filter(spans, valid), lambda m: F.struct(m["d"].alias("d"), distinct_key(m["m"]).alias("key"), m["s"].alias("s"), m["e"].alias("e"), m["m"].alias("m"), confidence(m).alias("c")))


_FOUND = "array<struct<d:int,s:int,e:int,m:string,c:int>>"


def _distinct(ordered: Column) -> Column:
    """Of matches sorted by (d, key, s), the first of each detector and key, in text order: neighbours are compared."""
    before = F.concat(F.array(F.lit(None).cast("struct<d:int,key:string>")), F.transform(ordered, lambda m: F.struct(m["d"].alias("d"), m["key"].alias("key"))))
    first = F.zip_with(ordered, before, lambda m, b: F.when(m.isNotNull() & (b.isNull() | (m["d"] != b["d"]) | (m["key"] != b["key"])), F.struct(m["d"].alias("d"), m["s"].alias("s"), m["e"].alias("e"), m["m"].alias("m"), m["c"].alias("c"))))
    return F.sort_array(F.filter(first, lambda m: m.isNotNull()))


def _found(df: DataFrame, p: str, text_col: str, detectors: list[Detector], budget: Budget, compose: bool) -> DataFrame:
    """``df`` with ``p`` + scan and ``p`` + found: the distinct accepted matches (d, s, e, m, c), by detector and place."""
    out = _scanned(df, f"{p}scan", text_col, detectors, budget, compose)
    spans = F.col(f"{p}scan.spans")
    out = out.withColumn(f"{p}sorted", F.when(F.size(spans) > 0, F.sort_array(_accepted(detectors, spans))))
    told = F.when(F.size(f"{p}sorted") > 0, _distinct(F.col(f"{p}sorted"))).otherwise(F.array().cast(_FOUND))
    return out.withColumn(f"{p}found", held(F.when(F.col(f"{p}scan").isNotNull(), told))).drop(f"{p}sorted")


def hits(found: Column, detectors: list[Detector], budget: Budget) -> Column:
    """One struct per detector with matches, in pack order."""
    table = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(d.id).alias("id"), F.lit(d.name).alias("name"), F.lit(d.category).alias("category"), F.lit(d.mask).alias("mask")) for i, d in enumerate(detectors)])
    level = lambda c: F.get(F.array(*map(F.lit, LEVELS)), c)
    # Only the detectors that found something are looked at, however many there are.
    named = F.array_distinct(F.transform(found, lambda m: m["d"]))
    own = F.transform(named, lambda k: F.struct(F.get(table, k).alias("d"), F.filter(found, lambda m: m["d"] == k).alias("own")))

    def masked(mask: Column, m: Column) -> Column:
        out = None
        for name in sorted({d.mask for d in detectors}):
            x = MASKS[name](m)
            out = F.when(mask == name, x) if out is None else out.when(mask == name, x)
        return out

    def told(h: Column) -> Column:
        count = lambda r: F.size(F.filter(h["own"], lambda m: m["c"] == r)).cast("long")
        samples = F.transform(F.slice(h["own"], 1, budget.max_samples), lambda m: F.struct(m["s"].alias("start"), m["e"].alias("end"), masked(h["d"]["mask"], m["m"]).alias("masked"), level(m["c"]).alias("confidence")))
        return F.struct(
            h["d"]["id"].alias("detector"),
            h["d"]["name"].alias("name"),
            h["d"]["category"].alias("category"),
            F.size(h["own"]).cast("long").alias("count"),
            F.struct(*[count(r).alias(name) for r, name in enumerate(LEVELS)]).alias("count_by_confidence"),
            level(F.array_max(F.transform(h["own"], lambda m: m["c"]))).alias("max_confidence"),
            samples.alias("samples"),
        )

    return F.transform(own, told)


HIT_SCHEMA = "array<struct<detector:string,name:string,category:string,count:bigint,count_by_confidence:struct<low:bigint,medium:bigint,high:bigint>,max_confidence:string,samples:array<struct<start:int,end:int,masked:string,confidence:string>>>>"


def inspect(df: DataFrame, text_col: str = "text", packs: list[Pack] | None = None, *, budget: Budget = Budget(), compose: bool = True, out_col: str = "inspection") -> DataFrame:
    """``df`` with an inspection struct; null texts have none."""
    packs = packs or [BUILTIN]
    detectors = merge(packs)
    p = free_prefix(df)
    out = _found(df, p, text_col, detectors, budget, compose)
    told = F.when(F.size(f"{p}found") > 0, hits(F.col(f"{p}found"), detectors, budget)).otherwise(F.array().cast(HIT_SCHEMA))
    labels = F.array(*[F.lit(x.label) for x in packs])
    whole = F.struct(labels.alias("packs"), F.col(f"{p}scan.bytes").alias("bytes_inspected"), F.col(f"{p}scan.cut").alias("truncated"), F.lit(False).alias("timed_out"), told.alias("hits"))
    return out.withColumn(out_col, held(F.when(F.col(f"{p}scan").isNotNull(), whole))).drop(f"{p}scan", f"{p}found")


def inspect_custom(df: DataFrame, packs: list[Pack], text_col: str = "text", **options) -> DataFrame:
    """inspect() with tenants' own packs beside or without the built-in one."""
    return inspect(df, text_col, packs, **options)


def detected(df: DataFrame, detector: str, text_col: str = "text", *, packs: list[Pack] | None = None, budget: Budget = Budget(), compose: bool = True, out_col: str = "found") -> DataFrame:
    """``df`` with ``out_col``: the distinct accepted matches (s, e, m, c) of one detector; c: confidence rank."""
    d = next(x for x in merge(packs or [BUILTIN]) if x.id == detector)
    if out_col in df.columns:
        raise ValueError(f"the frame has a column {out_col}; name another with out_col")
    p = free_prefix(df)
    return _found(df, p, text_col, [d], budget, compose).drop(f"{p}scan").withColumnRenamed(f"{p}found", out_col)


def long_hits(df: DataFrame, *keys: str, text_col: str = "text", packs: list[Pack] | None = None, **options) -> DataFrame:
    """A row per hit: ``keys`` and the hit's fields."""
    seen = inspect(df.select(*keys, text_col), text_col, packs, **options)
    return seen.select(*keys, F.explode("inspection.hits").alias("h")).select(*keys, "h.*")


def detector_ids(spark: SparkSession, packs: list[Pack] | None = None) -> DataFrame:
    """(ordinal, detector) of all detectors, in pack order."""
    return spark.createDataFrame([(i, d.id) for i, d in enumerate(merge(packs or [BUILTIN]))], "ordinal int, detector string")


def at_least(counts: Column, level: str) -> Column:
    """How many distinct values have this confidence or more; counts: a count_by_confidence struct."""
    return reduce(lambda a, b: a + b, [counts[x] for x in LEVELS[LEVELS.index(level) :]])


def vector_rows(packs: list[Pack] | None = None) -> list[tuple[str, bool, str]]:
    """(detector, expected, text) of the packs' own test vectors."""
    return [(d.id, kind == "match", decoded(v)) for d in merge(packs or [BUILTIN]) for kind in ("match", "no_match") for v in d.tests.get(kind, ())]


def self_test(spark: SparkSession, packs: list[Pack] | None = None) -> DataFrame:
    """One row per test vector: does it (not) show above low confidence, as its pack says?"""
    src = spark.createDataFrame(vector_rows(packs), "detector string, expected boolean, text string")
    out = inspect(src, packs=packs)
    above = F.exists("inspection.hits", lambda h: (h["detector"] == F.col("detector")) & (h["max_confidence"] != "low"))
    return out.select("detector", "expected", above.alias("found"), (above == F.col("expected")).alias("ok"))
