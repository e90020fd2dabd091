"""Condition trees: JSON to a checked tree, and the tree to boolean Columns.

Facts are a VARIANT column.  A literal's JSON type is known when the tree is
built, so each leaf becomes one typed test: VARIANT values aren't comparable.
Every leaf is true or false, never null: a missing fact makes it false, also
under ``ne`` and ``not_in``, and ``not`` is the plain complement.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a field may begin with, operators, and limits.
ROOTS = ("user", "device", "app", "channel", "destination", "file", "classification", "sit", "network", "risk", "volume", "time")
OPS = ("eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with", "exists", "count_gte")
MAX_DEPTH, MAX_LEAVES = 16, 256
LEVELS = ("low", "medium", "high")
HITS = "array<struct<detector:string,count_by_confidence:struct<low:bigint,medium:bigint,high:bigint>>>"
NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


class ConditionError(ValueError):
    """Where in the tree, and why."""

    def __init__(self, path: str, why: str):
        super().__init__(f"{path}: {why}")
        self.path = path


@dataclass(frozen=True)
class Leaf:
    path: str
    field: str
    op: str
    value: Any
    confidence: int
    list_name: str | None


@dataclass(frozen=True)
class Node:
    kind: str  # all, any, not
    items: tuple


def parse(tree: Any, lists: dict, path: str = "when") -> Leaf | Node:
    left = [MAX_LEAVES]
    return _parse(tree, lists, path, 0, left)


def _parse(tree: Any, lists: dict, path: str, depth: int, left: list[int]) -> Leaf | Node:
    if depth > MAX_DEPTH:
        raise ConditionError(path, f"nested deeper than {MAX_DEPTH}")
    if not isinstance(tree, dict):
        raise ConditionError(path, "a condition is an object")
    if len(tree) == 1:
        kind, inner = next(iter(tree.items()))
        if kind in ("all", "any"):
            if not isinstance(inner, list) or not inner:
                raise ConditionError(path, f"{kind} takes a list that isn't empty")
            return Node(kind, tuple(_parse(x, lists, f"{path}.{kind}[{i}]", depth + 1, left) for i, x in enumerate(inner)))
        if kind == "not":
            return Node("not", (_parse(inner, lists, f"{path}.not", depth + 1, left),))
    left[0] -= 1
    if left[0] < 0:
        raise ConditionError(path, f"more than {MAX_LEAVES} leaves in a rule")
    return _leaf(tree, lists, path)


def _leaf(d: dict, lists: dict, path: str) -> Leaf:
    if odd := sorted(set(d) - {"field", "op", "value", "min_confidence"}):
        raise ConditionError(path, f"unknown key {odd[0]}")
    name, op, value = d.get("field"), d.get("op"), d.get("value")
    if not isinstance(name, str) or name.split(".")[0] not in ROOTS:
        raise ConditionError(path, f"unknown field {name}")
    if op not in OPS:
        raise ConditionError(path, f"unknown operator {op}")
    # Only a string is read; anything else stands for the default.
    level = d.get("min_confidence") if isinstance(d.get("min_confidence"), str) else "medium"
    if level not in LEVELS:
        raise ConditionError(path, f"unknown min_confidence {level}")
    list_name = None
    if isinstance(value, dict) and isinstance(value.get("list"), str):
        list_name = value["list"]
        if list_name not in lists:
            raise ConditionError(path, f"unknown list {list_name}")
        value = lists[list_name]
        if not isinstance(value, list):
            raise ConditionError(path, f"{list_name} is not a list")
    counts = name.startswith("sit.")
    if op == "exists":
        if value is not None:
            raise ConditionError(path, "exists takes no value")
    elif value is None and op not in ("in", "not_in", "count_gte"):
        raise ConditionError(path, f"{op} takes a value")
    if op in ("in", "not_in") and not isinstance(value, list):
        raise ConditionError(path, f"{op} takes a list")
    if op == "count_gte":
        if not counts:
            raise ConditionError(path, "count_gte is for sit fields")
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise ConditionError(path, "count_gte takes a whole number from 1")
    if counts and op not in ("count_gte", "exists"):
        raise ConditionError(path, "sit fields take count_gte and exists")
    return Leaf(path, name, op, value, LEVELS.index(level), list_name)


def leaves(tree: Leaf | Node) -> list[Leaf]:
    return [tree] if isinstance(tree, Leaf) else [x for t in tree.items for x in leaves(t)]


# ------------------------------------------------------------------ Columns


def lookup(facts: Column, path: str) -> Column:
    """The fact at a dotted path, as VARIANT; null where missing, null, or behind an array."""
    return _there(_value(facts, path))


def _value(facts: Column, path: str) -> Column:
    return F.try_variant_get(facts, "$" + "".join(f"['{k}']" for k in path.split(".")), "variant")


def _there(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), v)


def _fold(x: Column | str) -> Column | str:
    """ASCII lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return x.translate(str.maketrans(upper, lower)) if isinstance(x, str) else F.translate(x, upper, lower)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


class Fact:
    """A VARIANT value and what it is as each type (null where it is another), as Columns."""

    #: What a value is read as, from itself and its kind.
    READINGS = {
        "text": lambda v, k: F.when(k == "STRING", F.try_variant_get(v, "$", "string")),
        "number": lambda v, k: F.when(k.rlike(NUMBER), F.try_variant_get(v, "$", "double")),
        "truth": lambda v, k: F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
        "items": lambda v, k: F.when(k.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")),
    }

    def __init__(self, v: Column, kind: Column | None = None, named: dict[str, Column] | None = None):
        self.v, self._kind, self._named = v, kind, named or {}

    @property
    def kind(self) -> Column:
        return _kind(self.v) if self._kind is None else self._kind

    def __getattr__(self, reading: str) -> Column:
        if reading not in self.READINGS:
            raise AttributeError(reading)
        return self._named[reading] if reading in self._named else self.READINGS[reading](self.v, self.kind)


def _text(v: Column) -> Column:
    """The value if it is a string."""
    return Fact(v).text


def _items(v: Column) -> Column:
    return Fact(v).items


def _is_number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def equal(f: Fact, literal: Any) -> Column:
    """Equality with a JSON literal: ASCII case folded for strings, numbers as doubles, else by structure."""
    if isinstance(literal, str):
        return F.coalesce(_fold(f.text) == _fold(literal), F.lit(False))
    if isinstance(literal, bool):
        return F.coalesce(f.truth == literal, F.lit(False))
    if _is_number(literal):
        return F.coalesce(f.number == float(literal), F.lit(False))
    if literal is None:
        return F.coalesce(F.is_variant_null(f.v), F.lit(False))
    # Objects are stored by key, so their text doesn't depend on key order.
    told = json.dumps(literal, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.coalesce(F.to_json(f.v) == F.to_json(F.parse_json(F.lit(told))), F.lit(False))


def any_equal(f: Fact, literals: list) -> Column:
    """Is the value, or any element of an array, equal to one of the literals?"""
    texts = sorted({_fold(x) for x in literals if isinstance(x, str)})
    others = [x for x in literals if not isinstance(x, str)]

    def one(x: Fact) -> Column:
        tests = [F.coalesce(_fold(x.text).isin(texts), F.lit(False))] if texts else []
        return reduce(lambda a, b: a | b, tests + [equal(x, y) for y in others], F.lit(False))

    return F.when(f.kind.startswith("ARRAY"), F.coalesce(F.exists(f.items, lambda x: one(Fact(x))), F.lit(False))).otherwise(one(f))


def sit_count(facts: Column, name: str, confidence: int) -> Column:
    """Values that a detector (or any of them) found, at least this sure."""
    hits = F.try_variant_get(facts, "$.inspection.hits", HITS)
    wanted = name.removeprefix("sit.")
    own = hits if wanted == "any" else F.filter(hits, lambda h: h["detector"] == wanted)
    of = lambda h: reduce(lambda a, b: a + b, [F.coalesce(h["count_by_confidence"][k], F.lit(0)) for k in LEVELS[confidence:]])
    return F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda n, h: n + of(h)), F.lit(0).cast("long"))


class Compiler:
    """Columns for the leaves of one bundle's conditions.

    ``known`` names Columns that already hold a path's Fact, or a leaf's outcome (see Graph);
    without it each leaf reads its own.
    """

    def __init__(self, facts: Column, labels: list[str], known: Graph | None = None):
        self.facts, self.labels, self.known = facts, [x.lower() for x in labels], known

    def fact(self, path: str) -> Fact:
        return self.known.fact(path) if self.known else Fact(lookup(self.facts, path))

    def rank(self, f: Fact) -> Column:
        """Place of a classification label, null if it has none."""
        at = F.array_position(F.array(*map(F.lit, self.labels)), F.lower(f.text))
        return F.when(at > 0, at - 1)

    def ordering(self, leaf: Leaf) -> tuple[Column, Column]:
        """(sign of fact against literal, or null; diagnostic where there is none)."""
        f, want = self.fact(leaf.field), leaf.value
        sign = F.lit(None).cast("int")
        if leaf.field.split(".")[-1] == "classification":
            place = self.labels.index(want.lower()) if isinstance(want, str) and want.lower() in self.labels else None
            sign = F.lit(None).cast("int") if place is None else F.signum(self.rank(f) - place).cast("int")
            why = f"{leaf.field}: a label is not one of the bundle's"
        else:
            why = f"{leaf.field}: the fact and the value have no order"
        if _is_number(want):
            sign = F.when(f.number.isNotNull(), F.signum(f.number - float(want)).cast("int")).otherwise(sign)
        return sign, F.when(f.v.isNotNull() & sign.isNull(), F.lit(why))

    def leaf(self, x: Leaf) -> Column:
        if self.known and (told := self.known.outcome(x)) is not None:
            return told
        if x.field.startswith("sit."):
            return sit_count(self.facts, x.field, x.confidence) >= F.lit(x.value if x.op == "count_gte" else 1)
        f, want = self.fact(x.field), x.value
        if x.op == "exists":
            return f.v.isNotNull()
        if x.op in ("eq", "ne"):
            told = equal(f, want)
        elif x.op in ("in", "not_in"):
            told = any_equal(f, want)
        elif x.op in ("gt", "gte", "lt", "lte"):
            sign, _ = self.ordering(x)
            told = {"gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[x.op]
        elif x.op == "contains":
            told = F.contains(F.lower(f.text), F.lit(want.lower())) if isinstance(want, str) else F.lit(False)
            told = F.when(f.kind.startswith("ARRAY"), F.exists(f.items, lambda y: equal(Fact(y), want))).otherwise(told)
        elif isinstance(want, str):
            test = F.startswith if x.op == "starts_with" else F.endswith
            told = test(F.lower(f.text), F.lit(want.lower()))
        else:
            told = F.lit(False)
        told = F.coalesce(told, F.lit(False))
        return f.v.isNotNull() & (~told if x.op in ("ne", "not_in") else told)

    def tree(self, t: Leaf | Node) -> Column:
        if isinstance(t, Leaf):
            return self.leaf(t)
        parts = [self.tree(x) for x in t.items]
        if t.kind == "not":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if t.kind == "all" else (lambda a, b: a | b), parts)

    def diagnostics(self, t: Leaf | Node) -> list[Column]:
        return [self.ordering(x)[1] for x in leaves(t) if x.op in ("gt", "gte", "lt", "lte") and not x.field.startswith("sit.")]

    def trace(self, t: Leaf | Node) -> Column:
        """array of (path, field, op, expected, list, actual, result), in the tree's order."""
        rows = []
        for x in leaves(t):
            sit = x.field.startswith("sit.")
            actual = sit_count(self.facts, x.field, x.confidence).cast("string") if sit else F.to_json(self.fact(x.field).v)
            rows.append(F.struct(F.lit(x.path).alias("path"), F.lit(x.field).alias("field"), F.lit(x.op).alias("op"), F.lit(json.dumps(x.value)).alias("expected"), F.lit(x.list_name).cast("string").alias("list"), F.coalesce(actual, F.lit("null")).alias("actual"), self.leaf(x).alias("result")))
        return F.array(*rows)


class Graph:
    """The conditions of a bundle as one graph: each path is read once, each different leaf is decided once.

    read() adds projections to a DataFrame: the paths' values, their kinds, their typed readings,
    then the leaves' outcomes.  Each is used several times by the next one, so Catalyst keeps them
    apart, and what nothing uses goes.
    """

    def __init__(self, trees: list[Leaf | Node], labels: list[str], prefix: str, paths: tuple[str, ...] = ()):
        self.labels, self.prefix = labels, prefix
        self.leaves: dict[str, tuple[int, Leaf]] = {}
        for x in (x for t in trees for x in leaves(t)):
            self.leaves.setdefault(self._key(x), (len(self.leaves), x))
        fields = dict.fromkeys([*paths, *(x.field for _, x in self.leaves.values() if not x.field.startswith("sit."))])
        self.paths = {path: i for i, path in enumerate(fields)}
        self.decided = False

    @staticmethod
    def _key(x: Leaf) -> str:
        return json.dumps([x.field, x.op, x.value, x.confidence], sort_keys=True)

    def fact(self, path: str) -> Fact:
        if (i := self.paths.get(path)) is None:  # of a policy that can't apply now
            return Fact(lookup(self.facts, path))
        return Fact(F.col(f"{self.prefix}v{i}"), F.col(f"{self.prefix}k{i}"), {r: F.col(f"{self.prefix}{r}{i}") for r in Fact.READINGS})

    def outcome(self, x: Leaf) -> Column | None:
        at = self.leaves.get(self._key(x)) if self.decided else None
        return None if at is None else F.col(f"{self.prefix}l{at[0]}")

    def read(self, df: DataFrame, facts: Column) -> DataFrame:
        p, self.facts = self.prefix, facts
        df = df.select("*", *[_value(facts, path).alias(f"{p}raw{i}") for path, i in self.paths.items()])
        df = df.select("*", *[_there(F.col(f"{p}raw{i}")).alias(f"{p}v{i}") for i in self.paths.values()])
        df = df.select("*", *[_kind(F.col(f"{p}v{i}")).alias(f"{p}k{i}") for i in self.paths.values()])
        df = df.select("*", *[of(F.col(f"{p}v{i}"), F.col(f"{p}k{i}")).alias(f"{p}{name}{i}") for i in self.paths.values() for name, of in Fact.READINGS.items()])
        c = Compiler(facts, self.labels, self)
        df = df.select("*", *[c.leaf(x).alias(f"{p}l{i}") for i, x in self.leaves.values()])
        self.decided = True
        return df
