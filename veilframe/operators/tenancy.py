"""Many tenants' bundles in one pass: bundles are rows, and conditions are data.

A table of (tenant_id, bundle JSON) is compiled on the executors, a row for each
tenant: the fact paths it reads, its different leaves (path, operator, value), and its
rules as postfix programs over the leaves.  Events are joined to the bundle of their
tenant; one plan, whose size doesn't depend on the tenants or their rules, then

1. reads each path of the event's bundle once, with its kind and typed readings,
2. decides each leaf by its operator,
3. runs each rule's program over the leaves (a stack of bits in a long),
4. and goes on with the matches as evaluate() does.

The table of bundles is broadcast while it is small in rows and bytes, both counted
first; else it is copied over salts and merge-joined, so that a tenant that holds a
third of all events is dealt over many tasks.

Defined results: an event whose tenant has no bundle, or a null one, has a verdict of
null; a tenant whose bundle can't be used has an ``error`` in the compiled table, and
its events have a verdict of null; of several bundles of one tenant all are errors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.bundles import Bundle, BundleError, load_bundle
from ..plans.conditions import HITS, LEVELS, NUMBER, Leaf, Node, _fold
from .names import free_prefix
from .policy import decide, held

SALTS = 16
SMALL_ROWS, SMALL_BYTES = 10_000, 8 << 20
#: Steps of a rule's program that are no leaf numbers.
AND, OR, NOT = -1, -2, -3

_LEAF = "struct<at:int,op:string,negated:boolean,values:array<string>,low:string,number:double,rank:int,labels:boolean,detector:string,confidence:int,least:bigint>"
_GATE = "struct<monitor:boolean,activate_at:bigint,expire_at:bigint,channels:array<string>,users:array<string>,groups:array<string>,exclude_users:array<string>,exclude_groups:array<string>>"
_RULE = "struct<ord:int,policy:string,policy_name:string,rule:string,priority:int,exception:boolean,enforcement:int,gate:int,program:array<int>>"
_EFFECTS = "array<struct<ord:int,action:string,params:string,policy:string,rule:string>>"
COMPILED = f"tenant_id string, version string, default_action string, labels array<string>, paths array<string>, leaves array<{_LEAF}>, gates array<{_GATE}>, rules array<{_RULE}>, effects {_EFFECTS}, error string"


def path_of(field: str) -> str:
    return "$" + "".join(f"['{k}']" for k in field.split("."))


def program(t: Leaf | Node, number) -> list[int]:
    """Postfix steps; an ``all`` or ``any`` folds from the left, so the stack is as deep as the nesting."""
    if isinstance(t, Leaf):
        return [number(t)]
    out = program(t.items[0], number)
    if t.kind == "not":
        return [*out, NOT]
    for x in t.items[1:]:
        out += [*program(x, number), AND if t.kind == "all" else OR]
    return out


def compiled(bundle: Bundle) -> dict:
    """A bundle as plain values of COMPILED."""
    paths: dict[str, int] = {path_of(x): i for i, x in enumerate(("user.id", "user.groups", "channel"))}
    leaves: dict[str, tuple[int, dict]] = {}
    labels = list(bundle.labels)

    def number(x: Leaf) -> int:
        key = json.dumps([x.field, x.op, x.value, x.confidence], sort_keys=True)
        if key not in leaves:
            sit, value = x.field.startswith("sit."), x.value
            rank = labels.index(value.lower()) if isinstance(value, str) and value.lower() in labels else None
            told = {
                "at": -1 if sit else paths.setdefault(path_of(x.field), len(paths)),
                "op": "sit" if sit else {"ne": "eq", "not_in": "in"}.get(x.op, x.op),
                "negated": x.op in ("ne", "not_in"),
                "values": [json.dumps(v, sort_keys=True, ensure_ascii=False) for v in (value if x.op in ("in", "not_in") else [value])],
                "low": value.lower() if isinstance(value, str) else None,
                "number": float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None,
                "rank": rank,
                "labels": x.field.split(".")[-1] == "classification",
                "detector": x.field.removeprefix("sit.") if sit else None,
                "confidence": x.confidence,
                "least": value if x.op == "count_gte" else 1,
            }
            leaves[key] = len(leaves), told
        return leaves[key][0]

    micros = lambda t: None if t is None else int(t.timestamp() * 1_000_000)
    gates, rules, effects, n = [], [], [], -1
    for p in bundle.policies:
        if not p.enabled:
            n += len(p.rules)
            continue
        gates.append({"monitor": p.monitor, "activate_at": micros(p.activate_at), "expire_at": micros(p.expire_at), "channels": [_fold(c) for c in p.channels], **{k: list(v) for k, v in p.scope.items()}})
        for r in p.rules:
            n += 1
            rules.append({"ord": n, "policy": p.id, "policy_name": p.name, "rule": r.id, "priority": p.priority, "exception": r.exception, "enforcement": r.enforcement, "gate": len(gates) - 1, "program": program(r.when, number)})
            if not p.monitor:
                effects += [{"ord": n, "action": e.action, "params": e.params, "policy": p.id, "rule": r.id} for e in r.effects]
    return {"version": bundle.version, "default_action": bundle.default, "labels": labels, "paths": list(paths), "leaves": [x for _, x in leaves.values()], "gates": gates, "rules": rules, "effects": effects}


def compile_bundles(docs: DataFrame, *, tenant_col: str = "tenant_id", doc_col: str = "bundle") -> DataFrame:
    """COMPILED, a row for each tenant, of JSON bundles; ``error`` says why a bundle can't be used."""
    src = docs.groupBy(F.col(tenant_col).cast("string").alias("tenant_id")).agg(F.count(F.lit(1)).alias("n"), F.min(doc_col).alias("doc"))

    kinds = to_arrow_schema(StructType.fromDDL(COMPILED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tenant, n, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told = {}
                try:
                    bundle = load_bundle(doc or "null")
                    if n > 1:
                        raise BundleError("several bundles of one tenant")
                    if bundle.tenant_id != tenant:
                        raise BundleError("the bundle is another tenant's")
                    told = compiled(bundle)
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    told = {"error": str(e) or type(e).__name__}
                rows.append({"tenant_id": tenant, **told})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return _literals(src.mapInArrow(run, COMPILED))


def _literals(df: DataFrame) -> DataFrame:
    """Values to compare with as keys, made by the same expression as the facts' keys."""
    keys = lambda x: x.withField("values", F.transform(x["values"], lambda v: key_of(F.parse_json(v))))
    return df.withColumn("leaves", F.transform("leaves", keys))


def key_of(v: Column) -> Column:
    """A string that two VARIANT values share if they are equal: strings but for ASCII case, numbers as doubles, else by structure."""
    kind = F.schema_of_variant(v)
    text = F.concat(F.lit("s"), _fold(F.try_variant_get(v, "$", "string")))
    number = F.concat(F.lit("n"), (F.try_variant_get(v, "$", "double") + F.lit(0.0)).cast("string"))
    return F.when(F.is_variant_null(v), F.lit("z")).when(kind == "STRING", text).when(kind.rlike(NUMBER), number).otherwise(F.concat(F.lit("j"), F.to_json(v)))


def with_bundles(events: DataFrame, bundles: DataFrame, p: str, tenant_col: str) -> DataFrame:
    """Events with their tenant's compiled bundle as ``p`` + b; none: null."""
    own = bundles.filter("error IS NULL").select(F.col("tenant_id").alias(f"{p}t"), F.struct(*[c for c in bundles.columns if c not in ("tenant_id", "error")]).alias(f"{p}b"))
    size = own.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(f"{p}b")))).first()
    key = F.col(tenant_col).cast("string")
    if size[0] <= SMALL_ROWS and (size[1] or 0) <= SMALL_BYTES:
        return events.join(F.broadcast(own), key == F.col(f"{p}t"), "left").drop(f"{p}t")
    salts = own.withColumn(f"{p}salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("merge")
    dealt = events.withColumn(f"{p}at", F.floor(F.rand(7) * SALTS).cast("int"))
    return dealt.join(salts, (key == F.col(f"{p}t")) & (F.col(f"{p}at") == F.col(f"{p}salt")), "left").drop(f"{p}t", f"{p}salt", f"{p}at")


def _facts(paths: Column, facts: Column) -> Column:
    """By path: the value (null where missing) and its kind."""
    value = lambda q: F.try_variant_get(facts, q, "variant")
    return F.transform(paths, lambda q: F.when(~F.is_variant_null(value(q)), value(q)))


def _readings(values: Column) -> Column:
    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        return F.struct(
            v.isNotNull().alias("there"),
            key_of(v).alias("key"),
            F.transform(items, key_of).alias("keys"),
            F.lower(F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))).alias("low"),
            F.when(kind.rlike(NUMBER), F.try_variant_get(v, "$", "double")).alias("number"),
            F.filter(F.transform(items, lambda x: F.lower(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))), lambda x: x.isNotNull()).alias("lows"),
        )

    return F.transform(values, one)


def _outcome(x: Column, f: Column, hits: Column, labels: Column) -> Column:
    """Does a leaf hold for its fact?"""
    by_level = lambda h: sum((F.when(x["confidence"] <= i, F.coalesce(h["count_by_confidence"][k], F.lit(0))).otherwise(F.lit(0)) for i, k in enumerate(LEVELS)), F.lit(0))
    count = F.aggregate(hits, F.lit(0).cast("bigint"), lambda n, h: n + F.when((x["detector"] == "any") | (h["detector"] == x["detector"]), by_level(h)).otherwise(F.lit(0)))
    place = F.array_position(labels, f["low"])
    rank = F.when(x["labels"] & (place > 0), F.signum((place - 1 - x["rank"]).cast("double")))
    sign = F.when(x["number"].isNotNull() & f["number"].isNotNull(), F.signum(f["number"] - x["number"])).otherwise(rank)
    told = (
        F.when(x["op"] == "exists", F.lit(True))
        .when(x["op"] == "eq", f["key"] == x["values"][0])
        .when(x["op"] == "in", F.when(f["keys"].isNotNull(), F.arrays_overlap(f["keys"], x["values"])).otherwise(F.array_contains(x["values"], f["key"])))
        .when(x["op"] == "gt", sign > 0)
        .when(x["op"] == "gte", sign >= 0)
        .when(x["op"] == "lt", sign < 0)
        .when(x["op"] == "lte", sign <= 0)
        .when(x["op"] == "contains", F.when(f["keys"].isNotNull(), F.array_contains(f["keys"], x["values"][0])).otherwise(F.contains(f["low"], x["low"])))
        .when(x["op"] == "starts_with", F.startswith(f["low"], x["low"]))
        .when(x["op"] == "ends_with", F.endswith(f["low"], x["low"]))
    )
    told = F.coalesce(told, F.lit(False))
    fact = F.coalesce(f["there"], F.lit(False)) & (told != x["negated"])
    return F.when(x["op"] == "sit", F.coalesce(count, F.lit(0)) >= x["least"]).otherwise(fact)


def _holds(rule_program: Column, outcomes: Column) -> Column:
    """A program over the leaves' outcomes; the stack is the bits of a long, its top the lowest."""
    top = lambda s: s.bitwiseAND(F.lit(1))
    two = lambda s: F.shiftright(s, 1)

    def step(s: Column, op: Column) -> Column:
        leaf = F.when(F.get(outcomes, op), F.lit(1)).otherwise(F.lit(0))
        rest = F.shiftleft(F.shiftright(s, 2), 1)
        return (
            F.when(op >= 0, F.shiftleft(s, 1).bitwiseOR(leaf.cast("bigint")))
            .when(op == AND, rest.bitwiseOR(top(s).bitwiseAND(top(two(s)))))
            .when(op == OR, rest.bitwiseOR(top(s).bitwiseOR(top(two(s)))))
            .otherwise(s.bitwiseXOR(F.lit(1)))
            .cast("bigint")
        )

    return F.aggregate(rule_program, F.lit(0).cast("bigint"), step) == 1


def _open(g: Column, typed: Column, now: Column) -> Column:
    """Does the policy apply: schedule, channel, scope?"""
    user, groups, channel = (F.get(typed, F.lit(i)) for i in range(3))
    name = F.coalesce(user["low"], F.lit(""))
    member = F.coalesce(groups["lows"], F.when(groups["low"].isNotNull(), F.array(groups["low"])), F.array().cast("array<string>"))
    scoped = (F.size(g["users"]) > 0) | (F.size(g["groups"]) > 0)
    inside = F.array_contains(g["users"], name) | F.arrays_overlap(g["groups"], member)
    outside = F.array_contains(g["exclude_users"], name) | F.arrays_overlap(g["exclude_groups"], member)
    told = F.when(F.startswith(channel["key"], F.lit("s")), F.substr(channel["key"], F.lit(2)))
    covered = (F.size(g["channels"]) == 0) | F.array_contains(g["channels"], F.coalesce(told, F.lit("")))
    active = F.coalesce(now >= g["activate_at"], F.lit(True)) & F.coalesce(now < g["expire_at"], F.lit(True))
    return F.coalesce(active & covered & ~F.coalesce(outside, F.lit(False)) & (~scoped | F.coalesce(inside, F.lit(False))), F.lit(False))


def evaluate_tenants(df: DataFrame, bundles: DataFrame, *, tenant_col: str = "tenant_id", facts_col: str = "facts", now: datetime | Column, out_col: str = "verdict") -> DataFrame:
    """``df`` with the verdict of each row's own tenant; ``bundles``: COMPILED rows.  Notes on facts without an order are not made."""
    p = free_prefix(df)
    col = lambda name: F.col(p + name)
    out = with_bundles(df, bundles, p, tenant_col)
    at = F.unix_micros(F.lit(now) if isinstance(now, datetime) else now)
    out = out.select("*", F.try_variant_get(F.col(facts_col), "$.inspection.hits", HITS).alias(f"{p}hits"), _facts(F.col(f"{p}b.paths"), F.col(facts_col)).alias(f"{p}v"))
    out = out.select("*", held(_readings(col("v"))).alias(f"{p}typed"))
    leaves = F.transform(F.col(f"{p}b.leaves"), lambda x: _outcome(x, F.get(col("typed"), x["at"]), F.coalesce(col("hits"), F.array().cast(HITS)), F.col(f"{p}b.labels")))
    gates = F.transform(F.col(f"{p}b.gates"), lambda g: _open(g, col("typed"), at))
    out = out.select("*", held(leaves).alias(f"{p}leaves"), held(gates).alias(f"{p}gates"))
    rules = F.filter(F.col(f"{p}b.rules"), lambda r: F.get(col("gates"), r["gate"]) & _holds(r["program"], col("leaves")))
    out = out.withColumn(f"{p}rules", held(rules))
    monitor = lambda r: F.get(F.col(f"{p}b.gates"), r["gate"])["monitor"]
    shown = lambda xs: F.transform(xs, lambda r: F.struct(*[r[c].alias(c) for c in ("ord", "policy", "policy_name", "rule", "priority", "exception", "enforcement")]))
    matched = F.filter(col("rules"), lambda r: ~monitor(r))
    ords = F.transform(col("rules"), lambda r: r["ord"])
    effects = F.filter(F.col(f"{p}b.effects"), lambda e: F.array_contains(ords, e["ord"]))
    out = out.select("*", shown(matched).alias(f"{p}m"), shown(F.filter(col("rules"), monitor)).alias(f"{p}mon"), effects.alias(f"{p}fx"), F.array().cast("array<string>").alias(f"{p}notes"))
    out = decide(out, p, tenant=F.col(tenant_col).cast("string"), version=F.col(f"{p}b.version"), default=F.col(f"{p}b.default_action"), more={}, out_col=out_col)
    return out.withColumn(out_col, F.when(col("b").isNotNull(), F.col(out_col))).select(*df.columns, out_col)
