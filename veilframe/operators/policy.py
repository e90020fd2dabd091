"""Policy evaluation: facts to verdicts, a narrow map without a shuffle.

A bundle is compiled on the driver to one graph over a VARIANT column of facts: each
path is read once, each different leaf decided once, and the rules that match are
bits of a long.  evaluate() builds the whole verdict from them by array functions;
evaluate_fast() the decision alone, by arithmetic on the bits.  Policies that are
disabled or outside their schedule at a fixed time cost nothing.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.bundles import ENFORCEMENT, Bundle, Policy, Rule
from ..plans.conditions import Compiler, Graph, _fold, _text
from .names import free_prefix

_MATCH = "array<struct<ord:int,policy:string,policy_name:string,rule:string,priority:int,exception:boolean,enforcement:int>>"
_EFFECT = "array<struct<action:string,params:string,policy:string,rule:string>>"
_RULE_EFFECT = "array<struct<ord:int,action:string,params:string,policy:string,rule:string>>"


def _user(c: Compiler) -> Column:
    return F.coalesce(F.lower(c.fact("user.id").text), F.lit(""))


def _groups(c: Compiler) -> Column:
    """Group names in lower case; one string counts as a list of one."""
    f = c.fact("user.groups")
    many = F.filter(F.transform(f.items, lambda x: F.lower(_text(x))), lambda x: x.isNotNull())
    return F.coalesce(many, F.when(f.text.isNotNull(), F.array(F.lower(f.text))), F.array().cast("array<string>"))


def _in(names: tuple[str, ...], user: Column) -> Column:
    return user.isin(*names) if names else F.lit(False)


def _meets(names: tuple[str, ...], groups: Column) -> Column:
    return F.arrays_overlap(groups, F.array(*map(F.lit, names))) if names else F.lit(False)


def skipped_reason(p: Policy, facts: Column | Compiler, now: Column) -> Column:
    """Why the policy doesn't apply, or null: schedule, then enabled, channel, scope."""
    out = F.lit(None).cast("string")
    c = facts if isinstance(facts, Compiler) else Compiler(facts, [])
    s, user, groups = p.scope, _user(c), _groups(c)
    if s["users"] or s["groups"]:
        out = F.when(~(_in(s["users"], user) | _meets(s["groups"], groups)), F.lit("user is not in scope"))
    if s["exclude_users"] or s["exclude_groups"]:
        out = F.when(_in(s["exclude_users"], user) | _meets(s["exclude_groups"], groups), F.lit("user is excluded")).otherwise(out)
    if p.channels:
        channel = F.coalesce(_fold(c.fact("channel").text), F.lit(""))
        out = F.when(~channel.isin(*[_fold(c) for c in p.channels]), F.concat(F.lit("channel not covered: "), channel)).otherwise(out)
    if not p.enabled:
        out = F.lit("disabled")
    if p.expire_at is not None:
        out = F.when(now >= F.lit(p.expire_at), F.lit("expired")).otherwise(out)
    if p.activate_at is not None:
        out = F.when(now < F.lit(p.activate_at), F.lit("not active yet")).otherwise(out)
    return out


def _live(p: Policy, now: datetime | None) -> bool:
    """Can the policy apply at all?  Decided here when the time is fixed."""
    if not p.enabled:
        return False
    return now is None or not (p.activate_at and now < p.activate_at or p.expire_at and now >= p.expire_at)


def _match(k: int, p: Policy, r: Rule) -> Column:
    return F.struct(F.lit(k).alias("ord"), F.lit(p.id).alias("policy"), F.lit(p.name).alias("policy_name"), F.lit(r.id).alias("rule"), F.lit(p.priority).alias("priority"), F.lit(r.exception).alias("exception"), F.lit(r.enforcement).cast("int").alias("enforcement"))


def _array(items: list[Column], kind: str) -> Column:
    return F.array(*items) if items else F.array().cast(kind)


def held(c: Column) -> Column:
    """``c``, as a value that no filter is pushed below: else a filter on a verdict would be spelt out down to the facts."""
    return F.when(F.spark_partition_id() >= 0, c)


#: Rules in one long of a bit set.
WORD = 62


class Bits:
    """The rules that match, as longs: rule n is bit n % WORD of word n // WORD."""

    def __init__(self, words: list[Column]):
        self.words = words

    def has(self, n: int) -> Column:
        return self.words[n // WORD].bitwiseAND(F.lit(1 << n % WORD)) != 0

    def any(self, of: list[int]) -> Column:
        masks: dict[int, int] = {}
        for n in of:
            masks[n // WORD] = masks.get(n // WORD, 0) | 1 << n % WORD
        return reduce(lambda a, b: a | b, [self.words[w].bitwiseAND(F.lit(m)) != 0 for w, m in masks.items()], F.lit(False))

    def of(self, n: Column) -> Column:
        """The same for a rule number that is a Column."""
        word = F.get(F.array(*self.words), F.floor(n / WORD).cast("int")) if len(self.words) > 1 else self.words[0]
        return F.getbit(word, (n % WORD).cast("int")) == 1


def _matching(df: DataFrame, bundle: Bundle, facts_col: str, at: Column, fixed: datetime | None, p: str) -> tuple[DataFrame, Bits, Compiler, list[tuple[int, Policy, Rule]]]:
    """The frame with the bundle's graph, gates and bits of the rules that match, and the live rules (number from 0, in bundle order)."""
    rules = [(n, q, r) for n, (q, r) in enumerate((q, r) for q in bundle.policies for r in q.rules)]
    live = [(n, q, r) for n, q, r in rules if _live(q, fixed)]
    out = df.withColumn(f"{p}f", F.col(facts_col))
    graph = Graph([r.when for _, _, r in live], list(bundle.labels), p, ("user.id", "user.groups", "channel"))
    out = graph.read(out, F.col(f"{p}f"))
    c = Compiler(F.col(f"{p}f"), list(bundle.labels), graph)
    gates = {q.id: i for i, q in enumerate(bundle.policies) if _live(q, fixed)}
    out = out.select("*", *[skipped_reason(bundle.policies[i], c, at).isNull().alias(f"{p}g{i}") for i in gates.values()])
    words = []
    for w in range(max(1, -(-len(rules) // WORD))):
        own = [F.when(F.col(f"{p}g{gates[q.id]}") & c.tree(r.when), F.lit(1 << n % WORD)).otherwise(F.lit(0)) for n, q, r in live if n // WORD == w]
        words.append(held(reduce(lambda a, b: a.bitwiseOR(b), own, F.lit(0)).cast("long")).alias(f"{p}w{w}"))
    out = out.select("*", *words)
    return out, Bits([F.col(f"{p}w{w}") for w in range(len(words))]), c, live


def evaluate(df: DataFrame, bundle: Bundle, *, facts_col: str = "facts", now: datetime | Column, trace: bool = False, out_col: str = "verdict") -> DataFrame:
    """``df`` with a verdict struct.  ``facts_col``: VARIANT; ``now``: a fixed time (with offset) or a timestamp Column."""
    fixed = now if isinstance(now, datetime) else None
    at = F.lit(fixed) if fixed else now
    p = free_prefix(df)
    out, bits, c, live = _matching(df, bundle, facts_col, at, fixed, p)
    rules = {kind: _array([_match(n, q, r) for n, q, r in live if q.monitor == kind], _MATCH) for kind in (False, True)}
    effects = _array([F.struct(F.lit(n).alias("ord"), F.lit(e.action).alias("action"), F.lit(e.params).alias("params"), F.lit(q.id).alias("policy"), F.lit(r.id).alias("rule")) for n, q, r in live if not q.monitor for e in r.effects], _RULE_EFFECT)
    seen = lambda x: bits.of(x["ord"])
    gate = {q.id: F.col(f"{p}g{i}") for i, q in enumerate(bundle.policies)}
    notes = _array([F.when(gate[q.id], d) for _, q, r in live for d in c.diagnostics(r.when)], "array<string>")
    out = out.select("*", F.filter(rules[False], seen).alias(f"{p}m"), F.filter(rules[True], seen).alias(f"{p}mon"), F.filter(effects, seen).alias(f"{p}fx"), F.filter(notes, lambda x: x.isNotNull()).alias(f"{p}notes"))
    if trace:  # each policy's reason and trace is a column of its own, so that none is spelt out where it is used
        out = out.select("*", *[skipped_reason(q, c, at).alias(f"{p}y{i}") for i, q in enumerate(bundle.policies)])
    more = {"trace": _trace(bundle, c, [F.col(f"{p}y{i}") for i in range(len(bundle.policies))])} if trace else {}
    return decide(out, p, tenant=F.lit(bundle.tenant_id), version=F.lit(bundle.version), default=F.lit(bundle.default), more=more, out_col=out_col).select(*df.columns, out_col)


def decide(out: DataFrame, p: str, *, tenant: Column, version: Column, default: Column, more: dict[str, Column], out_col: str) -> DataFrame:
    """The verdict from the columns ``p`` + m (rules that match), mon (those in monitor mode), fx (their effects) and notes."""
    col = lambda name: F.col(p + name)
    # The strongest exception overrides every other match of lower priority; equal priority survives.
    out = out.withColumn(f"{p}px", F.array_max(F.transform(F.filter(col("m"), lambda m: m["exception"]), lambda m: m["priority"])))
    out = out.withColumn(f"{p}m", held(F.transform(col("m"), lambda m: m.withField("overridden", F.coalesce(~m["exception"] & (m["priority"] < col("px")), F.lit(False))))))
    standing = F.filter(col("m"), lambda m: ~m["exception"] & ~m["overridden"] & m["enforcement"].isNotNull())
    # Most restrictive first, then higher priority, then later in the bundle.
    win = F.array_max(F.transform(standing, lambda m: F.struct(m["enforcement"].alias("e"), m["priority"].alias("p"), m["ord"].alias("ord"), m.alias("m"))))
    ex = F.get(F.filter(col("m"), lambda m: m["exception"] & (m["priority"] == col("px"))), F.lit(0))
    dropped = F.transform(F.filter(col("m"), lambda m: m["overridden"]), lambda m: m["ord"])
    out = out.select("*", win.alias(f"{p}win"), ex.alias(f"{p}ex"), dropped.alias(f"{p}dropped"))
    name = lambda e: F.get(F.array(*map(F.lit, ENFORCEMENT)), e)
    action = F.when(col("win").isNotNull(), name(F.col(f"{p}win.e"))).when(col("ex").isNotNull(), F.lit("allow")).otherwise(default)
    fx = F.filter(col("fx"), lambda e: ~F.array_contains(col("dropped"), e["ord"]))
    out = out.select("*", held(F.coalesce(F.col(f"{p}win.m"), col("ex"))).alias(f"{p}by"), held(action).alias(f"{p}action"), held(fx).alias(f"{p}left"))
    # One incident at most: the deciding rule's, else the first.
    own = F.array_position(F.transform(col("left"), lambda e: F.when(e["action"] == "create_incident", e["ord"])), F.col(f"{p}by.ord"))
    first = F.array_position(F.transform(col("left"), lambda e: e["action"] == "create_incident"), F.lit(True))
    out = out.withColumn(f"{p}keep", held(F.when(own > 0, own).otherwise(first)))
    kept = F.filter(col("left"), lambda e, i: (e["action"] != "create_incident") | (i + 1 == col("keep")))
    kept = F.transform(kept, lambda e: F.struct(e["action"].alias("action"), e["params"].alias("params"), e["policy"].alias("policy"), e["rule"].alias("rule")))
    shown = lambda xs: F.transform(xs, lambda m: F.struct(m["policy"].alias("policy"), m["policy_name"].alias("policy_name"), m["rule"].alias("rule"), m["priority"].alias("priority"), m["exception"].alias("exception"), name(m["enforcement"]).alias("enforcement"), m["overridden"].alias("overridden")))
    monitors = F.transform(col("mon"), lambda m: m.withField("overridden", F.lit(False)))
    by = F.when(col("by").isNotNull(), F.struct(F.col(f"{p}by.policy").alias("policy"), F.col(f"{p}by.policy_name").alias("policy_name"), F.col(f"{p}by.rule").alias("rule"), F.col(f"{p}by.priority").alias("priority")))
    fields = [
        tenant.alias("tenant_id"),
        version.alias("bundle_version"),
        col("action").alias("action"),
        by.alias("decided_by"),
        shown(col("m")).alias("matched"),
        shown(monitors).alias("monitor_matches"),
        kept.alias("side_effects"),
        explanation(p).alias("explanation"),
        _without_repeats(col("notes")).alias("diagnostics"),
        *[c.alias(n) for n, c in more.items()],
    ]
    return out.withColumn(out_col, F.struct(*fields))


def evaluate_fast(df: DataFrame, bundle: Bundle, *, facts_col: str = "facts", now: datetime | Column, out_col: str = "verdict") -> DataFrame:
    """``df`` with the decision alone: action, decided_by, side_effects and the incident, as evaluate() tells them.

    Rules stay a bit set from the conditions to the decision: no notes, explanation, trace or list of
    matches is made, and no array is walked.
    """
    fixed = now if isinstance(now, datetime) else None
    p = free_prefix(df)
    out, bits, _, live = _matching(df, bundle, facts_col, F.lit(fixed) if fixed else now, fixed, p)
    own = [(n, q, r) for n, q, r in live if not q.monitor]
    exceptions = [(n, q.priority) for n, q, r in own if r.exception]
    tiers = sorted({x for _, x in exceptions}, reverse=True)
    first_of = lambda pairs, kind: F.coalesce(*[F.when(test, F.lit(told)) for test, told in pairs], F.lit(None).cast(kind))
    px = first_of([(bits.any([n for n, x in exceptions if x == t]), t) for t in tiers], "int")
    out = out.withColumn(f"{p}px", px)
    # Of the words, what the strongest exception leaves.
    n_words = len(bits.words)
    kept = []
    for w in range(n_words):
        carved = [(F.col(f"{p}px") == t, sum(1 << n % WORD for n, q, r in own if n // WORD == w and not r.exception and q.priority < t)) for t in tiers]
        mask = reduce(lambda a, x: a | 1 << x % WORD, [n for n, _, _ in own if n // WORD == w], 0)
        gone = first_of(carved, "long") if carved else F.lit(None).cast("long")
        kept.append(bits.words[w].bitwiseAND(F.lit(mask)).bitwiseAND(F.bitwise_not(F.coalesce(gone, F.lit(0)).cast("long"))).alias(f"{p}s{w}"))
    out = out.select("*", *kept)
    standing = Bits([F.col(f"{p}s{w}") for w in range(n_words)])
    ranked = sorted(((r.enforcement, q.priority, n) for n, q, r in own if not r.exception and r.enforcement is not None), reverse=True)
    win = first_of([(standing.has(n), n) for _, _, n in ranked], "int")
    excepted = first_of([(bits.has(n) & (F.col(f"{p}px") == x), n) for n, x in exceptions], "int")
    out = out.select("*", held(win).alias(f"{p}win"), held(excepted).alias(f"{p}ex"))
    by = F.coalesce(F.col(f"{p}win"), F.col(f"{p}ex"))
    at = {n: i for i, (n, _, _) in enumerate(own)}
    table = _array([F.struct(F.lit(q.id).alias("policy"), F.lit(q.name).alias("policy_name"), F.lit(r.id).alias("rule"), F.lit(q.priority).alias("priority")) for _, q, r in own], "array<struct<policy:string,policy_name:string,rule:string,priority:int>>")
    place = F.get(_array([F.lit(at.get(n)).cast("int") for n in range(max(at, default=-1) + 1)], "array<int>"), by)
    enforced = F.get(_array([F.lit(ENFORCEMENT[r.enforcement] if r.enforcement is not None else None).cast("string") for _, _, r in own], "array<string>"), place)
    action = F.when(F.col(f"{p}win").isNotNull(), enforced).when(F.col(f"{p}ex").isNotNull(), F.lit("allow")).otherwise(F.lit(bundle.default))
    effects = [(i, n, q, r, e) for i, (n, q, r, e) in enumerate((n, q, r, e) for n, q, r in own for e in r.effects)]
    incidents = [(i, n) for i, n, _, _, e in effects if e.action == "create_incident"]
    incident = first_of([*[(standing.has(n) & (by == n), i) for i, n in incidents], *[(standing.has(n), i) for i, n in incidents]], "int") if incidents else F.lit(None).cast("int")
    out = out.select("*", held(incident).alias(f"{p}inc"))
    told = [F.when(standing.has(n) & (F.col(f"{p}inc") == i if e.action == "create_incident" else F.lit(True)), F.struct(F.lit(e.action).alias("action"), F.lit(e.params).alias("params"), F.lit(q.id).alias("policy"), F.lit(r.id).alias("rule"))) for i, n, q, r, e in effects]
    fields = [F.lit(bundle.tenant_id).alias("tenant_id"), F.lit(bundle.version).alias("bundle_version"), action.alias("action"), F.get(table, place).alias("decided_by"), F.array_compact(_array(told, _EFFECT)).alias("side_effects")]
    return out.withColumn(out_col, F.struct(*fields)).select(*df.columns, out_col)


def _without_repeats(xs: Column) -> Column:
    """Neighbours that are equal count once; a note that comes back later stays."""
    before = F.concat(F.array(F.lit(None).cast("string")), xs)
    return F.filter(F.zip_with(xs, before, lambda x, b: F.when(~x.eqNullSafe(b), x)), lambda x: x.isNotNull())


def explanation(p: str) -> Column:
    """The decision in words."""
    by, ord_ = F.col(f"{p}by"), F.coalesce(F.col(f"{p}by.ord"), F.lit(-1))
    head = F.when(by.isNotNull(), F.concat(F.upper(f"{p}action"), F.lit(": decided by "), F.col(f"{p}by.policy_name"), F.lit(", rule "), F.col(f"{p}by.rule"), F.lit(", priority "), F.col(f"{p}by.priority").cast("string"), F.lit("."))).otherwise(F.concat(F.upper(f"{p}action"), F.lit(": no enforcing rule matched; this is the bundle's default.")))
    over = F.transform(F.filter(f"{p}m", lambda m: m["overridden"]), lambda m: F.concat_ws("/", m["policy_name"], m["rule"]))
    carved = F.when(F.size(over) > 0, F.concat(F.lit("An exception set aside "), F.array_join(over, ", "), F.lit(".")))
    rest = F.size(F.filter(f"{p}m", lambda m: ~m["overridden"] & ~m["exception"] & (m["ord"] != ord_)))
    others = F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" other rule(s) matched and ask for no more.")))
    watched = F.when(F.size(f"{p}mon") > 0, F.concat(F.size(f"{p}mon").cast("string"), F.lit(" rule(s) in monitor mode matched too.")))
    return F.concat_ws(" ", head, carved, others, watched)


def _trace(bundle: Bundle, c: Compiler, reasons: list[Column]) -> Column:
    """Every policy with why it was skipped, every rule of the others with every leaf."""
    out = []
    for p, why in zip(bundle.policies, reasons, strict=True):
        rules = [F.struct(F.lit(r.id).alias("rule"), c.tree(r.when).alias("matched"), c.trace(r.when).alias("conditions")) for r in p.rules]
        rows = F.array(*rules) if rules else F.array().cast("array<struct<rule:string,matched:boolean,conditions:array<struct<path:string,field:string,op:string,expected:string,list:string,actual:string,result:boolean>>>>")
        out.append(F.struct(F.lit(p.id).alias("policy"), why.isNull().alias("evaluated"), why.alias("skipped_reason"), F.when(why.isNull(), rows).otherwise(F.slice(rows, 1, 0)).alias("rules")))
    return held(F.array(*out)) if out else F.array()  # or explode()'s test for empty arrays is pushed down to the facts


def own_tenant(df: DataFrame, bundle: Bundle, tenant_col: str = "tenant_id") -> DataFrame:
    """Only the rows of the bundle's tenant."""
    return df.filter(F.col(tenant_col) == bundle.tenant_id)


