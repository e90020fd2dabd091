"""The shared graph, the fast mode and many bundles at once, against the full mode; keyed incidents against plain Python."""

import json
import random
import re
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.operators import policy, tenancy
from veilframe.plans import bundles
from veilframe.streaming import incidents

NOW = datetime(2026, 3, 1, 12, tzinfo=UTC)
LABELS = ["Public", "Internal", "Secret"]
VALUES = [None, True, False, 0, 5, 5.0, 7.5, -0.0, "u1", "U1", "secret", "Public", "other", "5", "", ["u1", 5, None], [], [["x"]], {"a": 1}, {"b": 2, "a": 1}]
FIELDS = ["user.id", "user.groups", "channel", "classification", "file.classification", "volume.k", "destination.deep.er", "sit.any", "sit.card"]


def some_leaf(r):
    field = r.choice(FIELDS)
    if field.startswith("sit."):
        return r.choice([{"field": field, "op": "exists"}, {"field": field, "op": "count_gte", "value": r.randint(1, 4), "min_confidence": r.choice(["low", "medium", "high"])}])
    op = r.choice(["eq", "ne", "in", "not_in", "gt", "gte", "lt", "lte", "contains", "starts_with", "ends_with", "exists"])
    if op == "exists":
        return {"field": field, "op": op}
    if op in ("in", "not_in"):
        return {"field": field, "op": op, "value": r.choices(VALUES, k=r.randint(0, 3))}
    return {"field": field, "op": op, "value": r.choice([v for v in VALUES if v is not None])}


def some_tree(r, depth=0):
    kind = r.choice(["leaf", "leaf", "all", "any", "not"]) if depth < 4 else "leaf"
    if kind == "leaf":
        return some_leaf(r)
    return {"not": some_tree(r, depth + 1)} if kind == "not" else {kind: [some_tree(r, depth + 1) for _ in range(r.randint(1, 3))]}


def some_bundle(r, tenant, n_policies):
    out = []
    for k in range(n_policies):
        rules = []
        for j in range(r.randint(0, 3)):
            exception = r.random() < 0.25
            then = [{"action": "allow"}] if exception and r.random() < 0.7 else [] if exception else [{"action": x} for x in r.sample(["allow", "audit", "warn", "block"], k=r.randint(0, 1))]
            then += [{"action": x, "n": k} for x in r.choices(["create_incident", "tag", "notify_user"], k=r.randint(0, 2))]
            rules.append({"id": f"r{j}", "exception": exception, "when": some_tree(r), "then": then or [{"action": "tag"}]})
        p = {"id": f"p{k}", "name": f"P{k}", "priority": r.randint(0, 3), "rules": rules, "mode": r.choice(["enforce"] * 4 + ["monitor"]), "enabled": r.random() < 0.9}
        if r.random() < 0.3:
            p["channels"] = r.sample(["EMAIL", "web", "u1"], k=2)
        if r.random() < 0.3:
            p["scope"] = {r.choice(["users", "groups", "exclude_users", "exclude_groups"]): ["U1", "g1"]}
        if r.random() < 0.3:
            p["schedule"] = {r.choice(["activate_at", "expire_at"]): r.choice(["2026-03-01T12:00:00Z", "2026-03-01T13:00:00+02:00"])}
        out.append(p)
    return {"schema_version": "1.0", "tenant_id": tenant, "bundle_version": "1", "classifications": LABELS, "default_action": r.choice(["allow", "audit"]), "policies": out}


def some_facts(r):
    pick = lambda: r.choice(VALUES)
    out = {"user": r.choice([None, {"id": pick(), "groups": r.choice(["G1", ["g1", 7], pick()])}]), "channel": r.choice(["email", "WEB", pick()]), "classification": pick(), "file": {"classification": pick()}, "volume": {"k": pick()}, "destination": {"deep": r.choice([{"er": pick()}, [{"er": 1}], 3])}}
    if r.random() < 0.5:
        out["inspection"] = {"hits": [{"detector": d, "count_by_confidence": {"low": r.randint(0, 2), "medium": r.randint(0, 2), "high": r.randint(0, 2)}} for d in ("card", "mail")]}
    return json.dumps(out)


def test_modes_agree(spark):
    """Random bundles, one with more rules than a long has bits: fast and many-tenant verdicts are those of the full mode."""
    r = random.Random(4)
    docs = {f"t{k}": some_bundle(r, f"t{k}", n) for k, n in enumerate((4, 6, 9, 60))}
    assert sum(len(p["rules"]) for p in docs["t3"]["policies"]) > policy.WORD
    rows = [(k, f"t{k % 6}", some_facts(r), "mine", 1) for k in range(240)]  # two tenants have no bundle
    df = spark.createDataFrame(rows, "k long, tenant_id string, j string, found string, __p int").withColumn("facts", F.parse_json("j")).drop("j")
    compiled = tenancy.compile_bundles(spark.createDataFrame([(t, json.dumps(x)) for t, x in docs.items()] + [("t5", "[]")], "tenant_id string, bundle string"))
    many = tenancy.evaluate_tenants(df, compiled, now=NOW)
    assert many.columns == [*df.columns, "verdict"]
    got = {x["k"]: x["verdict"] and x["verdict"].asDict(True) for x in many.collect()}
    decided, incidents_ = set(), 0
    for t, doc in docs.items():
        bundle = bundles.load_bundle(doc)
        own = df.filter(F.col("tenant_id") == t)
        full = {x["k"]: x["verdict"].asDict(True) for x in policy.evaluate(own, bundle, now=NOW).collect()}
        fast = {x["k"]: x["verdict"].asDict(True) for x in policy.evaluate_fast(own, bundle, now=NOW).collect()}
        for k, v in full.items():
            assert {c: v[c] for c in fast[k]} == fast[k], (t, k)
            v["diagnostics"] = []
            assert got[k] == v, (t, k)
            decided.add(v["action"])
            incidents_ += any(e["action"] == "create_incident" for e in v["side_effects"])
    assert len(decided) > 3 and incidents_ > 20
    assert all(got[k] is None for k, t, *_ in rows if t in ("t4", "t5"))


def test_salted_bundles(spark, monkeypatch):
    monkeypatch.setattr(tenancy, "SMALL_ROWS", 0)
    doc = {"schema_version": "1.0", "tenant_id": "a", "bundle_version": "1", "classifications": ["x"], "default_action": "audit", "policies": []}
    compiled = tenancy.compile_bundles(spark.createDataFrame([("a", json.dumps(doc)), ("b", "no json"), ("c", json.dumps(doc)), ("d", None), ("a2", json.dumps(doc | {"tenant_id": "a2"})), ("a2", "{}")], "tenant_id string, bundle string"))
    assert {x["tenant_id"] for x in compiled.filter("error IS NULL").collect()} == {"a"}
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(50)] + [(99, None)], "k long, tenant_id string").withColumn("facts", F.parse_json(F.lit("{}")))
    got = {x["k"]: x["verdict"] and x["verdict"]["action"] for x in tenancy.evaluate_tenants(df, compiled, now=NOW).collect()}
    assert got == {k: "audit" if k % 2 == 0 else None for k in range(50)} | {99: None}


def test_each_path_is_read_once(spark):
    """The plan names each fact path once, and doesn't grow when many rules share leaves."""
    leaf = {"field": "volume.k", "op": "gte", "value": 5}
    rule = lambda k: {"id": f"r{k}", "when": {"any": [leaf, {"field": "channel", "op": "eq", "value": f"c{k % 3}"}]}, "then": [{"action": "block"}, {"action": "create_incident"}]}
    df = spark.createDataFrame([("{}",)], "j string").select(F.parse_json("j").alias("facts"))
    for mode in (policy.evaluate, policy.evaluate_fast):
        told = []
        for n in (3, 40):
            b = bundles.load_bundle({"schema_version": "1.0", "tenant_id": "a", "bundle_version": "1", "classifications": ["x"], "policies": [{"id": "p", "priority": 1, "rules": [rule(k) for k in range(n)]}]})
            plan = mode(df, b, now=NOW).select("verdict.action").filter("action = 'block'")._jdf.queryExecution().optimizedPlan().toString()
            assert len(re.findall(r"volume", plan)) == 1 == len(re.findall(r"\['channel", plan)), mode
            told.append(plan.count("try_variant_get"))
        assert told[0] == told[1] < 12


def test_merged_incidents():
    r = random.Random(3)
    for _ in range(300):
        times = [r.randint(0, 300) for _ in range(r.randint(1, 30))]
        open_ = []
        for k in range(0, len(times), 4):
            open_ = incidents.merged(open_, np.array(times[k : k + 4]), 10)
        want = []
        for t in sorted(times):
            if want and t - want[-1][1] <= 10:
                want[-1] = (want[-1][0], t, want[-1][2] + 1)
            else:
                want.append((t, t, 1))
        assert open_ == want


def test_keyed_incidents_over_restarts(spark, tmp_path):
    """Batches out of order, an event that bridges two open incidents, repeats, a late one; state goes when incidents close."""
    from veilframe.streaming import whole

    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    schema = "tenant_id string, dedup_key string, event_id string, occurred_at timestamp_ntz"
    batches = [
        [("t", "k", "a", at(0)), ("t", "k", "b", at(100)), ("t", "q", "a", at(5)), (None, "k", "n", at(1)), ("t", "k", None, at(1))],
        [("t", "k", "c", at(50)), ("t", "k", "a", at(0)), ("u", "k", "a", at(3))],
        [("t", "k", "d", at(2000))],
        [("t", "k", "e", at(1)), ("t", "k", "f", at(2050))],  # the first one is late
        [("t", "-", "z", at(90_000))],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        src = spark.readStream.schema(schema.replace("timestamp_ntz", "timestamp")).parquet(f"{tmp_path}/in")
        whole.start(incidents.keyed_incidents(src, window=timedelta(minutes=60), late="3 hours"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        if n == 3:  # going on with nothing new changes nothing
            whole.start(incidents.keyed_incidents(src, window=timedelta(minutes=60), late="3 hours"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.schema(incidents.INCIDENT).parquet(f"{tmp_path}/out")
    told = sorted((x["tenant_id"], x["dedup_key"], x["s"], x["e"], x["occurrences"]) for x in got.withColumns({"s": F.expr("cast((unix_micros(first_seen_at) - 1704067200000000) / 60000000 as int)"), "e": F.expr("cast((unix_micros(last_seen_at) - 1704067200000000) / 60000000 as int)")}).collect())
    assert told == [("t", "k", 0, 100, 3), ("t", "k", 2000, 2050, 2), ("t", "q", 5, 5, 1), ("u", "k", 3, 3, 1)]


@pytest.mark.parametrize("bad", ["x", "{}", '{"schema_version": "1.0"}'])
def test_bundles_that_cant_be_used(spark, bad):
    (row,) = tenancy.compile_bundles(spark.createDataFrame([("a", bad)], "tenant_id string, bundle string")).collect()
    assert row["error"] and row["rules"] is None
