"""Unit tests of checks, masks, inspection, conditions, verdicts and the store."""

import base64
import json
import math
import os
from collections import Counter
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import masks, text, validators
from veilframe.operators import inspect as ins
from veilframe.operators import policy, secrets, store
from veilframe.plans import bundles, conditions, packs
from veilframe.sources import readers

def made_key():
    """A value of a secret key's shape, made when the test runs."""
    import random
    import string

    letters = list(string.ascii_letters[15:45] + string.digits)
    random.Random(6).shuffle(letters)
    return "".join(letters)


NOW = datetime(2026, 3, 1, 12, tzinfo=UTC)


def one(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in df.withColumn("y", f(F.col("x"))).orderBy("k").collect()]


def test_checks(spark):
    assert one(spark, ["79927398713", "79927398710", "0", "", "4a"], validators.luhn) == [True, False, False, False, False]
    assert one(spark, ["4916 7305 2218 6409", "5277019344661256", "1234567812345670", "378282246310005"], validators.card) == [True, True, False, True]
    assert one(spark, ["GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "GB83WEST12345698765432", "XX82WEST12345698765432", "DE89370400440532013000"], validators.iban) == [True, True, False, False, True]
    assert one(spark, ["2363", "2364", "x", ""], validators.verhoeff) == [True, False, False, False]
    assert one(spark, ["7310 5528 4605", "0310 5528 4605", "7310 5528 4606"], validators.aadhaar) == [True, False, False]
    assert one(spark, ["XYZPL5678K", "XYZXL5678K", "XYZPL5678"], validators.india_pan) == [True, False, False]
    assert one(spark, ["784-1994-2316075-5", "784199423160756", "785199423160755"], validators.emirates_id) == [True, False, False]


def b64(d):
    return base64.urlsafe_b64encode(d if isinstance(d, bytes) else json.dumps(d).encode()).rstrip(b"=").decode()


def test_jwt(spark):
    heads = [b64({"alg": "none"}), b64({"typ": "x"}), b64([1]), b64(b"\xff\xfe"), "!!", b64("alg")]
    assert one(spark, [h + ".x.y" for h in heads], validators.jwt) == [True, False, False, False, False, False]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=10))
def test_entropy(spark, values):
    def want(s):
        b = s.encode()
        return -sum(n / len(b) * math.log2(n / len(b)) for n in Counter(b).values()) if b else 0.0

    values = [v for v in values if "\x00" not in v and v.isprintable()] or ["aab"]
    assert one(spark, values, validators.entropy) == pytest.approx([want(v) for v in values])


def test_masks(spark):
    assert one(spark, ["4916 7305 2218 6409", "1234"], masks.mask_card) == ["491673******6409", "****"]
    assert one(spark, ["abcdefghijklmnop", "abc"], masks.mask_secret) == ["abcd…[16 chars]", "…[3 chars]"]
    assert one(spark, ["abcdef", "jane@example.org"], masks.mask_partial) == ["******", "ja************rg"]
    assert one(spark, ["é1"], masks.mask_full) == ["[2 chars]"]
    assert one(spark, ["a b-c.d"], masks.canonical) == ["ABCD"]
    assert one(spark, ["a b-c.d"], masks.distinct_key) == ["abc.d"]


def test_normalise(spark):
    t, cut = text.normalise(F.col("x"))
    df = spark.createDataFrame([("４１ ​\n x­",), ("\x1cab",), (None,)], "x string")
    assert [r["t"] for r in df.select(t.alias("t")).collect()] == ["41 x", "\x1cab", None]
    got = spark.createDataFrame([("aéé",)], "x string").select(*[text.cut(F.col("x"), n)[0].alias(f"c{n}") for n in (1, 2, 3, 4, 5)]).first()
    assert tuple(got) == ("a", "a", "aé", "aé", "aéé")


def test_inspect(spark):
    card, key = "4916 7305 2218 6409", made_key()
    texts = [
        f"ü {card} and {card.replace(' ', '-')} then\n5277019344661256",
        f"visa {card}",
        "4111 1111 1111 1111 card",
        card + "." * 70 + " discard " + card,  # the first occurrence decides
        "discard " + card,  # keywords are substrings
        "card" + "é" * 33 + " " + card,  # within bytes, not characters
        f"x={key}",
        f"aws_secret={key}",
        "mail ann.roe@example.org",
        "IBAN AE39 0217 7182 0446 7391 025",
        "nothing",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    seen = [r["inspection"] for r in ins.inspect(df).orderBy("i").collect()]
    hits = [{h["detector"]: h for h in r["hits"]} for r in seen[:-1]]
    h = hits[0]["credit_card"]
    assert h["count"] == 2 and h["count_by_confidence"]["medium"] == 2 and h["max_confidence"] == "medium"
    assert [(s["start"], s["end"], s["masked"]) for s in h["samples"]][0] == (3, 22, card[:4] + card[5:7] + "******" + card[-4:])
    assert seen[0]["packs"] == ["builtin@1.0.0"] and not seen[0]["truncated"]
    assert [x["credit_card"]["max_confidence"] for x in hits[1:6]] == ["high", "low", "medium", "high", "medium"]
    assert "aws_secret_access_key" not in hits[6]
    assert hits[7]["aws_secret_access_key"]["samples"][0]["masked"] == key[:4] + "…[40 chars]"
    assert hits[8]["email_address"]["max_confidence"] == "low" and hits[9]["iban"]["count"] == 1
    assert hits[10] == {} and seen[11] is None
    one = packs.Pack("x", "1", packs.BUILTIN.detectors[:1])
    small = ins.inspect(df.limit(1), packs=[one], budget=ins.Budget(max_bytes=10)).first()["inspection"]
    assert small["truncated"] and small["bytes_inspected"] == 10


def test_native_and_re2_agree(spark):
    texts = ["ü, 4916 7305 2218 6409, jane@x.org é", "", "IBAN AE39 0217 7182 0446 7391 025 pan XYZPL5678K", "a@b.cc a@b.cc", "card 5277019344661256 5277019344661256"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    a = [r["inspection"]["hits"] for r in ins.inspect(df).collect()]
    b = [r["inspection"]["hits"] for r in ins.inspect_custom(df, [packs.BUILTIN]).collect()]
    assert a == b


def test_custom_pack_and_hostile_text(spark):
    p = packs.load_pack({"pack": "own", "version": "2", "detectors": [{"id": "case", "name": "c", "category": "x", "pattern": "CASE-(\\d{4})", "tests": {"match": ["CASE-1234"], "no_match": ["CASE-12"]}}, {"id": "bad", "name": "b", "category": "x", "pattern": "(a+)+$"}]})
    df = spark.createDataFrame([("see CASE-1234 and CASE-9999 " + "a" * 100_000 + "!",)], "text string")
    hits = ins.inspect_custom(df, [p]).first()["inspection"]["hits"]
    assert [(h["detector"], h["count"]) for h in hits] == [("case", 2)]
    assert all(r["ok"] for r in ins.self_test(spark, [p]).collect())
    with pytest.raises(packs.PackError):
        packs.merge([p, p])
    with pytest.raises(packs.PackError):
        packs.load_pack({"pack": "x", "version": "1", "detectors": [{"id": "a", "name": "", "category": "", "pattern": "a", "odd": 1}]})
    with pytest.raises(packs.PackError):
        packs.load_pack({"pack": "x", "version": "1", "detectors": [{"id": "a", "name": "", "category": "", "pattern": "a", "require_keyword": True}]})


# ------------------------------------------------------------- conditions

FACTS = [
    {"channel": "Email", "user": {"id": "U1", "groups": ["A", "b"]}, "volume": {"n": 5, "s": "5"}, "classification": "secret", "destination": {"external": True, "list": [1, {"a": 1, "b": 2}]}},
    {"channel": None, "user": {"groups": "b"}, "volume": {"n": 5.5}, "classification": "odd", "destination": [1]},
    {},
    None,
    [1, 2],
    "text",
    {"inspection": {"hits": [{"detector": "card", "count_by_confidence": {"low": 1, "medium": 2, "high": 3}}, {"detector": "mail", "count_by_confidence": {"low": 4, "medium": 0, "high": 0}}]}},
]
CASES = [
    ({"field": "channel", "op": "eq", "value": "email"}, "1000000"),
    ({"field": "channel", "op": "ne", "value": "web"}, "1000000"),
    ({"not": {"field": "channel", "op": "eq", "value": "email"}}, "0111111"),
    ({"field": "channel", "op": "in", "value": ["x", "EMAIL"]}, "1000000"),
    ({"field": "user.groups", "op": "in", "value": ["B"]}, "1100000"),
    ({"field": "user.groups", "op": "not_in", "value": ["z"]}, "1100000"),
    ({"field": "volume.n", "op": "eq", "value": 5.0}, "1000000"),
    ({"field": "volume.s", "op": "eq", "value": 5}, "0000000"),
    ({"field": "volume.n", "op": "gt", "value": 5}, "0100000"),
    ({"field": "volume.n", "op": "lte", "value": 5}, "1000000"),
    ({"field": "volume.s", "op": "lt", "value": 9}, "0000000"),
    ({"field": "classification", "op": "gte", "value": "Internal"}, "1000000"),
    ({"field": "classification", "op": "lt", "value": "secret"}, "0000000"),
    ({"field": "classification", "op": "eq", "value": "ODD"}, "0100000"),
    ({"field": "channel", "op": "contains", "value": "MAI"}, "1000000"),
    ({"field": "user.groups", "op": "contains", "value": "a"}, "1000000"),
    ({"field": "channel", "op": "starts_with", "value": "em"}, "1000000"),
    ({"field": "channel", "op": "ends_with", "value": "IL"}, "1000000"),
    ({"field": "volume.n", "op": "starts_with", "value": "5"}, "0000000"),
    ({"field": "destination.external", "op": "eq", "value": True}, "1000000"),
    ({"field": "destination.list", "op": "eq", "value": [1, {"b": 2, "a": 1}]}, "1000000"),
    ({"field": "destination.list.0", "op": "exists"}, "0000000"),
    ({"field": "channel", "op": "exists"}, "1000000"),
    ({"field": "sit.card", "op": "exists"}, "0000001"),
    ({"field": "sit.mail", "op": "exists"}, "0000000"),
    ({"field": "sit.mail", "op": "count_gte", "value": 4, "min_confidence": "low"}, "0000001"),
    ({"field": "sit.card", "op": "count_gte", "value": 4, "min_confidence": "high"}, "0000000"),
    ({"field": "sit.any", "op": "count_gte", "value": 10, "min_confidence": "low"}, "0000001"),
    ({"field": "sit", "op": "exists"}, "0000000"),
    ({"all": [{"field": "channel", "op": "exists"}, {"any": [{"field": "volume.n", "op": "eq", "value": 1}, {"field": "user.id", "op": "eq", "value": "u1"}]}]}, "1000000"),
]


def test_conditions(spark):
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(FACTS)], "i int, j string").select("i", F.parse_json("j").alias("f"))
    c = conditions.Compiler(F.col("f"), ["Public", "Internal", "Secret"])
    rows = df.select("i", *[c.tree(conditions.parse(t, {})).alias(f"c{k}") for k, (t, _) in enumerate(CASES)]).orderBy("i").collect()
    for k, (tree, want) in enumerate(CASES):
        assert "".join(str(int(r[f"c{k}"])) for r in rows) == want, tree


@pytest.mark.parametrize("tree", [1, {}, {"all": []}, {"any": 3}, {"field": "x", "op": "eq", "value": 1}, {"field": "user", "op": "is", "value": 1}, {"field": "user", "op": "eq"}, {"field": "user", "op": "in", "value": 1}, {"field": "user", "op": "exists", "value": 1}, {"field": "sit.a", "op": "eq", "value": 1}, {"field": "user", "op": "count_gte", "value": 1}, {"field": "sit.a", "op": "count_gte", "value": 0}, {"field": "user", "op": "eq", "value": 1, "min_confidence": "all"}, {"field": "user", "op": "in", "value": {"list": "no"}}, {"field": "user", "op": "eq", "value": 1, "extra": 1}, {"all": [{"field": "user", "op": "exists"}] * 257}])
def test_bad_conditions(tree):
    with pytest.raises(conditions.ConditionError):
        conditions.parse(tree, {})


def test_depth_and_lists():
    tree = {"field": "user", "op": "exists"}
    for _ in range(16):
        tree = {"not": tree}
    conditions.parse(tree, {})
    with pytest.raises(conditions.ConditionError):
        conditions.parse({"not": tree}, {})
    assert conditions.parse({"field": "user", "op": "eq", "value": {"list": "l"}, "min_confidence": 3}, {"l": [1]}).value == [1]


# ------------------------------------------------------------------ verdicts


def rule(i, *then, when=None, **kw):
    return {"id": i, "when": when or {"field": "channel", "op": "exists"}, "then": [{"action": t} if isinstance(t, str) else t for t in then], **kw}


def pol(i, priority, *rules, **kw):
    return {"id": i, "name": f"P {i}", "priority": priority, "rules": list(rules), **kw}


def bundle(*policies, default="allow"):
    return bundles.load_bundle({"schema_version": "1.0", "tenant_id": "t", "bundle_version": "v", "classifications": ["Public", "Secret"], "lists": {}, "default_action": default, "policies": list(policies)})


def verdict(spark, b, facts=None, **kw):
    df = spark.createDataFrame([(json.dumps(facts if facts is not None else {"channel": "web", "user": {"id": "u"}}),)], "j string").select(F.parse_json("j").alias("facts"))
    return policy.evaluate(df, b, now=kw.pop("now", NOW), **kw).first()["verdict"]


def test_winner_ties_and_default(spark):
    v = verdict(spark, bundle(pol("a", 1, rule("r", "block")), pol("b", 2, rule("r", "warn"), rule("s", "block")), pol("c", 2, rule("r", "block"))))
    assert v["action"] == "block" and (v["decided_by"]["policy"], v["decided_by"]["rule"]) == ("c", "r")
    assert verdict(spark, bundle(default="warn"))["action"] == "warn"
    assert verdict(spark, bundle(pol("a", 1, rule("r", "tag")), default="audit"))["action"] == "audit"
    assert verdict(spark, bundle(pol("a", 1, rule("r", "allow")), default="block"))["action"] == "allow"


def test_exceptions(spark):
    ex = rule("x", "allow", {"action": "tag", "name": "n"}, exception=True)
    v = verdict(spark, bundle(pol("a", 1, rule("r", "block", "notify_user")), pol("b", 2, ex)))
    assert v["action"] == "allow" and v["decided_by"]["rule"] == "x"
    assert [e["action"] for e in v["side_effects"]] == ["tag"] and [m["overridden"] for m in v["matched"]] == [True, False]
    assert verdict(spark, bundle(pol("a", 2, rule("r", "block")), pol("b", 2, ex)))["action"] == "block"
    assert verdict(spark, bundle(pol("a", 1, rule("r", "block")), pol("b", 2, ex, mode="monitor")))["action"] == "block"
    assert verdict(spark, bundle(pol("b", 2, rule("x", "tag", exception=True)), default="block"))["action"] == "allow"


def test_incident_once(spark):
    inc = lambda s: {"action": "create_incident", "severity": s}
    v = verdict(spark, bundle(pol("a", 1, rule("r", "warn", inc("low"))), pol("b", 1, rule("r", "block", inc("high"), "tag"))))
    assert [(e["action"], json.loads(e["params"]).get("severity")) for e in v["side_effects"]] == [("create_incident", "high"), ("tag", None)]
    v = verdict(spark, bundle(pol("a", 1, rule("r", "warn", inc("low"))), pol("b", 1, rule("r", "tag", inc("high"))), pol("c", 1, rule("r", "block"))))
    assert [json.loads(e["params"]).get("severity") for e in v["side_effects"] if e["action"] == "create_incident"] == ["low"]


def test_gates(spark):
    p = lambda **kw: bundle(pol("a", 1, rule("r", "block"), **kw))
    act = lambda b, **kw: verdict(spark, b, **kw)["action"]
    assert act(p(channels=["WEB"])) == "block" and act(p(channels=["mail"])) == "allow" and act(p(enabled=False)) == "allow"
    assert act(p(scope={"users": ["U"]})) == "block" and act(p(scope={"groups": ["g"]})) == "allow"
    assert act(p(scope={"users": ["u"], "exclude_users": ["u"]})) == "allow"
    assert act(p(scope={"groups": ["G"]}), facts={"channel": "x", "user": {"groups": "g"}}) == "block"
    assert act(p(scope={"users": [""]}), facts={"channel": "x"}) == "block"
    at = NOW.isoformat()
    assert act(p(schedule={"activate_at": at})) == "block" and act(p(schedule={"expire_at": at})) == "allow"
    assert act(p(schedule={"activate_at": at}), now=F.lit(NOW)) == "block" and act(p(schedule={"expire_at": at}), now=F.lit(NOW)) == "allow"


def test_trace_and_diagnostics(spark):
    when = {"all": [{"field": "classification", "op": "gte", "value": "Secret"}, {"field": "channel", "op": "eq", "value": "web"}]}
    v = verdict(spark, bundle(pol("a", 1, rule("r", "block", when=when)), pol("b", 1, rule("r", "warn"), channels=["mail"])), facts={"channel": "web", "classification": "odd"}, trace=True)
    assert len(v["diagnostics"]) == 1 and v["action"] == "allow"
    t = v["trace"]
    assert [(x["policy"], x["evaluated"]) for x in t] == [("a", True), ("b", False)] and "channel" in t[1]["skipped_reason"]
    assert [(c["path"], c["result"]) for c in t[0]["rules"][0]["conditions"]] == [("when.all[0]", False), ("when.all[1]", True)]
    v = verdict(spark, bundle(pol("a", 1, rule("r", "block"), mode="monitor")))
    assert v["action"] == "allow" and len(v["monitor_matches"]) == 1 and "monitor" in v["explanation"]


def test_bad_bundles():
    for bad in (
        [pol("a", 1, rule("r", "block")), pol("a", 1, rule("r", "block"))],
        [pol("a", 1, rule("r", "block"), rule("r", "warn"))],
        [pol("a", 1, rule("r", "block", "warn"))],
        [pol("a", 1, rule("r"))],
        [pol("a", 1, rule("r", "block", exception=True))],
        [pol("a", 1, rule("r", "explode"))],
        [pol("a", 1, rule("r", "block", when={"field": "destnation", "op": "exists"}))],
        [pol("a", 1, rule("r", "block"), schedule={"activate_at": "soon"})],
    ):
        with pytest.raises(bundles.BundleError):
            bundle(*bad)


# --------------------------------------------------------------------- store


def chain(spark):
    rows = [("a", datetime(2026, 1, 1, 0, 0, k, 5), "bob", None, "login", "user", str(k), None, '{"x": 1}', "success") for k in range(5)] + [("b", datetime(2026, 1, 1), "eve", "10.0.0.1", "read", "file", None, None, None, "denied")]
    df = spark.createDataFrame(rows, "tenant_id string, ts timestamp, actor string, source_ip string, action string, object_type string, object_id string, old_value string, new_value string, result string")
    return store.build_audit_chain(df)


def test_audit_chain(spark):
    c = chain(spark).cache()
    assert {(r["tenant_id"], r["n_rows"], r["first_bad_seq"]) for r in store.verify_audit_chain(c).collect()} == {("a", 5, None), ("b", 1, None)}
    bad = c.withColumn("actor", F.when((F.col("tenant_id") == "a") & (F.col("seq") == 3), "mallory").otherwise(F.col("actor")))
    assert dict(store.verify_audit_chain(bad).select("tenant_id", "first_bad_seq").collect())["a"] == 3
    gone = c.filter("NOT (tenant_id = 'a' AND seq = 2)")
    assert dict(store.verify_audit_chain(gone).select("tenant_id", "first_bad_seq").collect())["a"] == 3


def test_views_and_versions(spark):
    t = spark.createDataFrame([("p", "/p"), ("p1", "/p/a"), ("p2", "/pa"), ("x", "/p/a/b")], "tenant_id string, path string")
    assert store.tenant_view(t, None).count() == 0 and store.tenant_view(t, "p").count() == 1
    assert sorted(r["tenant_id"] for r in store.tenant_subtree(t, "/p").collect()) == ["p", "p1", "x"]
    assert store.foreign_rows(t, "p").count() == 3
    before = spark.createDataFrame([(1, "d", None), (2, "e", "s"), (3, "f", None)], "id int, document string, approved string")
    after = spark.createDataFrame([(1, "d", "s"), (2, "E", "z")], "id int, document string, approved string")
    got = {(r["id"], r["violation"]) for r in store.version_violations(before, after, ["id"], ["document"], ["approved"]).collect()}
    assert got == {(2, "document changed"), (2, "approved set again"), (3, "deleted")}
    bad = store.domain_violations(before, {"short": F.length("document") < 1, "known": F.col("approved").isin("s")})
    assert sorted((r["id"], r["violation"]) for r in bad.collect()) == [(1, "short"), (2, "short"), (3, "short")]


def test_secret_lines(spark):
    key = made_key()
    known = "AKIA" + "IOSFODNN7" + "EXAMPLE"
    s = "\n".join([f"aws {key}", f"bare {key}", known, "b64:" + base64.b64encode(known.encode()).decode(), "xoxb-" + "1234567890ab"])
    got = [(r["line"], r["finding"]) for r in secrets.scan_lines(spark.createDataFrame([(1, s)], "id int, t string"), "id", "t").collect()]
    assert got == [(1, "bare_secret_key"), (3, "cloud_key_id"), (3, "published_example"), (4, "published_example"), (5, "chat_token")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\xff")
    (tmp_path / "b.txt").write_bytes(b"x" * 50)
    rows = readers.read_files(spark, str(tmp_path), max_bytes=10).collect()
    assert [r["text"] for r in rows] == ["ab�"]
    df = spark.createDataFrame([("t", None), (None, "dA=="), ("t", "dA=="), (None, "%"), ("long" * 3, None)], "t string, b string")
    value, error = readers.content(F.col("t"), F.col("b"), 10)
    got = df.select(value.alias("v"), error.alias("e")).collect()
    assert [r["v"] for r in got] == ["t", "t", None, None, None] and got[4]["e"] == "too_large"


def test_stream(spark, tmp_path):
    from veilframe.streaming import events as ev

    e = lambda i, ch: json.dumps({"event_id": i, "tenant_id": "t", "occurred_at": "2026-01-01T00:00:00Z", "channel": ch, "actor": {"id": "u"}, "destination": {}})
    ok = "01ARZ3NDEKTSV4RRFFQ69G5FAV"
    (tmp_path / "x.txt").write_text("\n".join([e(ok, "web"), e(ok, "web"), e("no", "web"), "{", e(ok[:-1] + "W", "mail")]))
    raw = spark.readStream.format("text").load(str(tmp_path))
    q = ev.verdict_stream(raw, bundle(pol("a", 1, rule("r", "block"), channels=["web"])), now=NOW).select("event_id", "verdict.action").writeStream.format("memory").queryName("verdicts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["action"] for r in spark.table("verdicts").collect()) == ["allow", "block"]


def test_sql_functions(spark):
    from veilframe.functions.sql import register

    register(spark)
    assert spark.sql("SELECT luhn_ok('79927398713') a, mask_partial('abcdefgh') b, mask_secret('abcdefgh') c").first() == (True, "ab****gh", "ab…[8 chars]")


# --------------------------------------------------------------- plans and packs


def test_self_test_of_the_builtin_pack(spark):
    rows = ins.self_test(spark).collect()
    assert len(rows) >= 60 and all(r["ok"] for r in rows), [r for r in rows if not r["ok"]]


def test_plans_stay_small(spark):
    """No filter is pushed below the scan, and nothing is computed twice."""
    import time

    docs = spark.createDataFrame([(1, "card 4526 0181 5908 3012")], "doc_id long, text string")
    begun = time.perf_counter()
    plan = ins.long_hits(docs, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000 and time.perf_counter() - begun < 20
    assert plan.count("told(text") == 1 and "ArrowEvalPython" in plan or plan.count("told(") <= 2
    one = ins.detected(docs, "credit_card").filter("size(found) > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert len(one) < 40_000


def test_patterns_are_linear():
    import re
    import time

    texts = ["1 " * 50_000, "a" * 100_000, "a." * 50_000, "a@" * 50_000, "A1 " * 40_000, "eyJ" * 40_000, "mysql://a:" * 20_000, "9" * 100_000, "a-" * 50_000 + "@", "@" + "a." * 50_000, "AE12 3456 " * 10_000]
    for d in packs.BUILTIN.detectors:
        for t in texts:
            begun = time.perf_counter()
            for _ in re.compile(d.pattern).finditer(t):
                pass
            assert time.perf_counter() - begun < 2, (d.id, t[:10])


def test_packs_that_are_refused():
    good = {"id": "x", "name": "x", "category": "x", "pattern": "x"}
    for change in ({"pattern": "(?=x)x"}, {"pattern": "(x"}, {"pattern": "x{1000}{1000}"}, {"test_values": ["sha256:nothex"]}, {"engine": "re"}, {"hint": "x"}):
        with pytest.raises(packs.PackError):
            packs.load_pack({"pack": "p", "version": "1", "detectors": [good | change]})


def test_hostile_pattern_is_linear(spark):
    import time

    p = packs.load_pack({"pack": "p", "version": "1", "detectors": [{"id": "x", "name": "x", "category": "x", "pattern": "(a+)+b"}]})
    begun = time.perf_counter()
    assert not ins.scan(list(p.detectors), ins.Budget())(__import__("pyarrow").array(["a" * 100_000]))[0].as_py()["spans"]
    assert time.perf_counter() - begun < 2


def test_values_are_found_in_other_writings(spark):
    """Full-width digits, zero-width characters, decomposed letters."""
    texts = ["\uff14\uff15\uff12\uff16\uff10\uff11\uff18\uff11\uff15\uff19\uff10\uff18\uff13\uff10\uff11\uff12", "4526\u200b0181\u200b5908\u200b3012", "u\u0308 4526 0181 5908 3012"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["inspection"] for r in ins.inspect(df).collect()]
    assert [g["hits"][0]["samples"][0]["start"] for g in got] == [0, 0, 3] and all(g["hits"][0]["count"] == 1 for g in got)


def test_stream_upsert_replaces_a_batch_that_runs_again(spark, tmp_path):
    from veilframe.streaming import events as streams

    rows = [("t", "k", "e1", "2024-01-01 00:00:00"), ("t", "k", "e2", "2024-01-01 00:05:00"), ("t", "q", "e3", "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "tenant_id string, dedup_key string, event_id string, at string").selectExpr("tenant_id", "dedup_key", "event_id", "cast(at as timestamp) as occurred_at")
    df.write.parquet(f"{tmp_path}/in")
    for state in ("a", "b"):  # the second run knows nothing of the first one: batch 0 again
        src = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        streams.upsert_incidents(src, f"{tmp_path}/out", f"{tmp_path}/{state}").awaitTermination()
    got = streams.current_incidents(spark, f"{tmp_path}/out")
    assert sorted((r["dedup_key"], r["occurrences"]) for r in got.collect()) == [("k", 2), ("q", 1)]


def test_catalogue_has_sql_for_all_but_one():
    from veilframe.plans import catalogue

    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"det_all_long", "pol_explain_trace"}


def test_entry_can_be_imported_without_a_session():
    import subprocess
    import sys

    told = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", told], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from veilframe.plans import catalogue

    assert out.returncode == 0 and int(out.stdout) >= len(catalogue.QUERIES), out.stderr[-500:]
