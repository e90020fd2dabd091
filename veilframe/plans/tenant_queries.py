"""Queries of the catalogue for many tenants' bundles, keyed incidents and the whole stream."""

from __future__ import annotations

import json
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inspect, store, tenancy
from ..streaming import incidents as keyed
from ..streaming import seen, whole
from . import bundles
from .packs import Detector, Pack, luhn_number
from .queries import _FACTS, LABELS, NOW, facts, query, read, spread
from .store_queries import scratch


def tenant_bundle(k: int) -> dict:
    """Tenant k's own rules: another threshold, group, exception priority and default for each."""
    return {
        "schema_version": "1.0",
        "tenant_id": f"t-{k}",
        "bundle_version": f"v{k}",
        "classifications": LABELS,
        "default_action": "allow" if k % 2 else "audit",
        "policies": [
            {"id": "size", "name": "Size", "priority": 50, "rules": [{"id": "r", "when": {"any": [{"field": "volume.k", "op": "gte", "value": 10 * k}, {"all": [{"field": "classification", "op": "gte", "value": "Restricted"}, {"not": {"field": "destination.external", "op": "eq", "value": True}}]}]}, "then": [{"action": "block"}, {"action": "create_incident", "tenant": k}]}]},
            {"id": "clicks", "name": "Clicks", "priority": 10, "channels": ["click"], "rules": [{"id": "r", "when": {"field": "channel", "op": "exists"}, "then": [{"action": "warn"}, {"action": "notify_user"}]}]},
            {"id": "team", "name": "Team", "priority": 40 if k % 2 else 60, "scope": {"groups": [f"G{k % 5}"]}, "rules": [{"id": "x", "exception": True, "when": {"field": "user.id", "op": "ne", "value": f"u{k}"}, "then": [{"action": "allow"}]}]},
        ],
    }


@query("""WITH f AS (SELECT event_id, event_type, user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 7 <> 0 AS has_user, user_id % 10 AS t FROM events),
m AS (SELECT *, (coalesce(k >= 10 * t, false) OR (coalesce(k % 5 = 3, false) AND user_id % 3 <> 0)) AS a, event_type = 'click' AS c, has_user AND user_id % 5 = t % 5 AND user_id <> t AS x FROM f),
w AS (SELECT *, a AND NOT (x AND t % 2 = 0) AS s, c AND NOT x AS cs FROM m)
SELECT event_id, CASE WHEN t < 9 THEN 't-' || t || '/v' || t END AS bundle, CASE WHEN t = 9 THEN NULL WHEN s THEN 'block' WHEN cs THEN 'warn' WHEN x THEN 'allow' WHEN t % 2 = 1 THEN 'allow' ELSE 'audit' END AS action,
CASE WHEN t = 9 THEN NULL WHEN s THEN 'size' WHEN cs THEN 'clicks' WHEN x THEN 'team' END AS decided, CASE WHEN t < 9 THEN concat_ws(',', CASE WHEN s THEN 'create_incident' END, CASE WHEN cs THEN 'notify_user' END) END AS effects FROM w""")
def pol_many_tenants(spark: SparkSession, d: str) -> DataFrame:
    """Ten tenants, one plan: nine with a bundle of their own, one whose bundle can't be used."""
    docs = [(f"t-{k}", json.dumps(tenant_bundle(k))) for k in range(9)] + [("t-9", "{}")]
    compiled = tenancy.compile_bundles(spark.createDataFrame(docs, "tenant_id string, bundle string"))
    rows = facts(spark, d).withColumn("tenant_id", F.concat(F.lit("t-"), (F.col("user_id") % 10).cast("string")))
    v = tenancy.evaluate_tenants(rows, compiled, now=NOW)
    told = F.when(F.col("verdict").isNotNull(), F.concat_ws("/", "tenant_id", "verdict.bundle_version"))
    return v.select("event_id", told.alias("bundle"), "verdict.action", F.col("verdict.decided_by.policy").alias("decided"), F.array_join(F.transform("verdict.side_effects", lambda e: e["action"]), ",").alias("effects"))


@query("SELECT 't-' || k AS tenant_id, CASE WHEN k = 9 THEN 'schema version None is not 1.x' END AS error, CASE WHEN k < 9 THEN 3 END AS n_rules, n_customers FROM range(0, 10) AS r(k), LATERAL (SELECT count(*) AS n_customers FROM customer WHERE c_custkey % 10 = k)")
def pol_compiled_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Bundles as rows: what could be compiled, and the customers of each tenant."""
    docs = [(f"t-{k}", json.dumps(tenant_bundle(k))) for k in range(9)] + [("t-9", "{}")]
    compiled = tenancy.compile_bundles(spark.createDataFrame(docs, "tenant_id string, bundle string"))
    n = read(spark, d, "customer").groupBy(F.concat(F.lit("t-"), (F.col("c_custkey") % 10).cast("string")).alias("tenant_id")).agg(F.count(F.lit(1)).alias("n_customers"))
    return compiled.select("tenant_id", "error", F.size("rules").alias("n_rules")).join(n, "tenant_id").withColumn("n_rules", F.when(F.col("error").isNull(), F.col("n_rules")))


# --------------------------------------------------------------------------- store


@query("""WITH t AS (SELECT '/all' AS path UNION ALL SELECT '/all/r' || r_regionkey FROM region UNION ALL SELECT '/all/r' || n_regionkey || '/n' || n_nationkey FROM nation),
c AS (SELECT c_custkey, '/all/r' || n_regionkey || '/n' || n_nationkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT t.path AS viewer, c_custkey FROM t JOIN c ON c.path = t.path OR starts_with(c.path, t.path || '/')""")
def tenant_visible_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with every tenant of a tree of three levels that sees it: a join on blocks of pre-order places."""
    r = F.concat(F.lit("/all/r"), F.col("r_regionkey").cast("string"))
    n = F.concat(F.lit("/all/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    nations = read(spark, d, "nation")
    tree = spark.range(1).select(F.lit("/all").alias("path")).union(read(spark, d, "region").select(r)).union(nations.select(n))
    labels = store.tree_labels(tree)
    places = labels.select("path", F.col("low").alias("place")).join(nations.select(n.alias("path"), "n_nationkey"), "path")
    rows = read(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "place")
    top = labels.agg(F.max("high")).first()[0]
    return store.visible_rows(labels.select(F.col("path").alias("viewer"), "low", "high"), rows, top)


@query("SELECT user_id, count(*) AS n_rows, CASE WHEN count(*) < 3 OR user_id % 5 = 0 THEN NULL ELSE 3 END AS seq, CASE WHEN count(*) < 3 OR user_id % 5 = 0 THEN NULL ELSE ['', 'digest', 'link', CASE WHEN count(*) > 3 THEN 'gap' END, 'repeated'][(user_id % 5 + 1)::INT] END AS fault FROM events GROUP BY user_id")
def audit_chain_faults(spark: SparkSession, d: str) -> DataFrame:
    """Chains over the events of each user, the second half appended to the stored heads; each fault is made in a fifth of them, and found first."""
    e = read(spark, d, "events").select("user_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.lit(None).cast("string").alias("source_ip"), F.col("event_type").alias("action"), F.lit("event").alias("object_type"), F.col("event_id").cast("string").alias("object_id"), F.lit(None).cast("string").alias("old_value"), F.col("props").alias("new_value"), F.lit("success").alias("result"))
    at = scratch(spark, "chain")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    store.build_audit_chain(e.filter(early), tenant_col="user_id", order_cols=("object_id",)).write.parquet(f"{at}/a")
    first = spark.read.parquet(f"{at}/a")
    store.build_audit_chain(e.filter(~early), tenant_col="user_id", order_cols=("object_id",), heads=store.chain_heads(first, "user_id")).write.parquet(f"{at}/b")
    chain = first.union(spark.read.parquet(f"{at}/b"))
    third, kind = F.col("seq") == 3, F.col("user_id") % 5
    spoilt = chain.withColumns({"action": F.when(third & (kind == 1), "forged").otherwise(F.col("action")), "prev_hash": F.when(third & (kind == 2), F.lit(store.GENESIS)).otherwise(F.col("prev_hash"))})
    spoilt = spoilt.filter(~(third & (kind == 3)) | third.isNull())
    spoilt = spoilt.withColumn("copies", F.explode(F.sequence(F.lit(1), F.when(third & (kind == 4), 2).otherwise(1)))).drop("copies")
    bad = store.chain_faults(spoilt, "user_id").groupBy("user_id").agg(F.min_by("fault", "seq").alias("fault"), F.min("seq").alias("seq"))
    n = chain.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    gap = F.when((F.col("user_id") % 5 == 3) & F.col("seq").isNotNull(), F.col("seq") - 1).otherwise(F.col("seq"))  # the row behind the one that is missing
    out = n.join(bad, "user_id", "left").withColumn("seq", gap)
    return out.withColumn("seq", F.when((F.col("user_id") % 5 == 3) & (F.col("n_rows") == 3), 3).otherwise(F.col("seq")).cast("int"))


_LE = ", ".join(f"'observed_seconds_bucket{{le=\"{b}\"}} ' || count(*) FILTER (s <= {b})" for b in store.LATENCY_BOUNDS)


@query(f"""WITH e AS (SELECT event_type, value / 10 AS s FROM events), t AS (SELECT unnest(['click', 'error', 'purchase', 'view', 'none']) AS x)
SELECT unnest(['# TYPE observed_seconds histogram', '# TYPE observed_total counter', {_LE}, 'observed_seconds_bucket{{le="+Inf"}} ' || count(s), 'observed_seconds_count ' || count(s)]) AS line FROM e
UNION ALL SELECT 'observed_total{{status="' || x || '"}} ' || (SELECT count(*) FROM e WHERE event_type = x) FROM t""")
def metrics_observed(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a run, gathered while it wrote its result: counter and histogram in text form (the sum left out, as it is no whole number)."""
    e = read(spark, d, "events").withColumn("s", F.col("value") / 10)
    seen, figures = store.observed(e, "requests", "s", F.col("event_type"), ("click", "error", "purchase", "view", "none"))
    seen.write.parquet(scratch(spark, "observed"))
    lines = [x for x in store.metrics_lines(figures.get, "observed") if "_sum" not in x]
    return spark.createDataFrame([(x,) for x in lines], "line string")


def _many_detectors() -> list[Pack]:
    return [Pack(f"names{j}", "1", tuple(Detector(id=f"n{k}", name=f"N{k}", category="x", pattern=rf"\bCustomer#{k:09d}\b", base_confidence="high") for k in range(100 * j, 100 * j + 100))) for j in range(3)]


@query("""WITH x AS (SELECT c_custkey, c_custkey AS k FROM customer UNION SELECT c_custkey, c_custkey * 7 % 400 FROM customer)
SELECT 'n' || k AS detector, count(*) AS n_texts FROM x WHERE k BETWEEN 0 AND 299 GROUP BY k""")
def insp_many_detectors(spark: SparkSession, d: str) -> DataFrame:
    """300 detectors of three packs over texts made from every customer, by one automaton of their required texts."""
    name = lambda k: F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0"))
    text = F.concat(name(F.col("c_custkey")), F.lit(" met "), name(F.col("c_custkey") * 7 % 400), F.lit(", twice "), name(F.col("c_custkey")))
    rows = spread(read(spark, d, "customer").select("c_custkey")).select("c_custkey", text.alias("text"))
    return inspect.long_hits(rows, "c_custkey", packs=_many_detectors()).groupBy("detector").agg(F.count(F.lit(1)).alias("n_texts"))


# ------------------------------------------------------------------------ streams

#: A later event of its own key, which lets the watermark pass all others.
_TICK = "2100-01-01 00:00:00"


@query("""WITH e AS (SELECT DISTINCT 't' || user_id % 3 AS tenant_id, event_type AS dedup_key, event_id, ts FROM events),
p AS (SELECT *, lag(ts) OVER (PARTITION BY tenant_id, dedup_key ORDER BY ts) AS last FROM e),
n AS (SELECT *, sum(CASE WHEN last IS NULL OR epoch_us(ts) - epoch_us(last) > 1200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, dedup_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM p)
SELECT tenant_id, dedup_key, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS occurrences FROM n GROUP BY tenant_id, dedup_key, no""")
def stream_keyed_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Events as files, out of order and each twice, merged by keyed state with timers; stopped and gone on with."""
    at = scratch(spark, "keyed")
    e = read(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("event_type").alias("dedup_key"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("occurred_at"))
    e.union(e).repartition(3).write.parquet(f"{at}/in")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")

    def go() -> None:
        whole.start(keyed.keyed_incidents(src, window=timedelta(minutes=20), late="100 days"), f"{at}/out", f"{at}/state").awaitTermination()

    go()
    tick = spark.range(1).select(F.lit("").alias("tenant_id"), F.lit("").alias("dedup_key"), F.lit("tick").alias("event_id"), F.lit(_TICK).cast("timestamp").alias("occurred_at"))
    tick.write.mode("append").parquet(f"{at}/in")
    go()  # from the checkpoint
    out = spark.read.schema(keyed.INCIDENT).parquet(f"{at}/out")
    return out.select("tenant_id", "dedup_key", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"), "occurrences")


_STREAM = bundles.load_bundle(
    {
        "schema_version": "1.0",
        "tenant_id": "t-1",
        "bundle_version": "s-1",
        "classifications": LABELS,
        "default_action": "allow",
        "policies": [
            {"id": "cards", "name": "Cards", "priority": 5, "rules": [{"id": "r", "when": {"field": "sit.credit_card", "op": "count_gte", "value": 1}, "then": [{"action": "block"}, {"action": "create_incident"}]}]},
            {"id": "errors", "name": "Errors", "priority": 1, "channels": ["error"], "rules": [{"id": "r", "when": {"field": "user.id", "op": "exists"}, "then": [{"action": "warn"}, {"action": "create_incident"}]}]},
        ],
    }
)
_CARD = luhn_number("453201" + "5" * 9)


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes of all events: every tenth text holds a card, every eleventh event is another tenant's, every 50th broken."""
    e, n = read(spark, d, "events"), F.col("event_id")
    body = F.to_json(F.struct(
        F.lpad(n.cast("string"), 26, "0").alias("event_id"), F.lit("1.0").alias("schema_version"), F.when(n % 11 == 0, "t-2").otherwise("t-1").alias("tenant_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"), F.col("event_type").alias("channel"), F.struct(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("id")).alias("actor"),
    ))
    value = F.when(n % 50 == 0, F.lit("{")).when(n % 50 == 1, F.lit('{"odd": 1}')).otherwise(body)
    content = F.when(n % 10 == 3, F.lit(f"pay with card {_CARD} today")).when(n % 10 == 4, F.lit("nothing here"))
    return e.select(value.alias("value"), content.alias("content"))


_GOOD = "g AS (SELECT event_id, event_type, user_id % 20 AS u, ts FROM events WHERE event_id % 50 > 1 AND event_id % 11 <> 0)"


@query(f"""WITH {_GOOD}, i AS (SELECT 'cards/r/u' || u AS dedup_key, ts FROM g WHERE event_id % 10 = 3 UNION ALL SELECT 'errors/r/u' || u, ts FROM g WHERE event_type = 'error' AND event_id % 10 <> 3),
p AS (SELECT *, lag(ts) OVER (PARTITION BY dedup_key ORDER BY ts) AS last FROM i),
n AS (SELECT *, sum(CASE WHEN last IS NULL OR epoch_us(ts) - epoch_us(last) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY dedup_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM p)
SELECT 'incident' AS kind, dedup_key AS name, min(ts) AS first_seen_at, count(*) AS n FROM n GROUP BY dedup_key, no
UNION ALL SELECT 'verdict', CASE WHEN event_id % 10 = 3 THEN 'block' WHEN event_type = 'error' THEN 'warn' ELSE 'allow' END, NULL, count(*) FROM g GROUP BY ALL
UNION ALL SELECT 'rejected', CASE WHEN event_id % 50 = 0 THEN 'no JSON' WHEN event_id % 50 = 1 THEN 'unknown field odd' ELSE 'another tenant''s event' END, NULL, 2 * count(*) FROM events WHERE event_id % 50 <= 1 OR event_id % 11 = 0 GROUP BY ALL""")
def stream_whole(spark: SparkSession, d: str) -> DataFrame:
    """Raw events, each twice, through parsing, inspection, verdicts and incidents; stopped in between and gone on with."""
    at = scratch(spark, "whole")
    raw = _raw(spark, d)
    raw.union(raw).repartition(3).write.parquet(f"{at}/in")
    src = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    late = {"now": NOW, "late": "100 days"}

    def go() -> None:
        running = [
            whole.start(whole.rejected(src, _STREAM), f"{at}/rejected", f"{at}/state-r"),
            whole.start(whole.verdicts(src, _STREAM, **late).select("event_id", "verdict.action"), f"{at}/verdicts", f"{at}/state-v"),
            whole.start(whole.incidents(src, _STREAM, **late), f"{at}/incidents", f"{at}/state-i"),
        ]
        for q in running:
            q.awaitTermination()

    go()
    tick = spark.range(1).select(F.lit(json.dumps({"event_id": "Z" * 26, "tenant_id": "t-1", "occurred_at": _TICK.replace(" ", "T") + "Z", "channel": "tick"})).alias("value"), F.lit(None).cast("string").alias("content"))
    tick.write.mode("append").parquet(f"{at}/in")
    go()
    none = F.lit(None).cast("timestamp_ntz").alias("first_seen_at")
    found = spark.read.schema(keyed.INCIDENT).parquet(f"{at}/incidents").select(F.lit("incident").alias("kind"), F.col("dedup_key").alias("name"), F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), F.col("occurrences").alias("n"))
    judged = spark.read.schema("event_id string, action string").parquet(f"{at}/verdicts").filter(F.col("event_id") != "Z" * 26)
    judged = judged.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit("verdict").alias("kind"), F.col("action").alias("name"), none, "n")
    bad = spark.read.schema("value string, error string").parquet(f"{at}/rejected").groupBy("error").agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("kind"), F.col("error").alias("name"), none, "n")
    return found.unionByName(judged).unionByName(bad)


@query("SELECT 't' || user_id % 3 AS tenant_id, count(*) AS n_events, count(DISTINCT event_type)::BIGINT AS n_kinds FROM events GROUP BY ALL")
def stream_each_once(spark: SparkSession, d: str) -> DataFrame:
    """Events as files, each three times and in any order, without a watermark: ids that were seen are remembered."""
    at = scratch(spark, "once")
    e = read(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("event_id").cast("string").alias("event_id"), "event_type")
    e.union(e).union(e).repartition(3).write.parquet(f"{at}/in")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    seen.each_once(src, f"{at}/seen", f"{at}/out", f"{at}/state").awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("event_type").alias("n_kinds"))
