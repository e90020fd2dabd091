"""Queries of the catalogue for verdicts in words, sources, the tenant store, joins of catalog tables, SQL functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sql as names
from ..functions import text
from ..operators import policy, store
from ..sources import readers
from ..sources.scratch import scratch
from ..streaming import events as streams
from . import queries
from .queries import BUNDLE, NOW, facts, query, read, spread


# -------------------------------------------------------------- verdicts in words


@query(f"""WITH {queries._POLICY}, n AS (SELECT *, CASE WHEN decided IS NULL THEN 'AUDIT: no enforcing rule matched; this is the bundle''s default.' ELSE upper(action) || ': decided by ' || CASE decided WHEN 'p2/r1' THEN 'Clicks abroad, rule r1, priority 60' WHEN 'p1/r1' THEN 'Restricted data, rule r1, priority 50' WHEN 'p1/r2' THEN 'Restricted data, rule r2, priority 50' ELSE 'Partners, rule x1, priority 55' END || '.' END AS head,
CASE WHEN x1 AND (a1 OR a2) THEN 'An exception set aside ' || concat_ws(', ', CASE WHEN a1 THEN 'Restricted data/r1' END, CASE WHEN a2 THEN 'Restricted data/r2' END) || '.' END AS carved,
b1::INT + a1s::INT + a2s::INT - (b1 OR a1s OR a2s)::INT AS others FROM v)
SELECT event_id, concat_ws(' ', head, carved, CASE WHEN others > 0 THEN others || ' other rule(s) matched and ask for no more.' END, CASE WHEN m1 THEN '1 rule(s) in monitor mode matched too.' END) AS explanation, (label = 'other')::INT AS n_diagnostics FROM n""")
def pol_explanation(spark, d):
    v = policy.evaluate(facts(spark, d), BUNDLE, now=NOW)
    return v.select("event_id", "verdict.explanation", F.size("verdict.diagnostics").alias("n_diagnostics"))


@query(f"""WITH {queries._POLICY}, r(policy, rule, field, op) AS (VALUES ('p1', 'r1', 'classification', 'gte'), ('p1', 'r2', 'volume.k', 'gte'), ('p2', 'r1', 'destination.external', 'eq'), ('p3', 'x1', 'destination.domain', 'in'), ('p4', 'm1', 'channel', 'eq'), ('p5', NULL, NULL, NULL), ('p6', NULL, NULL, NULL)),
t AS (SELECT event_id, r.*, CASE policy WHEN 'p2' THEN CASE WHEN event_type NOT IN ('click', 'error') THEN 'channel not covered: ' || event_type END
WHEN 'p3' THEN CASE WHEN has_user AND user_id = 4 THEN 'user is excluded' WHEN NOT (has_user AND user_id % 5 IN (1, 4)) THEN 'user is not in scope' END WHEN 'p5' THEN 'not active yet' WHEN 'p6' THEN 'disabled' END AS skipped,
CASE policy || coalesce(rule, '') WHEN 'p1r1' THEN coalesce({queries._RANK}, 0) = 4 WHEN 'p1r2' THEN k >= 90 WHEN 'p2r1' THEN user_id % 3 = 0 WHEN 'p3x1' THEN k % 10 IN (1, 2) WHEN 'p4m1' THEN event_type = 'purchase' END AS result FROM m, r)
SELECT event_id, policy, skipped, CASE WHEN skipped IS NULL THEN rule END AS rule, CASE WHEN skipped IS NULL THEN field END AS field, CASE WHEN skipped IS NULL THEN op END AS op, CASE WHEN skipped IS NULL THEN result END AS result FROM t WHERE skipped IS NULL OR coalesce(rule, 'r1') <> 'r2'""")
def pol_trace(spark, d):
    """The full trace, a row per leaf; skipped policies tell why."""
    v = policy.evaluate(facts(spark, d, spread), BUNDLE, now=NOW, trace=True)
    p = v.select("event_id", F.explode("verdict.trace").alias("p"))
    r = p.select("event_id", "p.policy", F.col("p.skipped_reason").alias("skipped"), F.explode_outer("p.rules").alias("r"))
    c = r.select("event_id", "policy", "skipped", F.col("r.rule").alias("rule"), F.explode_outer("r.conditions").alias("c"))
    return c.select("event_id", "policy", "skipped", "rule", "c.field", "c.op", "c.result")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'allowed' ELSE 'tenant_mismatch' END AS outcome FROM orders")
def pol_tenant_match(spark, d):
    """A bundle judges only rows of its own tenant."""
    o = read(spark, d, "orders").withColumn("tenant_id", F.concat(F.lit("t-"), (F.col("o_custkey") % 3 + 1).cast("string")))
    own = policy.own_tenant(o, BUNDLE).select("o_orderkey", F.lit("allowed").alias("outcome"))
    return o.select("o_orderkey").join(own, "o_orderkey", "left").select("o_orderkey", F.coalesce("outcome", F.lit("tenant_mismatch")).alias("outcome"))


# ------------------------------------------------------------------------ sources

_BODY = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


@query("SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'invalid_input: unknown field extra' WHEN 2 THEN 'invalid_input: no JSON object' WHEN 3 THEN 'invalid_input: no JSON object' WHEN 4 THEN 'invalid_input: no JSON object' END AS error, CASE WHEN event_id % 5 = 0 THEN event_type END AS kind FROM events")
def src_strict_json(spark, d):
    """Good bodies, unknown fields, trailing data, cut bodies and arrays."""
    e = read(spark, d, "events")
    good = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value"))
    k = F.col("event_id") % 5
    raw = F.when(k == 0, good).when(k == 1, F.concat(F.lit('{"extra":1,'), F.substr(good, F.lit(2)))).when(k == 2, F.concat(good, F.lit("}"))).when(k == 3, F.left(good, F.lit(9))).otherwise(F.concat(F.lit("["), good, F.lit("]")))
    value, error = readers.strict_json(F.col("raw"), _BODY)
    return e.select("event_id", raw.alias("raw")).select("event_id", error.alias("error"), value["kind"].alias("kind"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN 'invalid_input: give text or base64' WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN 'invalid_input: not base64' ELSE 'too_large' END END AS error, CASE WHEN c_custkey % 4 < 2 THEN c_name END AS text FROM customer")
def src_content(spark, d):
    """A text, the same as base64, both, no base64, too long."""
    c, k = read(spark, d, "customer"), F.col("c_custkey") % 4
    name = F.col("c_name")
    plain = F.when((k == 0) | (k == 2), name)
    coded = F.when((k == 1) | (k == 2), F.base64(F.encode(name, "utf-8"))).when(k == 3, F.when(F.col("c_custkey") % 8 == 3, F.lit("*!*")).otherwise(F.base64(F.encode(F.repeat(name, F.lit(10)), "utf-8"))))
    value, error = readers.content(plain, coded, max_bytes=100)
    return c.select("c_custkey", error.alias("error"), value.alias("text"))


@query("SELECT c_nationkey, strlen(t) AS bytes, md5(t) AS digest FROM (SELECT c_nationkey, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS t FROM customer GROUP BY c_nationkey)")
def src_files(spark, d):
    """Customers as one text file for each nation, each file read back whole; the size limit is one of the scan."""
    at = scratch(spark, "files")
    rows = read(spark, d, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select(F.col("c_name").alias("value"), "c_nationkey").write.partitionBy("c_nationkey").text(at)
    files = readers.read_files(spark, f"{at}/*/*")
    key = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int")
    return files.select(key.alias("c_nationkey"), F.col("bytes"), F.md5("text").alias("digest"))


# -------------------------------------------------------------------------- store


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey % 5 = 2 AND c_nationkey <> 7")
def tenant_write_check(spark, d):
    """Rows that a write by tenant 7 must not hold."""
    batch = read(spark, d, "customer").filter("c_nationkey % 5 = 2")
    return store.foreign_rows(batch, 7, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, o_custkey AS author_id FROM orders WHERE o_custkey % 7 = o_orderkey % 7 AND o_orderkey % 2 = 0")
def four_eyes(spark, d):
    """Versions that their author approved; some have no approver yet."""
    same = F.col("o_custkey") % 7 == F.col("o_orderkey") % 7
    v = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("author_id"), F.when(F.col("o_orderkey") % 2 == 0, F.when(same, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1)).alias("approved_by"))
    return store.four_eyes_violations(v).select("o_orderkey", "author_id")


@query("SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS n_clicks FROM events WHERE strftime(ts + INTERVAL (event_id % 90) DAY, '%Y_%m') = '2024_02' GROUP BY user_id")
def incident_month_read(spark, d):
    """Incidents written by month; one month's read opens only its folder."""
    at = scratch(spark, "incidents")
    e = read(spark, d, "events").withColumn("created_at", F.expr("ts + make_interval(0, 0, 0, cast(event_id % 90 as int), 0, 0, 0)"))
    store.write_incidents(e, at)
    month = spark.read.parquet(at).filter("month = '2024_02'")
    return month.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("n_clicks"))


@query("SELECT event_type, n_status AS status, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN 500 WHEN event_id % 7 = 0 THEN 404 ELSE 200 END AS n_status FROM events) GROUP BY ALL")
def metrics_requests(spark, d):
    """Requests by route and status."""
    e = read(spark, d, "events").withColumn("status", F.when(F.col("event_id") % 10 == 0, 500).when(F.col("event_id") % 7 == 0, 404).otherwise(200))
    return store.request_counts(e, ["event_type", "status"]).select("event_type", "status", "n")


@query("SELECT 'requests_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_text(spark, d):
    """The counter in the text form that scrapers read."""
    return store.metrics_text(store.request_counts(read(spark, d, "events"), ["event_type"]), "requests_total", ["event_type"])


# ---------------------------------------------------- joins of the catalog tables


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rel_semi_join(spark, d):
    late = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(late, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def rel_scalar_subquery(spark, d):
    o = read(spark, d, "orders")
    return o.filter(F.col("o_totalprice") > o.agg(F.avg("o_totalprice")).scalar()).select("o_orderkey")


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def rel_string_agg(spark, d):
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("nations"), F.count(F.lit(1)).alias("n"))


_TREE = "t AS (SELECT '/r' || r_regionkey AS path, r_name AS name FROM region UNION ALL SELECT '/r' || n_regionkey || '/n' || n_nationkey, n_name FROM nation UNION ALL SELECT '/r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"WITH {_TREE} SELECT a.path, a.name, count(*) AS n_below FROM t a JOIN t b ON b.path = a.path OR starts_with(b.path, a.path || '/') GROUP BY ALL")
def tenant_visible_counts(spark, d):
    """For every tenant of the tree, how many it sees (itself and those below): a path-prefix self join, as an equi-join on ancestors."""
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    top = r.select(F.concat(F.lit("/r"), F.col("r_regionkey").cast("string")).alias("path"), F.col("r_name").alias("name"))
    at = F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"))
    mid = n.select(at.alias("path"), F.col("n_name").alias("name"))
    low = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(at, F.lit("/c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("name"))
    tree = top.union(mid).union(low)
    return tree.join(store.visible_counts(tree), "path").select("path", "name", "n_below")


# ------------------------------------------------------------------ SQL functions


@query("""SELECT o_orderkey, substr(d, 1, 6) || repeat('*', 6) || right(d, 4) AS masked, (o_orderkey % 3 = 0) AS jwt, (substr(b, 5) || '1314' || substr(b, 3, 2))::HUGEINT % 97 = 1 AS iban, length(d) AS n_digits
FROM (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 16, '4') AS d, 'DE' || lpad((o_orderkey % 97)::VARCHAR, 2, '0') || lpad((o_orderkey * 104729)::VARCHAR, 18, '0') AS b FROM orders)""")
def sql_functions(spark, d):
    """The registered functions, in SQL over a view."""
    names.register(spark)
    read(spark, d, "orders").createOrReplaceTempView("veil_orders")
    return spark.sql("""
        WITH x AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS STRING), 16, '4') AS d, concat('DE', lpad(CAST(o_orderkey % 97 AS STRING), 2, '0'), lpad(CAST(o_orderkey * 104729 AS STRING), 18, '0')) AS b,
          concat(rtrim('=', translate(base64(encode(IF(o_orderkey % 3 = 0, '{"alg":"HS256"}', '{"typ":"JWT"}'), 'utf-8')), '+/', '-_')), '.e30.sig') AS t FROM veil_orders)
        SELECT o_orderkey, mask_card(d) AS masked, jwt_ok(t) AS jwt, iban_ok(b) AS iban, length(only_digits(concat('x', d, '-'))) AS n_digits FROM x""")


@query(f"""WITH v AS (SELECT c_custkey AS k, 'DE' || lpad((c_custkey % 97)::VARCHAR, 2, '0') || lpad((c_custkey * 104729)::VARCHAR, 18, '0') AS x, c_custkey % 2 = 0 AS keyed FROM customer)
SELECT k, 'iban' AS detector, CASE WHEN keyed THEN 8 ELSE 3 END AS start, CASE WHEN keyed THEN 30 ELSE 25 END AS "end", keyed AS keyword FROM v WHERE (substr(x, 5) || '1314' || substr(x, 3, 2))::HUGEINT % 97 = 1
UNION ALL SELECT k, 'email_address', CASE WHEN keyed THEN 31 ELSE 26 END, CASE WHEN keyed THEN 31 ELSE 26 END + 16 + length(k::VARCHAR), false FROM v""")
def udtf_inspect_text(spark, d):
    """The table function inspect_text(text) in a lateral join, its values checked by a SQL function."""
    names.register(spark)
    k = F.col("k")
    value = F.concat(F.lit("DE"), F.lpad((k % 97).cast("string"), 2, "0"), F.lpad((k * 104729).cast("string"), 18, "0"))
    t = F.concat(F.when(k % 2 == 0, F.lit("bank ü ")).otherwise(F.lit("ü ")), value, F.lit(" c"), k.cast("string"), F.lit("@ml.example.org"))
    spread(read(spark, d, "customer").select(F.col("c_custkey").alias("k"))).select("k", t.alias("t")).createOrReplaceTempView("veil_contacts")
    return spark.sql("SELECT k, m.detector, m.start, m.end, m.keyword FROM veil_contacts, LATERAL inspect_text(t) AS m WHERE value_ok(m.detector, m.value)")


# ------------------------------------------------------------- normalisation again


@query("SELECT c_custkey, md5(c_name) AS digest, true AS changed FROM customer")
def norm_nfkc_folded(spark, d):
    """Names in full-width characters come back as ASCII."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    plain = "".join(chr(c) for c in range(0x21, 0x7F))
    x = F.translate(F.col("c_name"), plain, wide)
    return read(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", F.md5(text.nfkc(F.col("x"))).alias("digest"), (text.nfkc(F.col("x")) != F.col("x")).alias("changed"))


# ------------------------------------------------------------------------ streams


@query("SELECT 't' || user_id % 3 AS tenant_id, event_type AS dedup_key, count(*) AS occurrences, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY ALL")
def stream_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of files, merged batch by batch into one row per tenant and key; every event comes twice and counts once."""
    at = scratch(spark, "stream")
    e = read(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.col("event_type").alias("dedup_key"), F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("occurred_at"))
    e.union(e).repartition(4).write.parquet(f"{at}/in")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    out = streams.upsert_incidents(streams.distinct_events(src, "60 days"), f"{at}/incidents", f"{at}/state")
    out.awaitTermination()
    now = streams.current_incidents(spark, f"{at}/incidents")
    return now.select("tenant_id", "dedup_key", "occurrences", F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"), F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"))
