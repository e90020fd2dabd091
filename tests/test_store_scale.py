"""Range join on a tree's places, chain faults and appended chains: plans and results against plain Python."""

import random

from pyspark.sql import functions as F

from veilframe.operators import store


def some_tree(r, n):
    paths = ["/t"]
    for k in range(n):
        paths.append(f"{r.choice(paths)}/{r.choice('abc')}{k % 37}-{k}")
    return paths


def test_visible_rows_of_a_tree(spark):
    """400 tenants of any depth, names that are beginnings of others: the pairs are those of the paths; no nested loop."""
    r = random.Random(6)
    paths = [*some_tree(r, 400), "/t2", "/t2/x", "/t-", "/t0"]
    spark_tree = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "path string, number long").repartition(5)
    labels = store.tree_labels(spark_tree)
    held = {x["path"]: (x["low"], x["high"]) for x in labels.collect()}
    assert sorted(low for low, _ in held.values()) == list(range(len(paths)))
    below = lambda p, q: q == p or q.startswith(p + "/")
    assert all(high - low + 1 == sum(below(p, q) for q in paths) for p, (low, high) in held.items())
    rows = [(k, r.choice(paths)) for k in range(900)]
    placed = spark.createDataFrame(rows, "k long, path string").join(labels.select("path", F.col("low").alias("place")), "path").select("k", "place")
    top = max(high for _, high in held.values())
    seen = store.visible_rows(labels.select(F.col("path").alias("viewer"), "low", "high"), placed, top)
    assert sorted(map(tuple, seen.select("viewer", "k").collect())) == sorted((v, k) for k, q in rows for v in paths if below(v, q))
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _rows(spark, n, tenants=3, start=0):
    return spark.range(start, start + n).select((F.col("id") % tenants).alias("tenant_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("a").alias("actor"), F.lit(None).cast("string").alias("source_ip"), F.col("id").cast("string").alias("action"), F.lit("o").alias("object_type"), F.col("id").cast("string").alias("object_id"), F.lit(None).cast("string").alias("old_value"), F.lit("x").alias("new_value"), F.lit("success").alias("result"))


def test_chain_goes_on_from_its_head(spark):
    whole = store.build_audit_chain(_rows(spark, 60))
    first = store.build_audit_chain(_rows(spark, 24))
    second = store.build_audit_chain(_rows(spark, 36, tenants=3, start=24), heads=store.chain_heads(first))
    told = lambda df: sorted((x["tenant_id"], x["seq"], x["hash"]) for x in df.collect())
    assert told(first.union(second)) == told(whole)
    assert store.chain_faults(first.union(second)).count() == 0


def test_chain_faults(spark):
    chain = store.build_audit_chain(_rows(spark, 60)).cache()
    at = lambda tenant, seq: (F.col("tenant_id") == tenant) & (F.col("seq") == seq)
    spoilt = chain.filter(~at(0, 5) & ~at(1, 1)).union(chain.filter(at(2, 9))).withColumn("action", F.when(at(0, 11), "forged").otherwise(F.col("action"))).withColumn("prev_hash", F.when(at(2, 14), F.lit("")).otherwise(F.col("prev_hash")))
    bad = store.chain_faults(spoilt)
    assert sorted(map(tuple, bad.collect())) == [(0, 6, "gap"), (0, 11, "digest"), (1, 2, "gap"), (2, 9, "repeated"), (2, 14, "link")]
    got = {x["tenant_id"]: (x["n_rows"], x["first_bad_seq"]) for x in store.verify_audit_chain(spoilt).collect()}
    assert got == {0: (19, 6), 1: (19, 2), 2: (21, 9)}
    assert "Window" not in store.verify_audit_chain(chain)._jdf.queryExecution().executedPlan().toString()
    chain.unpersist()


def test_chains_stay_whole_whatever_the_adaptive_plan_does(spark):
    """Many rows and few heads: the join that brought the heads was turned into a broadcast while it ran, and read its rows by mapper."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        first = store.build_audit_chain(_rows(spark, 200)).localCheckpoint()
        second = store.build_audit_chain(_rows(spark, 400, start=200).repartition(4), heads=store.chain_heads(first)).localCheckpoint()
        assert second.count() == 400 and store.chain_faults(first.union(second)).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
