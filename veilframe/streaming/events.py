"""Event envelopes as a stream: parse, drop repeats, inspect, evaluate, merge incidents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.names import free_prefix
from ..operators.policy import evaluate, held
from ..plans.bundles import Bundle

#: Closed part of the envelope; actor and destination are open and stay VARIANT.
ENVELOPE = {
    "event_id": "string",
    "schema_version": "string",
    "tenant_id": "string",
    "source": "struct<type:string,id:string,version:string>",
    "occurred_at": "timestamp",
    "channel": "string",
    "actor": "variant",
    "destination": "variant",
    "object": "struct<name:string,sha256:string,size:bigint,type:string,labels:array<string>>",
    "inspection": "struct<hits:array<struct<detector:string,count_by_confidence:struct<low:bigint,medium:bigint,high:bigint>,samples:array<struct<masked:string>>>>>",
    "verdict": "struct<action:string,bundle_version:string,user_justification:string>",
    "evidence_ref": "string",
}
#: An event id is a 26-character ULID.
ULID = "^[0-9A-HJKMNP-TV-Z]{26}$"


def parse_envelopes(raw: DataFrame, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Envelope columns, the columns ``keep`` and error (null if the envelope is well formed)."""
    text = F.col(value_col).cast("string")
    e = F.from_json(text, ", ".join(f"{name} {kind}" for name, kind in ENVELOPE.items()))
    odd = F.array_except(F.json_object_keys(text), F.array(*map(F.lit, ENVELOPE)))
    bad = F.when(F.try_parse_json(text).isNull(), F.lit("no JSON")).when(F.size(odd) > 0, F.concat(F.lit("unknown field "), F.get(odd, F.lit(0))))
    p = free_prefix(raw)
    told = lambda name: F.col(f"{p}e.{name}")
    error = (
        F.when(F.col(f"{p}bad").isNotNull(), F.col(f"{p}bad"))
        .when(~F.coalesce(told("event_id").rlike(ULID), F.lit(False)), F.lit("event_id is no ULID"))
        .when(told("tenant_id").isNull() | told("occurred_at").isNull(), F.lit("tenant_id and occurred_at are needed"))
    )
    # Held: each text is parsed once, and not again for every field that a filter on the error asks for.
    rows = raw.select(held(e).alias(f"{p}e"), held(bad).alias(f"{p}bad"), *keep)
    return rows.select(f"{p}e.*", *keep, error.alias("error"))


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (tenant, event id) once; state older than ``late`` is let go."""
    return events.withWatermark("occurred_at", late).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def facts_of(events: DataFrame) -> Column:
    """The envelope's facts as one VARIANT."""
    user = F.to_json(F.struct(F.col("actor").alias("user"), F.col("destination"), F.col("channel"), F.col("inspection"), F.struct(F.col("object.name").alias("name"), F.col("object.size").alias("size"), F.col("object.type").alias("type")).alias("file")))
    return F.parse_json(user)


def verdict_stream(raw: DataFrame, bundle: Bundle, *, now: datetime | Column, late: str = "1 hour") -> DataFrame:
    """Raw JSON lines to verdicts: the only state is that of the repeats."""
    good = parse_envelopes(raw).filter("error IS NULL").filter(F.col("tenant_id") == bundle.tenant_id).drop("error", "verdict")
    return evaluate(distinct_events(good, late).withColumn("facts", facts_of(good)), bundle, now=now)


def incident_counts(events: DataFrame, *, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Occurrences by (tenant, dedup_key) in session windows."""
    return events.withWatermark("occurred_at", late).groupBy("tenant_id", "dedup_key", F.session_window("occurred_at", window).alias("w")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id", "dedup_key").agg(F.sum("occurrences").alias("occurrences"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def upsert_incidents(events: DataFrame, path: str, checkpoint: str):
    """A running query that merges events (tenant_id, dedup_key, occurred_at) into one incident per tenant and key.

    Each micro-batch is merged in itself and written under its own batch number, so a batch
    that runs again after a failure replaces what it wrote; the parts merge when they are read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        one = batch.select("tenant_id", "dedup_key", F.lit(1).cast("long").alias("occurrences"), F.col("occurred_at").alias("first_seen_at"), F.col("occurred_at").alias("last_seen_at"))
        _merged(one).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_incidents(spark: SparkSession, path: str) -> DataFrame:
    """The incidents that upsert_incidents() has merged so far."""
    return _merged(spark.read.parquet(path))


def compact_incidents(spark: SparkSession, path: str, to: str) -> None:
    """The merged incidents as one new part, for folders of many batches."""
    current_incidents(spark, path).write.mode("overwrite").parquet(f"{to}/batch=-1")


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
