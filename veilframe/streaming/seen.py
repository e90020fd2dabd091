"""Each event once, however late its repeat: ids that were seen, behind Bloom filters.

A watermark forgets ids; an idempotency key must hold beyond it.  So the ids of each
batch are written to a table dealt by buckets of their hash, and beside it the words of
a Bloom filter for each bucket.  A new batch asks the filters first, by an equi-join on
(bucket, word): what they don't know is new, which is nearly all of a batch that has few
repeats; only the others meet the table of ids, exactly, and only in their buckets.

Every part is written under its batch's number, and a batch looks only at the others, so
one that runs again after a failure replaces what it wrote and gives the same result.
forget() drops the ids of batches that are older than a contract asks for, and merge_words()
makes one part of the filters' words, so neither grows without end.

Null tenants or ids are no events and are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, WORDS, PROBES = 256, 1 << 16, 4
KEY = ("tenant_id", "event_id")
_IDS = "tenant_id string, event_id string, bucket int, batch long"
_WORD = "bucket int, word int, bits long, batch long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(1), *KEY), F.lit(BUCKETS)).cast("int"))


def _probes(rows: DataFrame) -> DataFrame:
    """The word of the filter that an id stands in, and its bits there: all in one word, so that an id is one row."""
    word = F.pmod(F.xxhash64(F.lit(2), *KEY), F.lit(WORDS)).cast("int")
    bits = [F.expr(f"shiftleft(1L, cast(pmod(xxhash64({3 + k}, {', '.join(KEY)}), 64) as int))") for k in range(PROBES)]
    return rows.select(*KEY, "bucket", word.alias("word"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("mask"))


def _words(ids: DataFrame) -> DataFrame:
    return _probes(ids).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))


def known(rows: DataFrame, path: str, number: int) -> DataFrame:
    """The ids (tenant_id, event_id, bucket) of ``rows`` that other batches have written."""
    spark = rows.sparkSession
    words = _table(spark, f"{path}/words", _WORD).filter(F.col("batch") != number).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    maybe = _probes(rows).join(words, ["bucket", "word"]).filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select(*KEY, "bucket")
    ids = _table(spark, f"{path}/ids", _IDS).filter(F.col("batch") != number).select(*KEY, "bucket")
    return maybe.join(ids, [*KEY, "bucket"], "left_semi")


def only_new(batch: DataFrame, path: str, number: int) -> DataFrame:
    """The rows of a batch whose id no other batch has had, one for each id; their ids are remembered."""
    rows = _bucketed(batch.dropna(subset=list(KEY)).dropDuplicates(list(KEY))).persist()
    fresh = rows.join(known(rows.select(*KEY, "bucket"), path, number), [*KEY, "bucket"], "left_anti").persist()
    fresh.select(*KEY, "bucket").repartition("bucket").sortWithinPartitions("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/ids/batch={number}")
    _words(fresh.select(*KEY, "bucket")).write.mode("overwrite").parquet(f"{path}/words/batch={number}")
    rows.unpersist()
    return fresh.drop("bucket")


def each_once(events: DataFrame, path: str, out: str, checkpoint: str):
    """A running query that appends each event of a stream to ``out`` once (a folder for each batch), and ends with what is there now."""

    def take(batch: DataFrame, number: int) -> None:
        fresh = only_new(batch, path, number)
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.unpersist()

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_words(spark: SparkSession, path: str, upto: int) -> None:
    """The filters of all batches before ``upto`` as one part; to be run while no batch runs."""
    words = _table(spark, f"{path}/words", _WORD).filter(F.col("batch") < upto)
    numbers = [r["batch"] for r in words.select("batch").distinct().collect()]
    if len(numbers) < 2:
        return
    one = words.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    one.coalesce(1).write.mode("overwrite").parquet(f"{path}/merging")
    spark.read.parquet(f"{path}/merging").coalesce(1).write.mode("overwrite").parquet(f"{path}/words/batch={min(numbers)}")
    _remove(spark, *[f"{path}/words/batch={n}" for n in numbers if n != min(numbers)], f"{path}/merging")


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Drops the ids of batches before ``before``; words that stay behind only cost a look at the table."""
    numbers = [r["batch"] for r in _table(spark, f"{path}/ids", _IDS).select("batch").distinct().collect()]
    _remove(spark, *[f"{path}/ids/batch={n}" for n in numbers if n < before])


def _remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
