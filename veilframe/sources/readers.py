"""Readers and sinks: whole files, content fields, relational tables, JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FILE = 50 << 20
MAX_CONTENT = 5 << 20


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """(path, text, bytes) of each file of at most ``max_bytes``; invalid UTF-8 is replaced.  The size filter reaches the scan."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") <= max_bytes)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("bytes"))


def content(text: Column, base64: Column, max_bytes: int = MAX_CONTENT) -> tuple[Column, Column]:
    """(text, error): exactly one of a text and a base64 field, at most ``max_bytes`` long."""
    raw = F.try_to_binary(base64, F.lit("base64"))
    value = F.coalesce(text, F.make_valid_utf8(raw.cast("string")))
    error = (
        F.when(text.isNotNull() == base64.isNotNull(), F.lit("invalid_input: give text or base64"))
        .when(base64.isNotNull() & raw.isNull(), F.lit("invalid_input: not base64"))
        .when(F.octet_length(F.coalesce(text.cast("binary"), raw)) > max_bytes, F.lit("too_large"))
    )
    return F.when(error.isNull(), value), error


def strict_json(raw: Column, schema: T.StructType) -> tuple[Column, Column]:
    """(struct, error) of a JSON object: malformed text, trailing data and unknown fields are errors."""
    value = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(raw)
    odd = F.array_except(keys, F.array(*[F.lit(f.name) for f in schema.fields]))
    # Parsers stop behind the first value; inside an array whatever follows it is an error, or a second element.
    alone = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    whole = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull() & F.rtrim(raw).endswith("}")
    error = F.when(F.try_parse_json(raw).isNull() | keys.isNull() | ~whole, F.lit("invalid_input: no JSON object")).when(F.size(odd) > 0, F.concat(F.lit("invalid_input: unknown field "), F.get(odd, F.lit(0))))
    return F.when(error.isNull(), value), error


def read_table(spark: SparkSession, source: str, name: str, **jdbc: str) -> DataFrame:
    """A store table: Parquet under a folder, or JDBC where a url is given."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=f"dlp.{name}", **jdbc).load()
    return spark.read.parquet(f"{source.rstrip('/')}/{name}.parquet")


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
