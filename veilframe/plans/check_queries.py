"""Queries of the catalogue for checks that load data: packs and bundles that are refused, sinks, tables, other countries' accounts, compositions."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, validators
from ..operators import tenancy
from ..sources import readers
from ..sources.scratch import scratch
from . import packs
from .queries import query, read

#: Country, account of a customer k as SQL and Spark, and the country's letters as numbers.
_ACCOUNTS = [
    ("GB", "'WEST' || lpad((k * 104729)::VARCHAR, 14, '0')", lambda k: F.concat(F.lit("WEST"), F.lpad((k * 104729).cast("string"), 14, "0")), "'32142829' || lpad((k * 104729)::VARCHAR, 14, '0')", "1611"),
    ("NO", "lpad((k * 7919)::VARCHAR, 11, '0')", lambda k: F.lpad((k * 7919).cast("string"), 11, "0"), "lpad((k * 7919)::VARCHAR, 11, '0')", "2324"),
    ("FR", "lpad((k * 15485863)::VARCHAR, 23, '0')", lambda k: F.lpad((k * 15485863).cast("string"), 23, "0"), "lpad((k * 15485863)::VARCHAR, 23, '0')", "1527"),
    ("SA", "lpad((k * 31)::VARCHAR, 20, '0')", lambda k: F.lpad((k * 31).cast("string"), 20, "0"), "lpad((k * 31)::VARCHAR, 20, '0')", "2810"),
]
_ROWS = " UNION ALL ".join(f"SELECT k, '{c}' AS country, c, ({plain} || '{code}' || c)::HUGEINT % 97 = 1 AS iban_ok FROM x" for c, _, _, plain, code in _ACCOUNTS)


@query(f"WITH x AS (SELECT c_custkey AS k, lpad((c_custkey % 97)::VARCHAR, 2, '0') AS c FROM customer), r AS ({_ROWS}) SELECT k, country, iban_ok, false AS short_ok FROM r")
def val_iban_countries(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of four countries, with letters, blanks and lower case; one character short they never hold."""
    k = F.col("k")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    made = F.array(*[F.struct(F.lit(name).alias("country"), F.concat(F.lit(name), F.lpad((k % 97).cast("string"), 2, "0"), account(k)).alias("value")) for name, _, account, _, _ in _ACCOUNTS])
    rows = c.select("k", F.explode(made).alias("a")).select("k", "a.country", "a.value")
    spaced = F.lower(F.regexp_replace("value", "(.{4})", "$1 "))
    return rows.select("k", "country", validators.iban(spaced).alias("iban_ok"), validators.iban(F.substr("value", F.lit(1), F.length("value") - 1)).alias("short_ok"))


#: Written and folded: a ligature, an accent of its own, Hangul letters, a circled digit, a raised digit, half-width kana with its mark.
_WRITTEN = "ﬁ é 한 ① x² ｶﾞ"
_FOLDED = "fi é 한 1 x2 ガ"


@query(f"SELECT c_custkey, md5(c_name || ' {_FOLDED}') AS digest, true AS changed FROM customer")
def norm_nfkc_composed(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility characters and compositions behind every customer's name."""
    x = F.concat("c_name", F.lit(f" {_WRITTEN}"))
    return read(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", F.md5(text.nfkc(F.col("x"))).alias("digest"), (text.nfkc(F.col("x")) != F.col("x")).alias("changed"))


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, 3 AS n_fields FROM customer")
def src_json_sink(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON documents and read again; a null field is written too."""
    at = scratch(spark, "json")
    rows = read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"))
    readers.write_json(rows, at)
    told = spark.read.text(at)
    e = F.from_json("value", rows.schema)
    return told.select(e.alias("e"), F.size(F.json_object_keys("value")).alias("n_fields")).select("e.*", "n_fields")


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def src_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the store, read by name and joined."""
    s, n = (readers.read_table(spark, d, name) for name in ("supplier", "nation"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


#: Changes to a detector, and whether the loader takes it.
_PACKS = [({}, True), ({"pattern": "(?=x)x"}, False), ({"pattern": "(x"}, False), ({"pattern": "x{1000}{1000}"}, False), ({"pattern": "x" * 5000}, False), ({"test_values": ["sha256:nothex"]}, False), ({"validator": "none", "mask": "full"}, True), ({"mask": "unknown"}, False), ({"require_keyword": True}, False), ({"extra": 1}, False)]


@query(f"SELECT n_nationkey, n_name, [{', '.join(str(ok).lower() for _, ok in _PACKS)}][(n_nationkey % {len(_PACKS)} + 1)::INT] AS loaded FROM nation")
def insp_pack_guard(spark: SparkSession, d: str) -> DataFrame:
    """A pack of each nation's own, as JSON: what can't run in linear time and little memory, or isn't known, is refused."""
    base = {"id": "x", "name": "x", "category": "x", "pattern": "x"}
    docs = F.array(*[F.lit(json.dumps({"pack": "p", "version": "1", "detectors": [base | change]})) for change, _ in _PACKS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([_loads(x) for x in batch.column(2).to_pylist()], pa.bool_())], names=["n_nationkey", "n_name", "loaded"])

    rows = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.get(docs, (F.col("n_nationkey") % len(_PACKS)).cast("int")).alias("doc"))
    return rows.mapInArrow(run, "n_nationkey long, n_name string, loaded boolean")


def _loads(doc: str) -> bool:
    try:
        return len(packs.load_pack(doc).detectors) == 1
    except packs.PackError:
        return False


def _nested(depth: int) -> dict:
    tree: dict = {"field": "channel", "op": "exists"}
    for _ in range(depth):
        tree = {"not": tree}
    return tree


_LEAF = {"field": "channel", "op": "eq", "value": "x"}
#: Conditions and whether a bundle with them can be used: limits of depth and leaves, roots, operators and what they take.
_TREES = [
    (_LEAF, True), (_nested(16), True), (_nested(17), False), ({"any": [_LEAF] * 256}, True), ({"any": [_LEAF] * 257}, False), ({"all": []}, False), ({"field": "inspection.truncated", "op": "exists"}, False),
    ({"field": "sit.card", "op": "eq", "value": 1}, False), ({"field": "sit.card", "op": "count_gte", "value": 0}, False), ({"field": "user.id", "op": "count_gte", "value": 1}, False), ({"field": "user.id", "op": "in", "value": {"list": "nowhere"}}, False), (_LEAF | {"odd": 1}, False), ({"field": "user.id", "op": "like", "value": "x"}, False),
]


@query(f"SELECT 's' || s_suppkey AS tenant_id, [{', '.join(str(ok).lower() for _, ok in _TREES)}][(s_suppkey % {len(_TREES)} + 1)::INT] AS usable FROM supplier")
def pol_condition_limits(spark: SparkSession, d: str) -> DataFrame:
    """A bundle of each supplier's own, compiled on executors: conditions beyond the limits are refused."""
    docs = F.array(*[F.lit(json.dumps({"schema_version": "1.0", "bundle_version": "1", "classifications": ["a"], "policies": [{"id": "p", "rules": [{"id": "r", "when": tree, "then": [{"action": "block"}]}]}]})) for tree, _ in _TREES])
    tenant = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    doc = F.get(docs, (F.col("s_suppkey") % len(_TREES)).cast("int"))
    own = F.concat(F.lit('{"tenant_id": "'), tenant, F.lit('", '), F.substr(doc, F.lit(2)))
    rows = read(spark, d, "supplier").select(tenant.alias("tenant_id"), own.alias("bundle"))
    return tenancy.compile_bundles(rows).select("tenant_id", F.col("error").isNull().alias("usable"))
