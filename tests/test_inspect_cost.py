"""What inspection costs: rows dealt over the cores, expressions that are spelt out once, few copies of texts."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilframe.functions import validators
from veilframe.operators import inspect as ins
from veilframe.plans import packs


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", ["det_made_jwt", "det_made_db_connection_string", "insp_truncated", "insp_many_detectors", "udtf_inspect_text"])
def test_a_small_file_is_inspected_by_all_cores(spark, sf, query):
    assert "Repartition 16, true" in _plan(entry.queries()[query](spark, sf))


def test_all_made_texts_are_inspected_by_all_cores(spark, sf):
    """The step is one for all detectors; no task has much more than its share of the rows."""
    from veilframe.plans.detector_queries import MADE
    from veilframe.plans.queries import read, spread

    assert not [d for d in MADE if "Repartition 16, true" not in _plan(entry.queries()[f"det_made_{d}"](spark, sf))]
    sizes = spread(read(spark, sf, "customer").select("c_custkey")).groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(sizes) == 16 and max(sizes)[0] <= 2 * min(sizes)[0]


def test_one_row_group_in_many_stretches_is_dealt_too(spark, sf, tmp_path):
    """A file cut into more stretches of bytes than are asked for: the one with the row group has all rows."""
    from veilframe.plans.queries import read, spread

    spark.range(200_000, numPartitions=1).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = read(spark, str(tmp_path), "customer")
        assert rows.rdd.getNumPartitions() >= 16
        sizes = lambda df: [x[0] for x in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
        dealt = sizes(spread(rows))
        assert sizes(rows) == [200_000] and sum(dealt) == 200_000
        assert len(dealt) >= 16 and max(dealt) <= 2 * min(dealt)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_entropy_reads_the_bytes_once(spark):
    r = random.Random(5)
    texts = ["", "a", "é", "ab12" * 10, *("".join(r.choices("abcXYZ019+/é", k=r.randint(1, 60))) for _ in range(200)), None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.transform(F.array("t"), lambda t: validators.entropy(t))[0].alias("bits"))
    assert _plan(df).count("regexp_extract_all") == 1
    for t, bits in df.collect():
        raw = (t or "").encode()
        assert (bits is None) == (t is None)
        assert t is None or math.isclose(bits, -sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)), abs_tol=1e-9)


def test_hits_look_only_at_detectors_that_found_something(spark):
    """No walk over the table of all detectors for each row: the plan asks for the numbers that were found."""
    many = packs.Pack("many", "1", tuple(packs.Detector(f"d{k}", f"D{k}", "x", rf"CODE-{k:03d}") for k in range(300)))
    df = ins.inspect(spark.createDataFrame([("CODE-299 and CODE-007 and CODE-299",), ("none",)], "text string"), packs=[many])
    assert "array_distinct" in _plan(df) and "transform([[0,d0," not in _plan(df)
    assert [[(h["detector"], h["name"], h["count"]) for h in x["inspection"]["hits"]] for x in df.collect()] == [[("d7", "D7", 1), ("d299", "D299", 1)], []]


def _texts(n):
    r = random.Random(3)
    values = [v for d in packs.BUILTIN.detectors for kind in d.tests.values() for v in map(packs.decoded, kind)]
    filler = ["bank", "é", "​ü", "x  y", "ｶﾞ", " ", "contact", "\t", "🎈"]
    return [" ".join(r.choice(values if r.random() < 0.3 else filler) for _ in range(r.randint(0, 300 if k % 20 == 0 else 9))) for k in range(n)]


def test_one_text_at_a_time_finds_the_same():
    detectors, texts = list(packs.BUILTIN.detectors), _texts(400)
    want = ins.scan(detectors, ins.Budget())(pa.array(texts)).field("spans").to_pylist()
    one = ins.scan_one(detectors, ins.Budget())
    assert [one(t) for t in texts] == want and sum(map(len, want)) > 500


def test_a_batch_is_scanned_in_parts():
    texts = pa.array([*_texts(500), None, "", "x" * 9000])
    whole, seen = ins.scan(list(packs.BUILTIN.detectors), ins.Budget()), []

    def run(part):
        seen.append(part)
        return whole(part)

    assert ins.in_parts(run, 5000)(texts).equals(whole(texts))
    assert len(seen) > 10 and all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) < 5000 + 9000 for p in seen)


@pytest.mark.parametrize("query,most", [("pol_trace", 40_000), ("det_made_jwt", 60_000)])
def test_tests_for_empty_arrays_are_not_spelt_out(spark, sf, query, most):
    """explode() asks whether its array is empty; pushed down, that would compute all of it a second time, with nothing shared."""
    plan = _plan(entry.queries()[query](spark, sf))
    assert len(plan) < most, len(plan)


def test_an_envelope_is_parsed_once(spark):
    from veilframe.streaming.events import parse_envelopes

    rows = spark.createDataFrame([("{",)], "value string")
    plan = _plan(parse_envelopes(rows, keep=("value",)).filter("error IS NULL"))
    assert plan.count("from_json") == 1


@pytest.mark.parametrize("detector,pattern", [("credit_card", r"\d(?:[ -]?\d){12,18}"), ("india_aadhaar", r"[2-9]\d{3}[ -]?\d{4}[ -]?\d{4}"), ("india_pan", "[A-Z]{5}[0-9]{4}[A-Z]")])
def test_the_matcher_skips_to_where_a_match_may_begin(detector, pattern):
    """The same matches as with the look behind first, by which the matcher tries every place of a text."""
    own, plain = next(d.pattern for d in packs.BUILTIN.detectors if d.id == detector), rf"(?<!\w)(?:{pattern})(?!\w)"
    info = re._compiler._code(re._parser.parse(own), 0)
    assert info[0] == re._constants.INFO and info[2] & re._constants.SRE_INFO_CHARSET
    r, n = random.Random(11), 0
    for _ in range(20_000):
        parts = ["4242", "7", "2345 6789-0123", "4242424242424242", "ABCPK1234Q", "XABCPK1234Q", "é", "_", " ", "-", "--", "٣٤", "x", "\n", "."]
        text = "".join(r.choices(parts, k=r.randint(0, 12)))
        want = [m.span() for m in re.finditer(plain, text)]
        assert [m.span() for m in re.finditer(own, text)] == want, text
        n += len(want)
    assert n > 1000
