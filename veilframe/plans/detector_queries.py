"""Queries of the catalogue that try every detector on values made from the given tables.

Each customer (or order) gives one text: filler of other than ASCII characters, a
keyword or none, a value that is valid or not, and an end.  The SQL never runs a
pattern on it: it tells from how the value was made whether it is valid, where it
stands in bytes, how sure it is, and how it is masked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import inspect as ins
from . import packs, queries
from .queries import query, read, spread


def _lead(k: Column, keyword: str) -> Column:
    return F.concat(F.repeat(F.lit("é"), (k % 4).cast("int")), F.lit(" "), F.when(k % 2 == 0, F.lit(keyword)).otherwise(F.lit("so")), F.lit(" "))


def _lead_sql(keyword: str) -> str:
    return f"repeat('é', (k % 4)::INT) || ' ' || CASE WHEN k % 2 = 0 THEN '{keyword}' ELSE 'so' END || ' '"


_SECRET = "left(x, least(4, length(x) // 4)) || '…[' || length(x) || ' chars]'"
_PARTIAL = "CASE WHEN length(x) <= 6 THEN repeat('*', length(x)) ELSE left(x, 2) || repeat('*', length(x) - 4) || right(x, 2) END"
_KEYED = "CASE WHEN k % 2 = 0 THEN 'high' ELSE '{}' END"


def _hexed(k: Column) -> Column:
    return F.sha2(F.concat(F.lit("n"), k.cast("string")), 256)


def _b64url(x: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(x, "utf-8")), "+/", "-_"), F.lit("="))


_LABELS = [*packs.KEY_LABELS, "CERTIFICATE", "PUBLIC KEY"]
_H, _B = "sha256('n' || k)", "to_base64(unhex(sha256('n' || k)))"
_URL = "rtrim(translate(to_base64(encode({})), '+/', '-_'), '=')"
_HEAD = """CASE WHEN k % 3 = 0 THEN '{"alg":"HS256","n":' || k || '}' ELSE '{"typ":"JWT","n":' || k || '}' END"""
_SCHEME = "list_extract([" + ", ".join(f"'{x}'" for x in packs.SCHEMES) + f"], (k % {len(packs.SCHEMES)} + 1)::INT)"


def _luhn_sql(d: str) -> str:
    return queries._LUHN.replace("length(d)", f"length({d})").replace("substr(d,", f"substr({d},")


#: detector: (keyword, value, value in SQL, whether it is valid, its confidence, its mask over x, what follows the value)
MADE = {
    "credit_card": ("card", lambda k: F.concat_ws(" ", F.lit("4000"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lpad((k * 7 % 10000).cast("string"), 4, "0"), F.lpad((k * 31 % 10000).cast("string"), 4, "0")), "'4000 ' || lpad((k % 10000)::VARCHAR, 4, '0') || ' ' || lpad((k * 7 % 10000)::VARCHAR, 4, '0') || ' ' || lpad((k * 31 % 10000)::VARCHAR, 4, '0')", _luhn_sql("replace(x, ' ', '')"), _KEYED.format("medium"), "left(replace(x, ' ', ''), 6) || repeat('*', 6) || right(x, 4)"),
    "iban": ("iban", lambda k: F.concat(F.lit("DE"), F.lpad((k % 97).cast("string"), 2, "0"), F.lpad((k * 104729).cast("string"), 18, "0")), "'DE' || lpad((k % 97)::VARCHAR, 2, '0') || lpad((k * 104729)::VARCHAR, 18, '0')", "(substr(x, 5) || '1314' || substr(x, 3, 2))::HUGEINT % 97 = 1", _KEYED.format("medium"), _PARTIAL),
    "aws_access_key_id": ("so", lambda k: F.concat(F.lit("AKIA"), F.upper(F.left(_hexed(k), F.when(k % 5 == 0, 15).otherwise(16)))), f"'AKIA' || upper(left({_H}, CASE WHEN k % 5 = 0 THEN 15 ELSE 16 END))", "k % 5 <> 0", "'high'", _SECRET),
    "aws_secret_access_key": ("aws_secret", lambda k: F.when(k % 3 == 0, F.lit("ab12" * 10)).otherwise(F.left(F.base64(F.unhex(_hexed(k))), F.lit(40))), f"CASE WHEN k % 3 = 0 THEN repeat('ab12', 10) ELSE left({_B}, 40) END", f"k % 2 = 0 AND {queries._BITS.replace('string_split(m,', 'string_split(x,')} >= 4.0", "'high'", _SECRET),
    "private_key": ("so", lambda k: F.concat(F.lit("-----BEGIN "), F.element_at(F.array(*map(F.lit, _LABELS)), (k % len(_LABELS) + 1).cast("int")), F.lit("-----")), "'-----BEGIN ' || list_extract([" + ", ".join(f"'{x}'" for x in _LABELS) + f"], (k % {len(_LABELS)} + 1)::INT) || '-----'", f"k % {len(_LABELS)} < {len(packs.KEY_LABELS)}", "'high'", "'[' || length(x) || ' chars]'"),
    "jwt": ("so", lambda k: F.concat(_b64url(F.concat(F.when(k % 3 == 0, F.lit('{"alg":"HS256","n":')).otherwise(F.lit('{"typ":"JWT","n":')), k.cast("string"), F.lit("}"))), F.lit("."), _b64url(F.concat(F.lit('{"sub":'), k.cast("string"), F.lit("}"))), F.lit("."), F.left(_hexed(k), F.lit(43))), f"{_URL.format(_HEAD)} || '.' || {_URL.format(chr(39) + '{' + chr(34) + 'sub' + chr(34) + ':' + chr(39) + ' || k || ' + chr(39) + '}' + chr(39))} || '.' || left({_H}, 43)", "k % 3 = 0", "'high'", _SECRET),
    "github_token": ("so", lambda k: F.concat(F.element_at(F.array(*map(F.lit, packs.HOST_TOKEN_PREFIXES)), (k % 5 + 1).cast("int")), F.left(_hexed(k), F.when(k % 7 == 0, 35).when(k % 7 == 1, 37).otherwise(36))), "list_extract([" + ", ".join(f"'{x}'" for x in packs.HOST_TOKEN_PREFIXES) + f"], (k % 5 + 1)::INT) || left({_H}, CASE k % 7 WHEN 0 THEN 35 WHEN 1 THEN 37 ELSE 36 END)", "k % 7 > 1", "'high'", _SECRET),
    "db_connection_string": ("so", lambda k: F.concat(F.element_at(F.array(*map(F.lit, packs.SCHEMES)), (k % len(packs.SCHEMES) + 1).cast("int")), F.lit("://joe"), F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(":"), F.left(_hexed(k), F.lit(9)))), F.lit("@db.example")), f"{_SCHEME} || '://joe' || CASE WHEN k % 4 = 0 THEN '' ELSE ':' || left({_H}, 9) END || '@db.example'", "k % 4 <> 0", "'high'", _SECRET),
    "email_address": ("contact", lambda k: F.concat(F.lit("c.roe+"), k.cast("string"), F.when(k % 6 <= 1, F.lit("@")).otherwise(F.lit("@mail-1.")), F.lit("example"), F.when(k % 6 == 1, F.lit(".x")).otherwise(F.lit(".org"))), "'c.roe+' || k || CASE WHEN k % 6 <= 1 THEN '@' ELSE '@mail-1.' END || 'example' || CASE WHEN k % 6 = 1 THEN '.x' ELSE '.org' END", "k % 6 <> 1", "CASE WHEN k % 2 = 0 THEN 'medium' ELSE 'low' END", _PARTIAL),
    "uae_emirates_id": ("id number", lambda k: F.concat(F.lit("784-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0"), F.lit("-"), (k % 10).cast("string")), "'784-' || lpad((k % 10000)::VARCHAR, 4, '0') || '-' || lpad((k * 7919 % 10000000)::VARCHAR, 7, '0') || '-' || (k % 10)", _luhn_sql("replace(x, '-', '')"), _KEYED.format("medium"), _PARTIAL),
    "india_aadhaar": ("aadhaar", lambda k: F.concat_ws(" ", F.lpad((k * 13 % 9000 + 1000).cast("string"), 4, "0"), F.lpad((k * 7 % 10000).cast("string"), 4, "0"), F.lpad((k * 31 % 10000).cast("string"), 4, "0")), "(k * 13 % 9000 + 1000) || ' ' || lpad((k * 7 % 10000)::VARCHAR, 4, '0') || ' ' || lpad((k * 31 % 10000)::VARCHAR, 4, '0')", f"left(x, 1) <> '1' AND {queries._verhoeff_sql().replace('substr(x,', 'substr(y,')} = 0", _KEYED.format("low"), _PARTIAL),
    "india_pan": ("income tax", lambda k: F.concat(F.lit("ABC"), F.char(65 + k % 26), F.lit("K"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("Q")), "'ABC' || chr((65 + k % 26)::INT) || 'K' || lpad((k % 10000)::VARCHAR, 4, '0') || 'Q'", "substr(x, 4, 1) IN ('A', 'B', 'C', 'F', 'G', 'H', 'J', 'L', 'P', 'T')", _KEYED.format("low"), _PARTIAL),
}
for _id, (_word, _value, _value_sql, _valid, _level, _mask) in MADE.items():

    def _run(spark, d, name=_id, word=_word, value=_value):
        k = F.col("k")
        rows = spread(read(spark, d, "customer").select(F.col("c_custkey").alias("k"))).select("k", F.concat(_lead(k, word), value(k), F.lit(" end")).alias("text"))
        hits = ins.long_hits(rows, "k").filter(F.col("detector") == name)
        first = F.get("samples", F.lit(0))
        return hits.select("k", "count", "max_confidence", first["start"].alias("start"), first["end"].alias("end"), first["masked"].alias("masked"))

    query(f"""WITH v AS (SELECT k, {_lead_sql(_word)} AS lead, {_value_sql} AS x FROM (SELECT c_custkey AS k FROM customer)), w AS (SELECT *, replace(x, ' ', '') AS y FROM v)
SELECT k, 1::BIGINT AS count, {_level} AS max_confidence, strlen(lead)::INT AS start, (strlen(lead) + strlen(x))::INT AS "end", {_mask} AS masked FROM w WHERE {_valid}""", f"det_made_{_id}")(_run)


@query("""WITH t AS (SELECT c_custkey AS k, repeat('é', (c_custkey % 700)::INT) || ' 4242424242424242 ' || repeat('x ', (c_custkey % 900)::INT) AS s FROM customer),
u AS (SELECT k, s, strlen(s) > 1000 AS truncated FROM t)
SELECT k, CASE WHEN NOT truncated THEN strlen(s) WHEN k % 700 >= 500 THEN 1000 ELSE 1000 END::BIGINT AS bytes_inspected, truncated, CASE WHEN 2 * (k % 700) + 17 <= 1000 THEN 1 ELSE 0 END AS n_hits FROM u""")
def insp_truncated(spark, d):
    """A byte budget that cuts texts, in some before the card, in others behind it."""
    k = F.col("k")
    text = F.concat(F.repeat(F.lit("é"), (k % 700).cast("int")), F.lit(" 4242424242424242 "), F.repeat(F.lit("x "), (k % 900).cast("int")))
    seen = ins.inspect(spread(read(spark, d, "customer").select(F.col("c_custkey").alias("k"))).select("k", text.alias("text")), budget=ins.Budget(max_bytes=1000))
    hits = F.filter("inspection.hits", lambda h: h["detector"] == "credit_card")
    return seen.select("k", "inspection.bytes_inspected", "inspection.truncated", F.size(hits).alias("n_hits"))


_TENANT = packs.Pack("tenant", "3", (packs.Detector("order_code", "Order code", "ip", r"ORD-[0-9]{6}", keywords=("order",), require_keyword=True, base_confidence="medium", tests={"match": ("order ORD-123456",), "no_match": ("ORD-123456", "order ORD-12345")}), packs.Detector("segment", "Segment word", "ip", "[A-Z]{4,}", base_confidence="low", keyword_confidence="low", mask="full")))


@query("""WITH t AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS named, lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') AS c, replace(o_orderpriority, '-', ' ') AS p FROM orders)
SELECT o_orderkey, 'order_code' AS detector, 1::BIGINT AS count, 'high' AS max_confidence, 'OR******' || right(c, 2) AS samples FROM t WHERE named
UNION ALL SELECT o_orderkey, 'segment', count(DISTINCT w)::BIGINT, 'low', string_agg('[' || length(w) || ' chars]', ',' ORDER BY i) FROM (SELECT o_orderkey, i, w FROM (SELECT o_orderkey, unnest(string_split(p, ' ')) AS w, generate_subscripts(string_split(p, ' '), 1) AS i FROM t) WHERE regexp_full_match(w, '[A-Z]{4,}')) GROUP BY o_orderkey""")
def insp_custom(spark, d):
    """A tenant's own pack on RE2: a required keyword, and words of capitals."""
    o = spread(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"))
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("order")).otherwise(F.lit("code")), F.lit(" ORD-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit(" "), F.col("o_orderpriority"))
    hits = ins.long_hits(o.select("o_orderkey", text.alias("text")), "o_orderkey", packs=[_TENANT])
    return hits.select("o_orderkey", "detector", "count", "max_confidence", F.array_join(F.transform("samples", lambda s: s["masked"]), ",").alias("samples"))


@query("SELECT n_nationkey, 6000::BIGINT AS count, 5::BIGINT AS n_samples FROM nation")
def insp_many_matches(spark, d):
    """12,000 raw matches of 6,000 values in one text: the first 10,000 are read."""
    codes = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11999)), lambda i: F.concat(F.lit("ORD-"), F.lpad((i % 6000).cast("string"), 6, "0"))), " ")
    hits = ins.long_hits(read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("order "), codes).alias("text")), "n_nationkey", packs=[packs.Pack("codes", "1", (packs.Detector("code", "Code", "ip", r"ORD-[0-9]{6}"),))])
    return hits.select("n_nationkey", "count", F.size("samples").cast("long").alias("n_samples"))


@query("WITH i AS (SELECT unnest([" + ", ".join(f"'{d.id}'" for d in packs.BUILTIN.detectors) + "]) AS detector) SELECT n_regionkey, detector, count(*) AS n FROM nation, i GROUP BY ALL")
def insp_detector_ids(spark, d):
    """The pack's ids as detector_ids() tells them, for every nation of a region."""
    ids = ins.detector_ids(spark)
    places = F.explode(F.sequence(F.lit(0), F.lit(len(packs.BUILTIN.detectors) - 1))).alias("ordinal")
    return read(spark, d, "nation").select("n_regionkey", places).join(ids, "ordinal").groupBy("n_regionkey", "detector").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT detector, n_vectors * n AS n_ok, 0::HUGEINT AS n_wrong FROM (SELECT unnest([" + ", ".join(f"'{d.id}'" for d in packs.BUILTIN.detectors) + "]) AS detector, unnest([" + ", ".join(str(sum(len(x) for x in d.tests.values())) for d in packs.BUILTIN.detectors) + "]) AS n_vectors), (SELECT count(*) AS n FROM nation)")
def insp_self_test(spark, d):
    """Every test vector of the pack, behind the name of every nation."""
    told = F.array(*[F.struct(F.lit(i).alias("detector"), F.lit(e).alias("expected"), F.lit(t).alias("text")) for i, e, t in ins.vector_rows()])
    rows = read(spark, d, "nation").select("n_name", F.explode(told).alias("v")).select("v.detector", "v.expected", F.concat("n_name", F.lit(" \n"), "v.text").alias("text"))
    seen = ins.inspect(rows)
    above = F.exists("inspection.hits", lambda h: (h["detector"] == F.col("detector")) & (ins.at_least(h["count_by_confidence"], "medium") > 0))
    ok = above == F.col("expected")
    return seen.groupBy("detector").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_wrong"))
