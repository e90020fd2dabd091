"""The query catalogue: each operator over the given tables, and the same in SQL.

A query is a function of (spark, folder); ``SQL`` has the text for an outside
engine over the same tables.  Results are flat columns with equal names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, text, validators
from ..operators import inspect as ins
from ..operators import policy, secrets, store
from . import bundles, conditions, packs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, however much is done to them behind: a small file is read by few tasks, and a
    large one by no more than it has row groups, into however many stretches of bytes it is cut."""
    n = max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(n)


# ---------------------------------------------------------------- normalisation

_COLLAPSED = r"regexp_replace(regexp_replace(text, '[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]', '', 'g'), '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')"


@query(f"SELECT doc_id, strlen({_COLLAPSED}) AS n_bytes, md5({_COLLAPSED}) AS digest FROM documents")
def norm_collapse(spark, d):
    t = text.collapse(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.md5(t).alias("digest"))


_CUT = "CASE WHEN strlen(text) > 1000 THEN left(text, list_max(list_filter(range(250, 1001), lambda i: strlen(left(text, i)) <= 1000))) ELSE text END"


@query(f"SELECT doc_id, over, length(length(t)::VARCHAR) AS digits, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, strlen(text) > 1000 AS over, {_CUT} AS t FROM documents)")
def norm_truncate(spark, d):
    """Every document, with length and digest of the cut text."""
    t, over = text.cut(F.col("text"), 1000)
    n = F.length(t).cast("long")
    return read(spark, d, "documents").select("doc_id", over.alias("over"), F.length(n.cast("string")).cast("long").alias("digits"), n.alias("n_chars"), F.md5(t).alias("digest"))


#: Holds for texts without compatibility characters, as the given ones are; norm_nfkc_folded has some.
@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest, nfc_normalize(text) = text AS unchanged FROM documents")
def norm_nfkc(spark, d):
    t = text.nfkc(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.md5(t).alias("digest"), (t == F.col("text")).alias("unchanged"))


# -------------------------------------------------------------------- detection

_CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
_NETWORK = " OR ".join(f"(left(d, {len(lo)}) BETWEEN '{lo}' AND '{hi}' AND length(d) IN ({', '.join(map(str, n))}))" for lo, hi, n in validators.CARD_RANGES)
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) - i + 1, 1)::INT ELSE 2 * substr(d, length(d) - i + 1, 1)::INT - CASE WHEN substr(d, length(d) - i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_TESTS = ", ".join(f"'{x}'" for x in packs.TEST_CARDS)


def _card_rows(table: str, key: str, column: str) -> str:
    """Distinct valid cards: (key, first place, raw, digits)."""
    body = _COLLAPSED.replace("text", column)
    return rf"""
raw AS (SELECT {key}, unnest(regexp_extract_all({body}, '{_CARD}')) AS m, generate_subscripts(regexp_extract_all({body}, '{_CARD}'), 1) AS i FROM {table}),
dig AS (SELECT {key}, i, m, replace(replace(m, ' ', ''), '-', '') AS d FROM raw),
ok AS (SELECT {key}, d, min(i) AS i, arg_min(m, i) AS m FROM dig WHERE length(d) BETWEEN 13 AND 19 AND ({_NETWORK}) AND {_LUHN} GROUP BY {key}, d)"""


@query(f"WITH {_card_rows('documents', 'doc_id', 'text')} SELECT doc_id, count(*) AS n_cards, count(*) FILTER (d IN ({_TESTS})) AS n_dummies FROM ok GROUP BY doc_id")
def det_card_counts(spark, d):
    found = ins.detected(read(spark, d, "documents").select("doc_id", "text"), "credit_card").filter(F.size("found") > 0)
    return found.select("doc_id", F.size("found").cast("long").alias("n_cards"), F.size(F.filter("found", lambda m: m["c"] == 0)).cast("long").alias("n_dummies"))


@query(f"WITH {_card_rows('documents', 'doc_id', 'text')} SELECT doc_id, string_agg(left(d, 6) || repeat('*', length(d) - 10) || right(d, 4), ',' ORDER BY i) AS masked FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM ok) WHERE k <= 5 GROUP BY doc_id")
def det_card_masked(spark, d):
    found = ins.detected(read(spark, d, "documents").select("doc_id", "text"), "credit_card").filter(F.size("found") > 0)
    return found.select("doc_id", F.array_join(F.transform(F.slice("found", 1, 5), lambda m: masks.mask_card(m["m"])), ",").alias("masked"))


_EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9]+(?:-+[A-Za-z0-9]+)*\.)+[A-Za-z]{2,}\b"


def _emails(table: str, key: str, column: str) -> str:
    body = _COLLAPSED.replace("text", column)
    return rf"""
t AS (SELECT {key}, {body} AS t FROM {table}),
g AS (SELECT {key}, t, regexp_extract_all(t, '{_EMAIL}') AS ms, regexp_split_to_array(t, '{_EMAIL}') AS gaps FROM t),
r AS (SELECT {key}, t, ms[i] AS m, i, list_sum(list_transform(range(1, i + 1), lambda k: length(gaps[k]))) + coalesce(list_sum(list_transform(range(1, i), lambda k: length(ms[k]))), 0) AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM g)),
e AS (SELECT {key}, m, i, s, lower(substr(t, greatest(s::BIGINT - 64, 0) + 1, (least(s::BIGINT + length(m) + 64, length(t)) - greatest(s::BIGINT - 64, 0))::BIGINT)) AS w FROM r),
f AS (SELECT {key}, replace(replace(m, ' ', ''), '-', '') AS k, arg_min(w, i) AS w FROM e GROUP BY ALL)"""


_NEAR = "(" + " OR ".join(f"contains(w, '{x}')" for x in next(x for x in packs.BUILTIN.detectors if x.id == "email_address").keywords) + ")"


@query(f"WITH {_emails('documents', 'doc_id', 'text')} SELECT doc_id, count(*) AS n_emails FROM f GROUP BY doc_id")
def det_email_counts(spark, d):
    found = ins.detected(read(spark, d, "documents").select("doc_id", "text"), "email_address")
    return found.filter(F.size("found") > 0).select("doc_id", F.size("found").cast("long").alias("n_emails"))


@query()
def det_email_confidence(spark, d):
    found = ins.detected(read(spark, d, "pages").select("page_id", "html"), "email_address", "html").filter(F.size("found") > 0)
    count = lambda r: F.size(F.filter("found", lambda m: m["c"] == r)).cast("long")
    return found.select("page_id", count(0).alias("low"), count(1).alias("medium"))


SQL["det_email_confidence"] = f"WITH {_emails('pages', 'page_id', 'html')} SELECT page_id, count(*) FILTER (NOT {_NEAR}) AS low, count(*) FILTER ({_NEAR}) AS medium FROM f GROUP BY page_id"

_BITS = "list_sum(list_transform(list_distinct(string_split(m, '')), lambda c: -(len(list_filter(string_split(m, ''), lambda x: x = c)) / 40.0) * log2(len(list_filter(string_split(m, ''), lambda x: x = c)) / 40.0)))"


@query(f"WITH r AS (SELECT doc_id, unnest(regexp_extract_all({_COLLAPSED}, '[A-Za-z0-9/+]{{40}}')) AS m FROM documents) SELECT doc_id, m AS value, round({_BITS}, 6) AS bits FROM r")
def det_secret40_entropy(spark, d):
    t = text.collapse(F.col("text"))
    rows = read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(t, F.lit("[A-Za-z0-9/+]{40}"), F.lit(0))).alias("value"))
    return rows.select("doc_id", "value", F.round(validators.entropy(F.col("value")), 6).alias("bits"))


@query()
def det_all_long(spark, d):
    """Every detector's hits, a row each."""
    seen = ins.inspect(read(spark, d, "documents").select("doc_id", "text"))
    h = seen.select("doc_id", F.explode("inspection.hits").alias("h"))
    return h.select("doc_id", "h.detector", "h.count", "h.max_confidence", F.array_join(F.transform("h.samples", lambda s: s["masked"]), ",").alias("samples"))


def _by(column: str) -> tuple[Query, str]:
    def run(spark, d):
        docs = read(spark, d, "documents").select("doc_id", column, "text")
        n = F.size(F.col("found")).cast("long")
        return ins.detected(docs, "credit_card").groupBy(column).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(n).alias("n_cards"), F.count_if(n > 0).alias("n_docs_with_cards"))

    sql = f"WITH {_card_rows('documents', 'doc_id', 'text')}, n AS (SELECT doc_id, count(*) AS n FROM ok GROUP BY doc_id) SELECT {column}, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_cards, count(n) AS n_docs_with_cards FROM documents LEFT JOIN n USING (doc_id) GROUP BY {column}"
    return run, sql


for _name, _column in (("hits_by_lang", "lang"), ("hits_by_source", "source")):
    _run, _sql = _by(_column)
    query(_sql, _name)(_run)


def _secrets_sql(lines: str) -> str:
    """Findings of (source, id, line, s) rows; a bare key is a whole run of base64 characters, 40 long."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    bare = r"len(list_filter(regexp_extract_all(s, '[A-Za-z0-9+/]+=?'), lambda x: length(x) = 40 AND NOT contains(x, '=') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))) > 0"
    tests = {n: f"regexp_matches(s, {quoted(secrets.shape(n, chr(92) + 'b', chr(92) + 'b'))})" for n in secrets.SHAPES} | {"bare_secret_key": f"regexp_matches(s, {quoted(secrets.PROVIDER)}) AND {bare}"}
    told = "CASE WHEN contains(s, 'b64:') THEN decode(from_base64(regexp_extract(s, 'b64:([A-Za-z0-9+/]+={0,2})', 1))) ELSE s END"
    edge = r"\b"
    ids = f"regexp_extract_all({told}, {quoted(edge + secrets._KEY_ID + edge)})"
    tests["published_example"] = f"list_has_any(list_transform({ids}, lambda x: sha256(x)), [{', '.join(map(quoted, secrets.PUBLISHED))}])"
    return f"WITH l AS ({lines}) " + " UNION ALL ".join(f"SELECT source, id, line, '{n}' AS finding FROM l WHERE {t}" for n, t in tests.items())


def _lines_sql(table: str, key: str, column: str) -> str:
    return f"SELECT '{table}' AS source, {key} AS id, unnest(string_split({column}, chr(10))) AS s, generate_subscripts(string_split({column}, chr(10)), 1) AS line FROM {table}"


@query(_secrets_sql(_lines_sql("documents", "doc_id", "text") + " UNION ALL " + _lines_sql("pages", "page_id", "html")))
def line_secret_scan(spark, d):
    docs = secrets.scan_lines(read(spark, d, "documents"), "doc_id", "text").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("line").cast("long").alias("line"), "finding")
    pages = secrets.scan_lines(read(spark, d, "pages"), "page_id", "html").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("line").cast("long").alias("line"), "finding")
    return docs.unionByName(pages)


#: Lines in the shape of credentials, made from the digest h of a customer's name: (SQL, Spark).
_SHAPED = [
    ("'id AKIA' || upper(left(h, 16)) || ' end'", lambda h: F.concat(F.lit("id AKIA"), F.upper(F.left(h, F.lit(16))), F.lit(" end"))),
    ("'aws ' || lower(left(b, 40)) || ' ' || left(b, 40)", lambda h: F.concat(F.lit("aws "), F.lower(F.left(_b64(h), F.lit(40))), F.lit(" "), F.left(_b64(h), F.lit(40)))),
    ("'plain ' || left(b, 40)", lambda h: F.concat(F.lit("plain "), F.left(_b64(h), F.lit(40)))),
    ("'t=ghp_' || left(h, 36)", lambda h: F.concat(F.lit("t=ghp_"), F.left(h, F.lit(36)))),
    ("'t=ghp_' || left(h, 37)", lambda h: F.concat(F.lit("t=ghp_"), F.left(h, F.lit(37)))),
    ("'xoxb-' || left(h, 10 + k % 2)", lambda h: F.concat(F.lit("xoxb-"), F.left(h, (10 + F.col("k") % 2).cast("int")))),
    ("'see mysql://joe:' || left(h, 8) || '@db.example'", lambda h: F.concat(F.lit("see mysql://joe:"), F.left(h, F.lit(8)), F.lit("@db.example"))),
    ("'-----BEGIN EC PRIVATE' || ' KEY-----'", lambda h: F.lit("-----BEGIN EC PRIVATE KEY-----")),
    ("'id AKIA' || 'IOSFODNN7' || CASE WHEN k % 2 = 0 THEN 'EXAMPLE' ELSE 'EXAMPLF' END", lambda h: F.concat(F.lit("id AKIA"), F.lit("IOSFODNN7"), F.when(F.col("k") % 2 == 0, "EXAMPLE").otherwise("EXAMPLF"))),
    ("'b64:' || to_base64(encode('x AKIA' || 'IOSFODNN7' || CASE WHEN k % 3 = 0 THEN 'EXAMPLE' ELSE 'EXAMPLF' END))", lambda h: F.concat(F.lit("b64:"), F.base64(F.encode(F.concat(F.lit("x AKIA"), F.lit("IOSFODNN7"), F.when(F.col("k") % 3 == 0, "EXAMPLE").otherwise("EXAMPLF")), "utf-8")))),
    ("'a.eyJ' || left(h, 20) || '.eyJ' || left(h, 12) || '.' || left(h, 20)", lambda h: F.concat(F.lit("a.eyJ"), F.left(h, F.lit(20)), F.lit(".eyJ"), F.left(h, F.lit(12)), F.lit("."), F.left(h, F.lit(20)))),
]


def _b64(h):
    return F.base64(F.unhex(h))


@query(_secrets_sql(f"SELECT 'customer' AS source, k AS id, i AS line, CASE i {' '.join(f'WHEN {i} THEN {q}' for i, (q, _) in enumerate(_SHAPED, 1))} END AS s FROM (SELECT c_custkey AS k, sha256(c_name) AS h, to_base64(unhex(sha256(c_name))) AS b FROM customer), range(1, {len(_SHAPED) + 1}) AS r(i)"))
def line_secret_shapes(spark, d):
    """Texts of eleven lines made from every customer's name: each shape, and published examples in the open and in test vectors."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.sha2("c_name", 256).alias("h"))
    text = F.array_join(F.array(*[f(F.col("h")) for _, f in _SHAPED]), "\n")
    found = secrets.scan_lines(c.select("k", text.alias("text")), "k", "text")
    return found.select(F.lit("customer").alias("source"), F.col("k").alias("id"), F.col("line").cast("long").alias("line"), "finding")


# --------------------------------------------------------------- checks and masks


@query(f"WITH x AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + 13)::VARCHAR, 16, '4') AS d FROM orders) SELECT o_orderkey, {_LUHN} AS luhn_ok, ({_NETWORK}) AS network_ok FROM x")
def val_luhn(spark, d):
    n = F.lpad((F.col("o_orderkey") * 7919 + 13).cast("string"), 16, "4")
    return read(spark, d, "orders").select("o_orderkey", validators.luhn(n).alias("luhn_ok"), validators.card_network(n).alias("network_ok"))


@query("WITH x AS (SELECT c_custkey, lpad((c_custkey % 97)::VARCHAR, 2, '0') AS c, lpad((c_custkey * 104729)::VARCHAR, 18, '0') AS b FROM customer) SELECT c_custkey, (b || '1314' || c)::HUGEINT % 97 = 1 AS iban_ok FROM x")
def val_iban(spark, d):
    """DE and 20 digits; 'DE' stands for 1314 when the front is moved to the end."""
    c = read(spark, d, "customer")
    value = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 104729).cast("string"), 18, "0"))
    return c.select("c_custkey", validators.iban(value).alias("iban_ok"))


def _verhoeff_sql() -> str:
    product, perm = validators._verhoeff_tables()
    digit = "substr(x, 12 - k, 1)::INT"
    steps = "0"
    for k in range(12):
        p = f"({json.dumps(perm)})[{(k % 8) * 10} + {digit.replace('k', str(k))} + 1]"
        steps = f"({json.dumps(product)})[10 * {steps} + {p} + 1]"
    return steps


@query(f"SELECT o_orderkey, {_verhoeff_sql()} = 0 AS verhoeff_ok, {_verhoeff_sql()} = 0 AND left(x, 1) NOT IN ('0', '1') AS aadhaar_ok FROM (SELECT o_orderkey, lpad(((o_orderkey * 15485863 + 7) % 1000000000000)::VARCHAR, 12, '2') AS x FROM orders)")
def val_verhoeff(spark, d):
    """12 digits for every key."""
    x = F.lpad(((F.col("o_orderkey") * 15485863 + 7) % 1000000000000).cast("string"), 12, "2")
    rows = read(spark, d, "orders").select("o_orderkey", x.alias("x"))
    return rows.select("o_orderkey", validators.verhoeff(F.col("x")).alias("verhoeff_ok"), validators.aadhaar(F.col("x")).alias("aadhaar_ok"))




@query("SELECT c_custkey, substr(x, 4, 1) IN ('P', 'C', 'H', 'F', 'A', 'T', 'B', 'L', 'J', 'G') AS pan_ok FROM (SELECT c_custkey, 'ABC' || chr((65 + c_custkey % 26)::INT) || 'K' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'Q' AS x FROM customer)")
def val_pan(spark, d):
    k = F.col("c_custkey")
    x = F.concat(F.lit("ABC"), F.char(65 + k % 26), F.lit("K"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("Q"))
    return read(spark, d, "customer").select("c_custkey", validators.india_pan(x).alias("pan_ok"))


@query(f"SELECT o_orderkey, {_LUHN} AS emirates_ok FROM (SELECT o_orderkey, '784' || lpad((o_orderkey * 7919 % 1000000000000)::VARCHAR, 12, '0') AS d FROM orders)")
def val_emirates_id(spark, d):
    k = F.lpad((F.col("o_orderkey") * 7919 % 1000000000000).cast("string"), 12, "0")
    dashed = F.concat(F.lit("784-"), F.left(k, F.lit(4)), F.lit("-"), F.substring(k, 5, 7), F.lit("-"), F.right(k, F.lit(1)))
    return read(spark, d, "orders").select("o_orderkey", validators.emirates_id(dashed).alias("emirates_ok"))


@query("SELECT c_custkey, round(list_sum(list_transform(list_distinct(string_split(c_name, '')), lambda c: -(len(list_filter(string_split(c_name, ''), lambda x: x = c)) / length(c_name)::DOUBLE) * log2(len(list_filter(string_split(c_name, ''), lambda x: x = c)) / length(c_name)::DOUBLE))), 6) AS bits FROM customer")
def val_entropy(spark, d):
    return read(spark, d, "customer").select("c_custkey", F.round(validators.entropy(F.col("c_name")), 6).alias("bits"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true ELSE false END AS jwt_ok FROM customer")
def val_jwt(spark, d):
    """Heads with an alg, without one, and of another kind."""
    k = F.col("c_custkey")
    head = F.when(k % 3 == 0, F.concat(F.lit('{"alg":"HS256","n":'), k.cast("string"), F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('{"typ":'), k.cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit("]")))
    token = F.concat(F.rtrim(F.translate(F.base64(F.encode(head, "utf-8")), "+/=", "-_"), F.lit("=")), F.lit(".eyJ4IjoxfQ.sig"))
    return read(spark, d, "customer").select("c_custkey", validators.jwt(token).alias("jwt_ok"))


@query("SELECT o_orderkey, left(d, 6) || repeat('*', length(d) - 10) || right(d, 4) AS masked FROM (SELECT o_orderkey, lpad((o_orderkey * 7919)::VARCHAR, 16, '4') AS d FROM orders)")
def mask_card(spark, d):
    x = F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4")
    spaced = F.concat_ws(" ", F.left(x, F.lit(4)), F.substring(x, 5, 4), F.substring(x, 9, 4), F.right(x, F.lit(4)))
    return read(spark, d, "orders").select("o_orderkey", masks.mask_card(spaced).alias("masked"))


_MASKS = {
    "mask_partial": "CASE WHEN length(x) <= 6 THEN repeat('*', length(x)) ELSE left(x, 2) || repeat('*', length(x) - 4) || right(x, 2) END",
    "mask_secret": "left(x, least(4, length(x) // 4)) || '…[' || length(x) || ' chars]'",
    "mask_full": "'[' || length(x) || ' chars]'",
}
for _name, _sql in _MASKS.items():

    def _run(spark, d, f=getattr(masks, _name)):
        """The whole text masked."""
        return read(spark, d, "documents").select("doc_id", f(F.col("text")).alias("masked"))

    query(f"SELECT doc_id, {_sql} AS masked FROM (SELECT doc_id, text AS x FROM documents)", _name)(_run)


@query("SELECT c_custkey, sha256(upper(replace(replace(replace(x, ' ', ''), '-', ''), '.', ''))) AS digest, replace(replace(x, ' ', ''), '-', '') AS key FROM (SELECT c_custkey, c_name || ' ' || c_mktsegment || '-a.b' AS x FROM customer)")
def canon_sha256(spark, d):
    x = F.concat(F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit("-a.b"))
    return read(spark, d, "customer").select("c_custkey", masks.canonical_sha256(x).alias("digest"), masks.distinct_key(x).alias("key"))


# ------------------------------------------------------------------- conditions

LABELS = ["Public", "Internal", "Confidential", "Restricted"]
_K = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"
_LABEL = f"CASE {_K} % 5 WHEN 0 THEN 'Public' WHEN 1 THEN 'internal' WHEN 2 THEN 'Confidential' WHEN 3 THEN 'RESTRICTED' ELSE 'other' END"


def facts(spark: SparkSession, d: str, dealt: Callable[[DataFrame], DataFrame] = lambda e: e) -> DataFrame:
    """Events with a VARIANT of facts made from their columns; every seventh has no user."""
    e = dealt(read(spark, d, "events"))
    k = F.get_json_object("props", "$.k").cast("long")
    label = F.element_at(F.array(*map(F.lit, ["Public", "internal", "Confidential", "RESTRICTED", "other"])), (k % 5 + 1).cast("int"))
    user = F.when(F.col("event_id") % 7 != 0, F.struct(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.array(F.concat(F.lit("G"), (F.col("user_id") % 5).cast("string")), F.lit("Staff")).alias("groups")))
    f = F.struct(F.col("event_type").alias("channel"), user.alias("user"), label.alias("classification"), F.struct(k.alias("k"), F.col("value").alias("value"), k.cast("string").alias("text")).alias("volume"), F.struct((F.col("user_id") % 3 == 0).alias("external"), F.concat(F.lit("Host"), (k % 10).cast("string"), F.lit(".Example")).alias("domain")).alias("destination"))
    hits = F.when(k % 4 == 0, F.struct(F.array(F.struct(F.lit("credit_card").alias("detector"), F.struct((k % 3).alias("low"), (k % 5).alias("medium"), (k % 7).alias("high")).alias("count_by_confidence"))).alias("hits")))
    return e.withColumn("k", k).withColumn("facts", F.parse_json(F.to_json(F.struct(f["channel"].alias("channel"), f["user"].alias("user"), f["classification"].alias("classification"), f["volume"].alias("volume"), f["destination"].alias("destination"), hits.alias("inspection")))))


_FACTS = f"f AS (SELECT event_id, event_type, user_id, value, {_K} AS k, {_LABEL} AS label, event_id % 7 <> 0 AS has_user FROM events)"
_RANK = "list_position(['public', 'internal', 'confidential', 'restricted'], lower(label))"
CONDITIONS = {
    "cond_eq": ({"field": "channel", "op": "eq", "value": "CLICK"}, "event_type = 'click'"),
    "cond_ne": ({"field": "user.id", "op": "ne", "value": "u7"}, "has_user AND user_id <> 7"),
    "cond_in": ({"field": "user.groups", "op": "in", "value": {"list": "teams"}}, "has_user AND user_id % 5 IN (1, 3)"),
    "cond_not_in": ({"field": "channel", "op": "not_in", "value": ["click", "VIEW"]}, "event_type NOT IN ('click', 'view')"),
    "cond_gt": ({"field": "volume.k", "op": "gt", "value": 50}, "k > 50"),
    "cond_gte": ({"field": "classification", "op": "gte", "value": "Confidential"}, f"coalesce({_RANK}, 0) >= 3"),
    "cond_lt": ({"field": "volume.value", "op": "lt", "value": 40.5}, "value < 40.5"),
    "cond_lte": ({"field": "classification", "op": "lte", "value": "Internal"}, f"coalesce({_RANK}, 9) BETWEEN 1 AND 2"),
    "cond_contains": ({"field": "user.groups", "op": "contains", "value": "g2"}, "has_user AND user_id % 5 = 2"),
    "cond_starts_with": ({"field": "destination.domain", "op": "starts_with", "value": "HOST1"}, "k % 10 = 1"),
    "cond_ends_with": ({"field": "destination.domain", "op": "ends_with", "value": "3.example"}, "k % 10 = 3"),
    "cond_exists": ({"field": "user.id", "op": "exists"}, "has_user"),
    "cond_count_gte": ({"field": "sit.credit_card", "op": "count_gte", "value": 5}, "k % 4 = 0 AND k % 5 + k % 7 >= 5"),
    "cond_missing_not": ({"all": [{"not": {"field": "user.id", "op": "eq", "value": "u3"}}, {"any": [{"field": "volume.text", "op": "eq", "value": 7}, {"field": "destination.external", "op": "eq", "value": True}]}]}, "NOT (has_user AND user_id = 3) AND user_id % 3 = 0"),
}
for _name, (_tree, _sql) in CONDITIONS.items():

    def _run(spark, d, tree=_tree):
        c = conditions.Compiler(F.col("facts"), LABELS)
        return facts(spark, d).select("event_id", c.tree(conditions.parse(tree, {"teams": ["g1", "g3"]})).alias("matched"))

    query(f"WITH {_FACTS} SELECT event_id, coalesce({_sql}, false) AS matched FROM f", _name)(_run)


# --------------------------------------------------------------------- policies

NOW = datetime(2026, 3, 1, 12, tzinfo=UTC)
BUNDLE = bundles.load_bundle(
    {
        "schema_version": "1.0",
        "tenant_id": "t-1",
        "bundle_version": "b-7",
        "classifications": LABELS,
        "lists": {"partners": ["host1.example", "host2.example"]},
        "default_action": "audit",
        "policies": [
            {"id": "p1", "name": "Restricted data", "priority": 50, "rules": [{"id": "r1", "when": {"field": "classification", "op": "gte", "value": "Restricted"}, "then": [{"action": "block"}, {"action": "create_incident", "severity": "high"}]}, {"id": "r2", "when": {"field": "volume.k", "op": "gte", "value": 90}, "then": [{"action": "warn"}, {"action": "create_incident", "severity": "low"}, {"action": "notify_user"}]}]},
            {"id": "p2", "name": "Clicks abroad", "priority": 60, "channels": ["CLICK", "error"], "rules": [{"id": "r1", "when": {"field": "destination.external", "op": "eq", "value": True}, "then": [{"action": "block"}, {"action": "tag", "name": "abroad"}]}]},
            {"id": "p3", "name": "Partners", "priority": 55, "scope": {"groups": ["g1", "G4"], "exclude_users": ["u4"]}, "rules": [{"id": "x1", "exception": True, "when": {"field": "destination.domain", "op": "in", "value": {"list": "partners"}}, "then": [{"action": "allow"}, {"action": "tag", "name": "partner"}]}]},
            {"id": "p4", "name": "Watch purchases", "priority": 10, "mode": "monitor", "rules": [{"id": "m1", "when": {"field": "channel", "op": "eq", "value": "purchase"}, "then": [{"action": "block"}]}]},
            {"id": "p5", "name": "Later", "priority": 99, "schedule": {"activate_at": "2027-01-01T00:00:00Z"}, "rules": [{"id": "r1", "when": {"field": "channel", "op": "exists"}, "then": [{"action": "block"}]}]},
            {"id": "p6", "name": "Off", "priority": 99, "enabled": False, "rules": [{"id": "r1", "when": {"field": "channel", "op": "exists"}, "then": [{"action": "block"}]}]},
        ],
    }
)
_POLICY = f"""{_FACTS},
m AS (SELECT *, coalesce({_RANK}, 0) = 4 AS a1, k >= 90 AS a2, event_type IN ('click', 'error') AND user_id % 3 = 0 AS b1,
      has_user AND user_id % 5 IN (1, 4) AND user_id <> 4 AND k % 10 IN (1, 2) AS x1, event_type = 'purchase' AS m1 FROM f),
w AS (SELECT *, a1 AND NOT x1 AS a1s, a2 AND NOT x1 AS a2s FROM m),
v AS (SELECT *, CASE WHEN b1 THEN 'block' WHEN a1s THEN 'block' WHEN a2s THEN 'warn' WHEN x1 THEN 'allow' ELSE 'audit' END AS action,
      CASE WHEN b1 THEN 'p2/r1' WHEN a1s THEN 'p1/r1' WHEN a2s THEN 'p1/r2' WHEN x1 THEN 'p3/x1' END AS decided FROM w)"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return policy.evaluate(facts(spark, d), BUNDLE, now=NOW)


@query(f"WITH {_POLICY} SELECT event_id, action, decided FROM v")
def pol_winner(spark, d):
    return _verdicts(spark, d).select("event_id", "verdict.action", F.concat_ws("/", "verdict.decided_by.policy", "verdict.decided_by.rule").alias("decided")).withColumn("decided", F.when(F.col("decided") != "", F.col("decided")))


@query(f"""WITH {_POLICY} SELECT event_id, action, decided, CASE decided WHEN 'p2/r1' THEN 60 WHEN 'p3/x1' THEN 55 ELSE CASE WHEN decided IS NOT NULL THEN 50 END END AS priority, concat_ws(',', CASE WHEN a1s THEN 'create_incident' END, CASE WHEN a2s AND NOT a1s THEN 'create_incident' END,
CASE WHEN a2s THEN 'notify_user' END, CASE WHEN b1 THEN 'tag' END, CASE WHEN x1 THEN 'tag' END) AS effects FROM v""")
def pol_fast(spark, d):
    """The decision alone, by bit sets."""
    v = policy.evaluate_fast(facts(spark, d), BUNDLE, now=NOW)
    decided = F.when(F.col("verdict.decided_by").isNotNull(), F.concat_ws("/", "verdict.decided_by.policy", "verdict.decided_by.rule"))
    return v.select("event_id", "verdict.action", decided.alias("decided"), "verdict.decided_by.priority", F.array_join(F.transform("verdict.side_effects", lambda e: e["action"]), ",").alias("effects"))


@query(f"WITH {_POLICY} SELECT event_id, (a1 AND x1)::BIGINT + (a2 AND x1)::BIGINT AS n_overridden FROM v WHERE x1")
def pol_exception(spark, d):
    v = _verdicts(spark, d).filter(F.exists("verdict.matched", lambda m: m["exception"]))
    return v.select("event_id", F.size(F.filter("verdict.matched", lambda m: m["overridden"])).cast("long").alias("n_overridden"))


@query(f"WITH {_POLICY} SELECT event_id, m1::BIGINT AS n_monitored, action FROM v")
def pol_monitor(spark, d):
    return _verdicts(spark, d).select("event_id", F.size("verdict.monitor_matches").cast("long").alias("n_monitored"), "verdict.action")


@query(f"""WITH {_POLICY} SELECT event_id, concat_ws(',', CASE WHEN a1s THEN 'create_incident' END, CASE WHEN a2s AND NOT a1s THEN 'create_incident' END,
CASE WHEN a2s THEN 'notify_user' END, CASE WHEN b1 THEN 'tag' END, CASE WHEN x1 THEN 'tag' END) AS effects FROM v""")
def pol_effects(spark, d):
    return _verdicts(spark, d).select("event_id", F.array_join(F.transform("verdict.side_effects", lambda e: e["action"]), ",").alias("effects"))


@query(f"WITH {_POLICY} SELECT event_id, CASE WHEN a1s THEN 'high' ELSE 'low' END AS severity FROM v WHERE a1s OR a2s")
def pol_incident(spark, d):
    rows = _verdicts(spark, d).select("event_id", F.explode("verdict.side_effects").alias("e")).filter("e.action = 'create_incident'")
    return rows.select("event_id", F.get_json_object("e.params", "$.severity").alias("severity"))


@query(f"WITH {_POLICY} SELECT action, count(*) AS n FROM v GROUP BY action")
def pol_action_counts(spark, d):
    return _verdicts(spark, d).groupBy("verdict.action").agg(F.count(F.lit(1)).alias("n"))


def _gate(name: str, sql: str, when: int) -> None:
    def run(spark, d):
        p = BUNDLE.policies[when]
        return facts(spark, d).select("event_id", policy.skipped_reason(p, F.col("facts"), F.lit(NOW)).isNull().alias("applies"))

    query(sql, name)(run)


_gate("pol_gate_channel", "SELECT event_id, event_type IN ('click', 'error') AS applies FROM events", 1)
_gate("pol_gate_scope", "SELECT event_id, event_id % 7 <> 0 AND user_id % 5 IN (1, 4) AND user_id <> 4 AS applies FROM events", 2)


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' AS applies FROM events")
def pol_gate_schedule(spark, d):
    p = bundles.load_bundle({"schema_version": "1.0", "tenant_id": "t", "bundle_version": "v", "classifications": ["a"], "policies": [{"id": "s", "rules": [], "schedule": {"activate_at": "2024-01-10T00:00:00Z", "expire_at": "2024-01-20T14:00:00+02:00"}}]}).policies[0]
    at = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.col("ts")).cast("string")
    return facts(spark, d).select("event_id", policy.skipped_reason(p, F.col("facts"), F.to_timestamp(F.concat(at, F.lit("Z")))).isNull().alias("applies"))


@query()
def pol_explain_trace(spark, d):
    """Words and full trace of every verdict, as digests of their text."""
    v = policy.evaluate(facts(spark, d), BUNDLE, now=NOW, trace=True)
    return v.select("event_id", "verdict.explanation", F.size("verdict.diagnostics").alias("n_diagnostics"), F.md5(F.to_json("verdict.trace")).alias("trace_digest"))


_PROMPTS = bundles.load_bundle({"schema_version": "1.0", "tenant_id": "t", "bundle_version": "v", "classifications": LABELS, "default_action": "allow", "policies": [{"id": "cards", "name": "Cards in prompts", "priority": 1, "channels": ["genai_prompt"], "rules": [{"id": "r", "when": {"field": "sit.credit_card", "op": "exists"}, "then": [{"action": "block"}]}, {"id": "s", "when": {"field": "file.size", "op": "gt", "value": 500}, "then": [{"action": "warn"}]}]}]})


@query("SELECT conv_id, turn, CASE WHEN length(text) > 500 THEN 'warn' ELSE 'allow' END AS action FROM conversations WHERE role = 'user'")
def conv_prompt_policy(spark, d):
    """Prompts inspected, then judged (the generated prompts hold no card numbers)."""
    c = read(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    pack = ins.Pack("cards", "1", tuple(x for x in ins.BUILTIN.detectors if x.id == "credit_card"))
    seen = ins.inspect(c, packs=[pack])
    f = F.parse_json(F.to_json(F.struct(F.lit("genai_prompt").alias("channel"), F.struct(F.length("text").alias("size")).alias("file"), F.col("inspection"))))
    return policy.evaluate(seen.withColumn("facts", f), _PROMPTS, now=NOW).select("conv_id", "turn", "verdict.action")


# ------------------------------------------------------------------------ store


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey = 7")
def tenant_view(spark, d):
    return store.tenant_view(read(spark, d, "customer"), 7, "c_nationkey").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT n_name, count(c_custkey) AS n_customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name")
def tenant_subtree(spark, d):
    n = read(spark, d, "nation").withColumn("path", F.concat_ws("/", F.lit(""), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    below = store.tenant_subtree(n, "/r2")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    return below.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n_customers"))


@query("SELECT user_id, count(*) AS n_rows, CASE WHEN user_id % 10 = 3 AND count(*) >= 3 THEN 3 ELSE 0 END AS first_bad_seq FROM events GROUP BY user_id")
def audit_chain_verify(spark, d):
    """Chains over the events of each user; every tenth user's third row is altered, and found."""
    e = read(spark, d, "events").select("user_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"), F.lit(None).cast("string").alias("source_ip"), F.col("event_type").alias("action"), F.lit("event").alias("object_type"), F.col("event_id").cast("string").alias("object_id"), F.lit(None).cast("string").alias("old_value"), F.col("props").alias("new_value"), F.lit("success").alias("result"))
    chain = store.build_audit_chain(e, tenant_col="user_id", order_cols=("object_id",))
    altered = chain.withColumn("action", F.when((F.col("user_id") % 10 == 3) & (F.col("seq") == 3), F.lit("forged")).otherwise(F.col("action")))
    return store.verify_audit_chain(altered, "user_id").withColumn("first_bad_seq", F.coalesce("first_bad_seq", F.lit(0)))


@query("""WITH p AS (SELECT event_type, user_id, ts, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts) AS last FROM events),
n AS (SELECT *, sum(CASE WHEN last IS NULL OR epoch_us(ts) - epoch_us(last) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM p)
SELECT event_type, user_id, no::BIGINT AS incident_no, count(*) AS occurrences, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM n GROUP BY ALL""")
def incident_dedup(spark, d):
    return store.merge_incidents(read(spark, d, "events"), tenant_col="event_type", key_col="user_id", time_col="ts", window_seconds=86400)


@query("SELECT o_orderkey, 'status' AS violation FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'total' FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 400000")
def dq_domains(spark, d):
    o = read(spark, d, "orders")
    return store.domain_violations(o, {"status": F.col("o_orderstatus").isin("F", "O"), "total": F.col("o_totalprice").between(1000, 400000)}).select("o_orderkey", "violation")


@query("SELECT c_custkey, 'c_mktsegment changed' AS violation FROM customer WHERE c_custkey % 10 = 1 AND c_mktsegment <> 'X' UNION ALL SELECT c_custkey, 'deleted' FROM customer WHERE c_custkey % 10 = 2")
def version_diff(spark, d):
    c = read(spark, d, "customer")
    after = c.filter("c_custkey % 10 <> 2").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 1, "X").otherwise(F.col("c_mktsegment")))
    return store.version_violations(c, after, ["c_custkey"], ["c_mktsegment"], ["c_acctbal"])


@query("SELECT le, n FROM (SELECT unnest([{'le': '0.005', 'n': count(*) FILTER (s <= 0.005)}, {'le': '0.025', 'n': count(*) FILTER (s <= 0.025)}, {'le': '0.1', 'n': count(*) FILTER (s <= 0.1)}, {'le': '0.25', 'n': count(*) FILTER (s <= 0.25)}, {'le': '1.0', 'n': count(*) FILTER (s <= 1)}, {'le': '2.5', 'n': count(*) FILTER (s <= 2.5)}, {'le': '10.0', 'n': count(*) FILTER (s <= 10)}, {'le': '+Inf', 'n': count(*)}]) AS x FROM (SELECT value / 10 AS s FROM events)) t(x), LATERAL (SELECT x.le AS le, x.n AS n)")
def metrics_histogram(spark, d):
    return store.latency_histogram(read(spark, d, "events").withColumn("s", F.col("value") / 10), "s")


@query("SELECT event_type, strftime(ts, '%Y_%m') AS month, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def incident_months(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type", store.month_partition(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


@query("SELECT user_id, event_id AS last_event, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1")
def latest_by_tenant(spark, d):
    """Newest row of each tenant: an aggregate, no window."""
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.count(F.lit(1)).alias("n"))

