"""Names for SQL: register(spark) adds checks and masks as SQL functions, and the table function inspect_text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .validators import CARD_RANGES, IBAN_LENGTHS, _verhoeff_tables

MATCH = "detector string, start int, end int, value string, keyword boolean"


class InspectText:
    """inspect_text(text): a row per raw match of the built-in pack; offsets are bytes of the normalised text."""

    def __init__(self):
        from ..operators.inspect import Budget, scan_one
        from ..plans.packs import BUILTIN

        self.ids = [d.id for d in BUILTIN.detectors]
        self.run = scan_one(list(BUILTIN.detectors), Budget())

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            for m in self.run(text):
                yield self.ids[m["d"]], m["s"], m["e"], m["m"], m["k"]


def _bodies() -> dict[str, tuple[str, str, str]]:
    """(arguments, type, body) by name; later ones use earlier ones."""
    product, perm = _verhoeff_tables()
    array = lambda xs: f"array({', '.join(map(str, xs))})"
    network = " OR ".join(f"(substring(d, 1, {len(lo)}) BETWEEN '{lo}' AND '{hi}' AND length(d) IN ({', '.join(map(str, n))}))" for lo, hi, n in CARD_RANGES)
    lengths = "map(" + ", ".join(f"'{c}', {n}" for c, n in IBAN_LENGTHS.items()) + ")"
    upper = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    code = "(ascii(c) - IF(c RLIKE '[0-9]', 48, 55))"
    x, d, s = "x STRING", "d STRING", "s STRING"
    return {
        "only_digits": (x, "STRING", "regexp_replace(x, '[^0-9]', '')"),
        "luhn_ok": (x, "BOOLEAN", "luhn_check(x) AND length(x) >= 2"),
        "network_ok": (d, "BOOLEAN", network),
        "card_ok": (x, "BOOLEAN", "length(only_digits(x)) BETWEEN 13 AND 19 AND network_ok(only_digits(x)) AND luhn_ok(only_digits(x))"),
        "iban_solid_ok": (s, "BOOLEAN", f"s RLIKE '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$' AND coalesce(length(s) = {lengths}[substring(s, 1, 2)], false) AND aggregate(split(concat(substring(s, 5), substring(s, 1, 4)), ''), 0, (a, c) -> IF({code} > 9, a * 100 + {code}, a * 10 + {code}) % 97) = 1"),
        "iban_ok": (x, "BOOLEAN", f"iban_solid_ok({upper.format(chr(40) + 'regexp_replace(x, ' + chr(39) + '(?U)' + chr(92) * 2 + 's' + chr(39) + ', ' + chr(39) * 2 + ')' + chr(41))})"),
        "verhoeff_ok": (d, "BOOLEAN", f"d RLIKE '^[0-9]+$' AND aggregate(transform(split(reverse(d), ''), (c, i) -> get({array(perm)}, (i % 8) * 10 + try_cast(c AS INT))), 0, (a, n) -> get({array(product)}, a * 10 + n)) = 0"),
        "aadhaar_ok": (x, "BOOLEAN", "only_digits(x) RLIKE '^[2-9][0-9]{11}$' AND verhoeff_ok(only_digits(x))"),
        "pan_ok": (x, "BOOLEAN", "octet_length(x) = 10 AND substring(x, 4, 1) IN ('A', 'B', 'C', 'F', 'G', 'H', 'J', 'L', 'P', 'T')"),
        "emirates_id_ok": (x, "BOOLEAN", "only_digits(x) RLIKE '^784[0-9]{12}$' AND luhn_ok(only_digits(x))"),
        "base64url_text": (s, "STRING", "CAST(try_to_binary(rpad(translate(s, '-_', '+/'), CAST(ceil(length(s) / 4) AS INT) * 4, '='), 'base64') AS STRING)"),
        "jwt_ok": (x, "BOOLEAN", "coalesce(trim(TRAILING '=' FROM substring_index(x, '.', 1)) RLIKE '^[A-Za-z0-9_-]+$' AND try_variant_get(try_parse_json(base64url_text(trim(TRAILING '=' FROM substring_index(x, '.', 1)))), '$.alg', 'variant') IS NOT NULL, false)"),
        "entropy_bits": (x, "DOUBLE", "aggregate(sort_array(array_distinct(regexp_extract_all(hex(x), '(..)', 1))), 0D, (a, c) -> a - size(filter(regexp_extract_all(hex(x), '(..)', 1), y -> y = c)) / octet_length(x) * log2(size(filter(regexp_extract_all(hex(x), '(..)', 1), y -> y = c)) / octet_length(x)))"),
        "canonical_value": (x, "STRING", "translate(x, 'abcdefghijklmnopqrstuvwxyz -.', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"),
        "canonical_sha256": (x, "STRING", "sha2(canonical_value(x), 256)"),
        "distinct_key": (x, "STRING", "translate(x, ' -', '')"),
        "mask_card": (x, "STRING", "IF(length(only_digits(x)) < 13, repeat('*', length(only_digits(x))), concat(substring(only_digits(x), 1, 6), repeat('*', length(only_digits(x)) - 10), right(only_digits(x), 4)))"),
        "mask_partial": (x, "STRING", "CASE WHEN length(x) <= 6 THEN repeat('*', length(x)) ELSE concat(left(x, 2), repeat('*', length(x) - 4), right(x, 2)) END"),
        "mask_full": (x, "STRING", "concat('[', length(x), ' chars]')"),
        "mask_secret": (x, "STRING", "concat(left(x, least(4, CAST(floor(length(x) / 4) AS INT))), '…[', length(x), ' chars]')"),
        "value_ok": ("detector STRING, x STRING", "BOOLEAN", "CASE detector WHEN 'credit_card' THEN card_ok(x) WHEN 'iban' THEN iban_ok(x) WHEN 'jwt' THEN jwt_ok(x) WHEN 'uae_emirates_id' THEN emirates_id_ok(x) WHEN 'india_aadhaar' THEN aadhaar_ok(x) WHEN 'india_pan' THEN pan_ok(x) WHEN 'aws_secret_access_key' THEN entropy_bits(x) >= 4.0 ELSE true END"),
    }


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions, each a plain SQL expression, so that plans stay whole; and a Python table function."""
    bodies = _bodies()
    for name, (arguments, kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("inspect_text", F.udtf(InspectText, returnType=MATCH))
    return [*bodies, "inspect_text"]
