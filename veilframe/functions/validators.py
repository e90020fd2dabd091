"""Checks on candidate values, as Column builders (all JVM side).

Every builder takes a string Column and gives a boolean Column (or a number),
false for values that don't have the expected form, null for null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IBAN length by country (ISO 13616 registry, 28 countries).
IBAN_LENGTHS = {"AE": 23, "SA": 24, "QA": 29, "BH": 22, "KW": 30, "OM": 23, "GB": 22, "DE": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "CH": 21, "AT": 20, "IE": 22, "PT": 25, "PL": 28, "SE": 24, "NO": 15, "DK": 18, "FI": 18, "LU": 20, "TR": 26, "EG": 29, "JO": 30, "PK": 24, "LB": 28}

#: Fixed values: (first prefix, last prefix, lengths) of card networks.
CARD_RANGES = [
    ("4", "4", (13, 16, 19)),
    ("51", "55", (16,)),
    ("2221", "2720", (16,)),
    ("34", "34", (15,)),
    ("37", "37", (15,)),
    ("3528", "3589", (16, 17, 18, 19)),
    ("36", "36", (14, 15, 16, 17, 18, 19)),
    ("38", "38", (14, 15, 16, 17, 18, 19)),
    ("300", "305", (14, 15, 16, 17, 18, 19)),
    ("6011", "6011", (16, 17, 18, 19)),
    ("62", "62", (16, 17, 18, 19)),
    ("644", "649", (16, 17, 18, 19)),
    ("65", "65", (16, 17, 18, 19)),
]

#: The permutation row of Verhoeff's scheme (1969).
_VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order ten; 0-4 turns, 5-9 flips."""
    turn = (a % 5 + (b % 5 if a < 5 else -(b % 5))) % 5
    return turn + 5 * ((a >= 5) != (b >= 5))


def _verhoeff_tables() -> tuple[list[int], list[int]]:
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([_VERHOEFF_PERMUTATION[x] for x in rows[-1]])
    return [_dihedral(a, b) for a in range(10) for b in range(10)], [x for r in rows for x in r]


def bound(x: Column, told: Callable[[Column], Column]) -> Column:
    """``told(x)`` with ``x`` computed once: bodies of lambdas are spelt out, and nothing in them is shared."""
    return F.get(F.transform(F.array(x), told), F.lit(0))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", x) & (F.length(x) >= 2)


def card_network(d: Column) -> Column:
    """Do the leading digits and the length belong to a known network?"""
    tests = [F.substring(d, 1, len(lo)).between(lo, hi) & F.length(d).isin(*sizes) for lo, hi, sizes in CARD_RANGES]
    return reduce(lambda a, b: a | b, tests)


def card(x: Column) -> Column:
    d = digits(x)
    return F.length(d).between(13, 19) & card_network(d) & luhn(d)


def iban(x: Column) -> Column:
    s = F.translate(F.regexp_replace(x, r"(?U)\s", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    table = F.create_map(*[F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv])
    shape = s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), F.lit(48)).otherwise(F.lit(55))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(code(c) > 9, acc * 100 + code(c)).otherwise(acc * 10 + code(c)) % 97)
    fits = F.length(s) == F.element_at(table, F.substring(s, 1, 2))
    return F.when(shape & fits, rest == 1).otherwise(F.when(x.isNotNull(), F.lit(False)))


def verhoeff(d: Column) -> Column:
    """Check digit of a digit string, by one fold from the right."""
    product, perm = _verhoeff_tables()
    d_table, p_table = F.array(*map(F.lit, product)), F.array(*map(F.lit, perm))
    figures = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.get(p_table, (i % 8) * 10 + c.cast("int")))
    fold = F.aggregate(figures, F.lit(0), lambda c, n: F.get(d_table, c * 10 + n))
    return F.when(d.rlike("^[0-9]+$"), fold == 0).otherwise(F.when(d.isNotNull(), F.lit(False)))


def aadhaar(x: Column) -> Column:
    d = digits(x)
    return d.rlike("^[2-9][0-9]{11}$") & verhoeff(d)


def india_pan(x: Column) -> Column:
    return (F.octet_length(x) == 10) & F.substring(x, 4, 1).isin(*"PCHFATBLJG")


def emirates_id(x: Column) -> Column:
    d = digits(x)
    return d.rlike("^784[0-9]{12}$") & luhn(d)


def jwt(x: Column) -> Column:
    """Is the first segment base64url, padded or not, of a JSON object with an ``alg``?"""
    head = F.rtrim(F.substring_index(x, ".", 1), F.lit("="))
    padded = F.rpad(F.translate(head, "-_", "+/"), F.ceil(F.length(head) / 4).cast("int") * 4, "=")
    text = F.try_to_binary(padded, F.lit("base64"))
    told = F.try_variant_get(F.try_parse_json(F.when(F.is_valid_utf8(text.cast("string")), text.cast("string"))), "$.alg", "variant")
    return F.coalesce(head.rlike("^[A-Za-z0-9_-]+$") & told.isNotNull(), F.lit(False))


def entropy(x: Column) -> Column:
    """Shannon entropy in bits over the bytes of a string."""
    pairs = F.regexp_extract_all(F.hex(x), F.lit("(..)"), F.lit(1))
    n = F.octet_length(x)
    state = lambda byte, run, bits: F.struct(byte.alias("byte"), run.alias("run"), bits.alias("bits"))
    told = lambda a: F.when(a["run"] > 0, a["bits"] - a["run"] / n * F.log2(a["run"] / n)).otherwise(a["bits"])
    step = lambda a, c: F.when(a["byte"] == c, state(c, a["run"] + 1, a["bits"])).otherwise(state(c, F.lit(1), told(a)))
    # Equal bytes are neighbours, so one walk counts them all.
    return F.aggregate(F.sort_array(pairs), state(F.lit(""), F.lit(0), F.lit(0.0)), step, told)


#: Names that packs may use.
VALIDATORS = {"none": lambda x: F.lit(True), "luhn": luhn, "luhn_card": lambda x: bound(digits(x), card), "iban_mod97": iban, "verhoeff": lambda x: verhoeff(digits(x)), "aadhaar": aadhaar, "india_pan": india_pan, "emirates_id": emirates_id, "jwt": jwt}
