"""Masking of found values: what may be shown of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import digits


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_card(x: Column) -> Column:
    d = digits(x)
    n = F.length(d)
    return F.when(n < 13, _stars(n)).otherwise(F.concat(F.substring(d, 1, 6), _stars(n - 10), F.right(d, F.lit(4))))


def mask_secret(x: Column) -> Column:
    n = F.length(x)
    return F.concat(F.left(x, F.least(F.lit(4), F.floor(n / 4).cast("int"))), F.lit("…["), n.cast("string"), F.lit(" chars]"))


def mask_partial(x: Column) -> Column:
    n = F.length(x)
    return F.when(n <= 6, _stars(n)).otherwise(F.concat(F.left(x, F.lit(2)), _stars(n - 4), F.right(x, F.lit(2))))


def mask_full(x: Column) -> Column:
    return F.concat(F.lit("["), F.length(x).cast("string"), F.lit(" chars]"))


MASKS = {"card": mask_card, "secret": mask_secret, "partial": mask_partial, "full": mask_full}


def canonical(x: Column) -> Column:
    """Blank, dash and dot dropped, ASCII upper case."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(x, lower + " -.", upper)


def canonical_sha256(x: Column) -> Column:
    return F.sha2(canonical(x), 256)


def distinct_key(x: Column) -> Column:
    """Blank and dash dropped; case stays."""
    return F.translate(x, " -", "")
