"""Text normalisation before inspection."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Invisible characters (soft hyphen, zero width, direction marks, joiners, byte order mark).
INVISIBLE = r"\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF"
#: Unicode's White_Space property.
WHITE = "\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_INVISIBLE = "[\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF]+"
#: Runs of white space other than one single space.
_RUN = f"(?: [{WHITE}]|[{WHITE.replace(chr(32), '')}])[{WHITE}]*"


def fold_array(texts: pa.Array) -> pa.Array:
    """NFKC of the texts that it changes: one call per text with other than ASCII characters.

    (Arrow's own utf8_normalize leaves letters decomposed, as of version 23.)
    """
    rows = np.flatnonzero(pc.invert(pc.fill_null(pc.string_is_ascii(texts), True)).to_numpy(zero_copy_only=False))
    held = zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist(), strict=True)
    told = {k: unicodedata.normalize("NFKC", t) for k, t in held if not unicodedata.is_normalized("NFKC", t)}
    if not told:
        return texts
    other = np.zeros(len(texts), bool)
    other[list(told)] = True
    return pc.replace_with_mask(texts, pa.array(other), pa.array(list(told.values()), texts.type))


def collapse_array(texts: pa.Array) -> pa.Array:
    """collapse() on an Arrow array."""
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, _INVISIBLE, ""), _RUN, " ")


def collapse_one(text: str) -> str:
    """NFKC and collapse() of one text."""
    if not text.isascii():
        text = re.sub(_INVISIBLE, "", unicodedata.normalize("NFKC", text))
    return re.sub(_RUN, " ", text)


def nfkc(x: Column) -> Column:
    """Compatibility composition.  Spark has no built-in for it, so texts take an Arrow trip."""

    def fold(texts: pa.Array) -> pa.Array:
        return fold_array(texts)

    return F.arrow_udf(fold, "string")(x)


def collapse(x: Column) -> Column:
    """Invisible characters go, then each run of white space becomes one space (never trimmed)."""
    return F.regexp_replace(F.regexp_replace(x, f"[{INVISIBLE}]", ""), r"(?U)\p{IsWhite_Space}+", " ")


def cut(x: Column, max_bytes: int) -> tuple[Column, Column]:
    """(text of at most max_bytes bytes, whether it was cut), at a character boundary."""
    over = F.octet_length(x) > max_bytes
    head = F.substring(x.cast("binary"), 1, max_bytes)
    # A character cut in its middle shows as one replacement character at the end.
    n = F.length(F.make_valid_utf8(head.cast("string")))
    whole = F.when(F.is_valid_utf8(head.cast("string")), n).otherwise(n - 1)
    return F.when(over, F.left(x, whole)).otherwise(x), over


def normalise(x: Column, *, max_bytes: int = 20 << 20, compose: bool = True) -> tuple[Column, Column]:
    return cut(collapse(nfkc(x) if compose else x), max_bytes)
