"""Scan of lines for credential shapes.

Most texts hold none, so a text is split into lines only if one cheap pattern, the
alternatives of what every shape begins with, is somewhere in it, and lines are
tested against the shapes only if it is in them.  The shapes are put together from
the parts of the detector pack; word edges are those of ASCII, as in SQL engines.

A published example credential is found wherever it stands: in the line itself, or
in what a base64 test vector of the line (``b64:``) decodes to.  Only values of the
two lengths that published examples have are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.masks import canonical_sha256
from ..plans.packs import ADDRESS, B64, EXAMPLE_KEY_ID, EXAMPLE_SECRET, HOST_TOKEN, HOST_TOKEN_PREFIXES, KEY_HEADER, KEY_ID_PREFIXES, WEB_TOKEN, any_of, some_of

#: Published prefixes of a chat service's tokens.
CHAT_PREFIXES = ("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-")
_KEY_ID = any_of(KEY_ID_PREFIXES) + some_of("A-Z0-9", 16, 16)
#: (pattern, whether a word edge must stand before and behind it), by name.
SHAPES = {
    "cloud_key_id": (_KEY_ID, True, True),
    "web_token": (WEB_TOKEN, True, False),
    "source_host_token": (f"(?:{HOST_TOKEN})", True, True),
    "chat_token": (any_of(CHAT_PREFIXES) + some_of("A-Za-z0-9-", 10), True, False),
    "private_key_block": (KEY_HEADER, False, False),
    "address_with_password": (ADDRESS, True, False),
}
#: A run of exactly 40 base64 characters that no padding follows, and what must be named on its line.
BARE_KEY = f"(?<![{B64}]){some_of(B64, 40, 40)}(?![{B64}=])"
PROVIDER = "(?i)aws|secret[_ ]?access"
_VECTOR = "b64:"
#: Every finding's line holds one of these.
HINT = "|".join([any_of((*KEY_ID_PREFIXES, *HOST_TOKEN_PREFIXES, *CHAT_PREFIXES, "eyJ", "github_pat_", "-----BEGIN ", "://", _VECTOR)), some_of(B64, 40, 40)])
#: Digests of the canonical form of published example credentials.
PUBLISHED = (EXAMPLE_KEY_ID.removeprefix("sha256:"), EXAMPLE_SECRET.removeprefix("sha256:"))


def shape(name: str, edge_before: str = "(?<![A-Za-z0-9_])", edge_behind: str = "(?![A-Za-z0-9_])") -> str:
    pattern, before, behind = SHAPES[name]
    return (edge_before if before else "") + pattern + (edge_behind if behind else "")


def _all(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def holds_published(s: Column) -> Column:
    """Is a value of the text a published example credential?"""
    return F.exists(F.concat(_all(s, shape("cloud_key_id")), _all(s, BARE_KEY)), lambda x: canonical_sha256(x).isin(*PUBLISHED))


def vectors(s: Column) -> Column:
    """The plain values of the line's base64 test vectors; what is no base64 or no text is left out."""
    told = F.transform(_all(s, f"{_VECTOR}([{B64}]+={{0,2}})", 1), lambda x: F.try_to_binary(x, F.lit("base64")))
    return F.transform(F.filter(told, lambda x: x.isNotNull() & F.is_valid_utf8(x.cast("string"))), lambda x: x.cast("string"))


def scan_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, finding): each line's shapes; a bare 40-character key needs its provider named on the line."""
    some = df.filter(F.col(text_col).rlike(HINT)).select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "s"))
    some = some.filter(F.col("s").rlike(HINT)).withColumn("line", F.col("line") + 1)
    s = F.col("s")
    bare = s.rlike(PROVIDER) & F.exists(_all(s, BARE_KEY), lambda x: x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[0-9]"))
    published = holds_published(s) | F.when(s.contains(_VECTOR), F.exists(vectors(s), holds_published)).otherwise(F.lit(False))
    found = [F.when(s.rlike(shape(name)), F.lit(name)) for name in SHAPES]
    found += [F.when(bare, F.lit("bare_secret_key")), F.when(published, F.lit("published_example"))]
    return some.select(id_col, "line", F.explode(F.array_compact(F.array(*found))).alias("finding"))
