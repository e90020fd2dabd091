"""Detector packs: data that says what to look for.

A pack is JSON or a Pack; its patterns run on RE2.  The built-in pack is put
together below from the public documents of each format.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from dataclasses import dataclass, field, fields

import pyarrow as pa
import pyarrow.compute as pc

from ..functions.masks import MASKS
from ..functions.validators import IBAN_LENGTHS, VALIDATORS, _verhoeff_tables

LEVELS = ("low", "medium", "high")


class PackError(ValueError):
    """A pack that can't be used."""


@dataclass(frozen=True)
class Detector:
    id: str
    name: str
    category: str
    pattern: str
    validator: str = "none"
    keywords: tuple[str, ...] = ()
    proximity: int = 64
    require_keyword: bool = False
    base_confidence: str = "medium"
    keyword_confidence: str = "high"
    min_entropy: float | None = None
    test_values: tuple[str, ...] = ()
    mask: str = "partial"
    tests: dict = field(default_factory=dict, hash=False)
    #: "re2": linear whatever the pattern, so the only choice for packs that are loaded; "re": vetted patterns.
    engine: str = "re2"
    hint: str | None = None

    def __post_init__(self):
        if self.validator not in VALIDATORS:
            raise PackError(f"{self.id}: no validator {self.validator}")
        if self.mask not in MASKS:
            raise PackError(f"{self.id}: no mask {self.mask}")
        if {self.base_confidence, self.keyword_confidence} - set(LEVELS):
            raise PackError(f"{self.id}: confidences are {', '.join(LEVELS)}")
        if self.require_keyword and not self.keywords:
            raise PackError(f"{self.id}: require_keyword needs keywords")
        if len(self.pattern) > 4096:
            raise PackError(f"{self.id}: the pattern is too long")
        for v in self.test_values:
            if v.startswith("sha256:") and not re.fullmatch("[0-9a-fA-F]{64}", v[7:]):
                raise PackError(f"{self.id}: sha256: needs 64 hexadecimal digits")
        for p in (self.pattern if self.engine == "re2" else None, self.hint):
            if p is not None:
                try:  # RE2 refuses what it can't run in linear time, or in little memory
                    pc.match_substring_regex(pa.array(["x"]), p)
                except pa.ArrowInvalid as e:
                    raise PackError(f"{self.id}: {e}") from e

    @property
    def ranks(self) -> tuple[int, int]:
        return LEVELS.index(self.base_confidence), LEVELS.index(self.keyword_confidence)

    def known_tests(self) -> tuple[set[str], set[str]]:
        """Canonical plain values, and SHA-256 of canonical values, that count as dummies."""
        plain, hashed = set(), set()
        for v in self.test_values:
            if v.startswith("sha256:"):
                hashed.add(v[7:].lower())
            else:
                plain.add(canonical_value(decoded(v)))
        return plain, hashed


@dataclass(frozen=True)
class Pack:
    pack: str
    version: str
    detectors: tuple[Detector, ...]

    @property
    def label(self) -> str:
        return f"{self.pack}@{self.version}"


def canonical_value(s: str) -> str:
    return re.sub("[a-z]", lambda m: m[0].upper(), re.sub("[ .-]", "", s))


def decoded(value: str) -> str:
    """A vector's plain value; ``b64:`` keeps credential shapes out of files."""
    return base64.b64decode(value[4:], validate=True).decode() if value.startswith("b64:") else value


def load_pack(doc: str | dict) -> Pack:
    doc = json.loads(doc) if isinstance(doc, str) else doc
    if unknown := set(doc) - {"pack", "version", "detectors"}:
        raise PackError(f"unknown fields {sorted(unknown)}")
    known = {f.name for f in fields(Detector)} - {"engine", "hint"}
    out = []
    for d in doc["detectors"]:
        if unknown := set(d) - known:
            raise PackError(f"{d.get('id')}: unknown fields {sorted(unknown)}")
        try:
            out.append(Detector(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}))
        except TypeError as e:
            raise PackError(str(e)) from e
    return Pack(doc["pack"], doc["version"], tuple(out))


def merge(packs: list[Pack]) -> list[Detector]:
    """All detectors, in pack order; an id may come once."""
    out: dict[str, Detector] = {}
    for p in packs:
        for d in p.detectors:
            if d.id in out:
                raise PackError(f"detector {d.id} comes twice")
            out[d.id] = d
    return list(out.values())


# ------------------------------------------------------------ the built-in pack
#
# Each pattern is put together from what the public document of its format says:
# parts, lengths, alphabets.  ``alone`` keeps a match from touching a letter or digit.

B64, B64URL, ALNUM = "A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"


def alone(pattern: str, first: str = "") -> str:
    """``first``: the class of one character that the pattern, no alternatives, begins with and that \\w covers.  Put before the look behind, it lets the matcher skip to the next such character; else it tries every place of a text."""
    if first and pattern.startswith(first):
        return rf"{first}(?<!\w{first})(?:{pattern[len(first):]})(?!\w)"
    return rf"(?<!\w)(?:{pattern})(?!\w)"


def some_of(chars: str, least: int, most: int | None = None) -> str:
    return f"[{chars}]{{{least}}}" if most == least else f"[{chars}]{{{least},{'' if most is None else most}}}"


def any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def spaced_digits(least: int, most: int, between: str) -> str:
    """So many digits, with at most one separator after each."""
    return rf"\d(?:[{between}]?\d){{{least - 1},{most - 1}}}"


def iban_shape() -> str:
    """ISO 13616: country, two check digits, and as many characters as the registry says for the country; in one piece or in fours."""
    by_length: dict[int, list[str]] = {}
    for country, n in sorted(IBAN_LENGTHS.items()):
        by_length.setdefault(n, []).append(country)
    kinds = []
    for n, countries in sorted(by_length.items()):
        fours, rest = divmod(n - 4, 4)
        grouped = "(?: [A-Z0-9]{4})" + f"{{{fours}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
        kinds.append(f"(?:{'|'.join(countries)})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|{grouped})")
    return "|".join(kinds)


def synthetic(prefix: str, chars: str, n: int) -> str:
    """A test value in the shape of a credential, made when it is needed; it opens nothing."""
    stream = b"".join(hashlib.sha256(f"{prefix}{k}".encode()).digest() for k in range(-(-n // 32)))
    return prefix + "".join(chars[b % len(chars)] for b in stream[:n])


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + "0123456789"


def _web_token(head: dict) -> str:
    told = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return f"{told(head)}.{told({'sub': 'someone'})}.{synthetic('', _LETTERS, 43)}"


# Fixed values.  They decide what is found and how sure it is, so they must be these for
# equal results: dummy values, keywords, prefixes, labels, schemes, distances and bounds.

#: Card numbers that payment providers publish for tests.
TEST_CARDS = ("4111111111111111", "4242424242424242", "5555555555554444", "5105105105105100", "378282246310005", "371449635398431", "6011111111111117", "4012888888881881")
#: Account numbers that the ISO 13616 registry gives as examples.
TEST_ACCOUNTS = ("GB82WEST12345698765432", "DE89370400440532013000")
#: SHA-256 of the canonical example credentials in the provider's documents.
EXAMPLE_KEY_ID = "sha256:1a5d44a2dca19669d72edf4c4f1c27c4c1ca4b4408fbb17f6ce4ad452d78ddb3"
EXAMPLE_SECRET = "sha256:d0a726447116af35f6f8352de2d65b450ce056f8d8a59dadd888374cb4856379"
#: Words that raise the confidence in a value near by.
KEYWORDS = {
    "credit_card": ("card", "credit", "debit", "visa", "mastercard", "amex", "cvv", "expiry", "payment"),
    "iban": ("iban", "account", "bank", "beneficiary", "transfer"),
    "aws_secret_access_key": ("aws_secret", "secret_access_key", "aws secret", "secretaccesskey"),
    "email_address": ("email", "e-mail", "contact", "mailto"),
    "uae_emirates_id": ("emirates id", "eid", "identity card", "id number", "هوية"),
    "india_aadhaar": ("aadhaar", "aadhar", "uidai", "आधार"),
    "india_pan": ("pan", "permanent account", "income tax"),
}
#: Bytes to a keyword, where they are not the default.
PROXIMITY = {"aws_secret_access_key": 48, "india_pan": 32}
SECRET_ENTROPY = 4.0
KEY_ID_PREFIXES = ("AKIA", "ASIA", "AIDA", "AROA")
#: RFC 7468 and the formats of two programs.
KEY_LABELS = ("PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK")
HOST_TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
SCHEMES = ("postgres", "postgresql", "mysql", "mongodb", "mongodb+srv", "redis", "amqp", "amqps", "mssql")
#: RFC 5321 in short (the characters beside letters and digits are fixed): a run of local characters, labels without a dash at their ends, a last label of letters.
_LOCAL = f"{ALNUM}._%+-"
_DOMAIN = rf"(?:[{ALNUM}]++(?:-++[{ALNUM}]++)*+\.)+[A-Za-z]{{2,}}(?!\w)"
EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]++@{_DOMAIN}"
HOST_TOKEN = f"{any_of(HOST_TOKEN_PREFIXES)}{some_of(ALNUM, 36, 36)}|github_pat_{some_of(ALNUM, 22, 22)}_{some_of(ALNUM, 59, 59)}"
WEB_TOKEN = f"eyJ{some_of(B64URL, 12)}\\.{some_of(B64URL, 2)}\\.{some_of(B64URL, 8)}"
ADDRESS = rf"{any_of(SCHEMES)}://[^\s:/@]+:[^\s/@]+@[^\s/?#]+"
KEY_HEADER = f"-----BEGIN {any_of(KEY_LABELS)}-----"




# Test vectors are made by the check digits of each format, when they are needed.


def luhn_number(head: str) -> str:
    """The digits with their Luhn check digit behind."""
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(head)))
    return head + str(-total % 10)


def verhoeff_number(head: str) -> str:
    product, perm = _verhoeff_tables()

    def fold(number: str) -> int:
        c = 0
        for k, x in enumerate(reversed(number)):
            c = product[10 * c + perm[k % 8 * 10 + int(x)]]
        return c

    return next(head + str(x) for x in range(10) if fold(head + str(x)) == 0)


def iban_number(country: str, account: str) -> str:
    told = int("".join(str(int(c, 36)) for c in f"{account}{country}00"))
    return f"{country}{98 - told % 97:02d}{account}"


def wrong_digit(number: str, at: int = -1) -> str:
    """The same with one digit raised, which every check digit notices."""
    at %= len(number)
    return number[:at] + str((int(number[at]) + 1) % 10) + number[at + 1 :]


def in_groups(number: str, *sizes: int, by: str = " ") -> str:
    out, at = [], 0
    for n in sizes:
        out.append(number[at : at + n])
        at += n
    return by.join(out)


_VISA, _MC, _JCB = luhn_number("402400" + "7" * 9), luhn_number("222300" + "31" * 4 + "4"), luhn_number("3566" + "20" * 5 + "5")
_GULF, _SAUDI = iban_number("AE", "033" + "7" * 16), iban_number("SA", "80" + "123456" * 3)
_EID, _UID = luhn_number("7841990" + "2468135"), verhoeff_number("29384756102")

#: What the built-in pack looks for: id, name, category, pattern, hint, and what differs from the defaults.
_BUILTIN = [
    ("credit_card", "Payment card", "pci", alone(spaced_digits(13, 19, " -"), r"\d"), r"\p{Nd}(?:[ -]?\p{Nd}){12}", {"validator": "luhn_card", "mask": "card", "test_values": TEST_CARDS}, (in_groups(_VISA, 4, 4, 4, 4), in_groups(_MC, 4, 4, 4, 4, by="-"), _JCB), (wrong_digit(_VISA), "9" * 16, _VISA[:12], *TEST_CARDS[:2])),
    ("iban", "Bank account (IBAN)", "financial", alone(iban_shape()), "[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}", {"validator": "iban_mod97", "test_values": TEST_ACCOUNTS}, (_GULF, in_groups(_SAUDI, 4, 4, 4, 4, 4, 4)), (wrong_digit(_GULF), "XX" + _GULF[2:], TEST_ACCOUNTS[0])),
    ("aws_access_key_id", "Cloud access key id", "credentials", alone(any_of(KEY_ID_PREFIXES) + some_of("A-Z0-9", 16, 16)), f"{any_of(KEY_ID_PREFIXES)}[A-Z0-9]{{16}}", {"base_confidence": "high", "mask": "secret", "test_values": (EXAMPLE_KEY_ID,)}, tuple(synthetic(x, _UPPER, 16) for x in KEY_ID_PREFIXES), (synthetic("AKIA", _UPPER, 15), synthetic("XKIA", _UPPER, 16))),
    ("aws_secret_access_key", "Cloud secret key", "credentials", some_of(B64, 40, 40), some_of(B64, 40, 40), {"require_keyword": True, "base_confidence": "high", "min_entropy": SECRET_ENTROPY, "mask": "secret", "test_values": (EXAMPLE_SECRET,)}, ("aws_secret=" + synthetic("", _LETTERS, 40),), (synthetic("", _LETTERS, 40), "aws_secret=" + "ab" * 20)),
    ("private_key", "Private key header", "credentials", KEY_HEADER, KEY_HEADER, {"base_confidence": "high", "mask": "full"}, tuple("-----BEGIN " + x + "-----" for x in KEY_LABELS), ("-----BEGIN CERTIFICATE-----", "-----BEGIN PUBLIC KEY-----")),
    ("jwt", "JSON web token", "credentials", rf"(?<!\w){WEB_TOKEN}", WEB_TOKEN, {"validator": "jwt", "base_confidence": "high", "mask": "secret"}, (_web_token({"alg": "HS256", "typ": "JWT"}),), (_web_token({"typ": "JWT", "kid": "12345678"}), "eyJ.eyJ.abc")),
    ("github_token", "Source host token", "credentials", alone(HOST_TOKEN), HOST_TOKEN, {"base_confidence": "high", "mask": "secret"}, (*(synthetic(x, _LETTERS, 36) for x in HOST_TOKEN_PREFIXES), synthetic("github_pat_", _LETTERS, 22) + synthetic("_", _LETTERS, 59)), (synthetic("ghp_", _LETTERS, 35), synthetic("ghx_", _LETTERS, 36))),
    ("db_connection_string", "Database address with password", "credentials", rf"(?<!\w){ADDRESS}", "://", {"base_confidence": "high", "mask": "secret"}, tuple(f"{x}://joe:{synthetic('', _LETTERS, 9)}@db.example/x" for x in SCHEMES), ("postgres://db.example/x", "postgres://joe@db.example/x", "https://joe:pw@db.example")),
    ("email_address", "E-mail address", "pii", EMAIL, "@", {"base_confidence": "low", "keyword_confidence": "medium"}, ("e-mail: jane.roe@example.org", "contact a_b+c@mail.example.co"), ("jane.roe@example.org", "email jane@", "email @example.org")),
    ("uae_emirates_id", "UAE identity number", "pii", alone(r"-?".join(["784", r"\d{4}", r"\d{7}", r"\d"])), r"784-?\p{Nd}{4}", {"validator": "emirates_id"}, (in_groups(_EID, 3, 4, 7, 1, by="-"), _EID), (in_groups(wrong_digit(_EID), 3, 4, 7, 1, by="-"), luhn_number("785" + _EID[3:14]))),
    ("india_aadhaar", "India Aadhaar", "pii", alone(r"[ -]?".join([r"[2-9]\d{3}", r"\d{4}", r"\d{4}"]), "[2-9]"), r"[2-9]\p{Nd}{3}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}", {"validator": "aadhaar", "base_confidence": "low"}, ("aadhaar " + in_groups(_UID, 4, 4, 4),), (in_groups(_UID, 4, 4, 4), "aadhaar " + wrong_digit(_UID), "aadhaar " + verhoeff_number("1" + _UID[1:11]))),
    ("india_pan", "India tax number", "pii", alone("[A-Z][A-Z]{4}[0-9]{4}[A-Z]", "[A-Z]"), "[A-Z]{5}[0-9]{4}[A-Z]", {"validator": "india_pan", "base_confidence": "low"}, ("PAN: ABCPK1234Q",), ("ref ABCPK1234Q", "PAN: ABCXK1234Q")),
]


def _builtin(i: str, name: str, category: str, pattern: str, hint: str, more: dict, match: tuple, no_match: tuple) -> Detector:
    near = {"proximity": PROXIMITY[i]} if i in PROXIMITY else {}
    return Detector(id=i, name=name, category=category, pattern=pattern, hint=hint, engine="re", keywords=KEYWORDS.get(i, ()), tests={"match": match, "no_match": no_match}, **near, **more)


#: Vetted patterns: linear on any text, so they run on Python's matcher; ``hint`` is a cheap test in RE2 that every match passes.
BUILTIN = Pack("builtin", "1.0.0", tuple(_builtin(*x) for x in _BUILTIN))
