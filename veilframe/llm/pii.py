"""PII spans by weak supervision.

Candidate spans come from strict and from wide patterns.  Labelers of three sorts
vote yes, no or nothing on each: patterns (strict match, shape of the kind, what a
token touches), gazetteers (words that name the kind, in the line before it), and
context (what stands right before; check sums and randomness of the value).  The
counts of vote patterns over the whole corpus (at most 6 * 3^6 rows, whatever the
corpus) go to expectation-maximisation, which estimates each labeler's
reliability and a posterior for each pattern of votes.

The posteriors train the final span classifier, a logistic model that never sees
the votes: its features are the characters of the span (n-grams of classes,
length, randomness) and its neighbours (words before and behind, characters at
both ends), hashed to 2^13 places.  It is fitted on at most ``max_rows`` different
candidates of each kind, by hash; the bound is the only sample taken.  Strict
matches always stay; other candidates are added when the classifier gives them at
least ``threshold``; of those that overlap, the more probable ones, so that nothing
that is rejected stands in the way of another.  Patterns bound no length: they only
begin where a run of their characters begins and never give characters back, so
they are linear on any text.

The corpus is read once; the found candidates are written to the shared folder,
then counted, then classified.

Kinds: email, ip, card and phone (strict and wide), and secret (keys, tokens and
passwords) and iban (wide only).

Defined results: null text counts as empty; offsets are code points, end
exclusive; added spans never overlap a strict span or an earlier added one;
repeated rows each get their own row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "iban")
LABELERS = ("strict", "shape", "surroundings", "gazetteer", "context", "value")
PLACES = 1 << 13
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the start of a run of digits: the look-behind changes no match and keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Words that name a secret before its value.
_SECRET_WORDS = "password|passwd|passphrase|passwort|contraseña|pwd|secret|token|bearer|credential|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth[ _-]?key"
#: Wide patterns of candidates beside the strict ones: (kind, pattern, group of the span, what a text must hold).
_WIDE = [
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9._+-]{2,}+ ?[\[(] ?(?:at|AT|@) ?[\])] ?[A-Za-z0-9-]{2,}+(?: ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9-]{2,}+)+"), 0, re.compile(r"[\[(] ?(?:at|AT|@)")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), 0, re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), 0, re.compile("[A-Z]{2}[0-9]{2}")),
    ("secret", re.compile(rf"(?i)(?<![^\W_])(?:{_SECRET_WORDS})(?![^\W_])[\"']?\s{{0,3}}(?:[:=]|is\b)\s{{0,3}}[\"']?([^\s\"'<>,;]{{6,}}+)"), 1, re.compile("(?i)pass|secret|token|bearer|credential|key|contrase|pwd")),
    ("secret", re.compile(r"(?<![\w+/=.-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}(?![\w+/=-])"), 0, re.compile("[0-9]")),
    ("card", re.compile(r"(?<![0-9.])[0-9]{4}(?:[. /]{1,2}[0-9]{4}){3}(?![0-9.])"), 0, re.compile("[0-9]{4}")),
    ("phone", re.compile(r"(?<![\w+().-])(?:00[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"), 0, re.compile("[0-9]{3}")),
]
#: Words that name a kind of data, in the languages of the corpus.
_GAZETTEER = {
    "email": {"mail", "e-mail", "email", "emails", "mailto", "courriel", "correo", "adresse", "contact", "kontakt", "contacto", "write", "reply"},
    "ip": {"ip", "ipv4", "ipv6", "host", "hosts", "server", "serveur", "servidor", "gateway", "router", "client", "peer", "address", "adresse", "from", "ping", "login"},
    "card": {"card", "cards", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta", "credit", "debit", "paid", "payment", "expires", "cvv"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "appel", "appelez", "teléfono", "móvil", "sms", "whatsapp"},
    "secret": {"password", "passwd", "passphrase", "passwort", "contraseña", "secret", "token", "bearer", "key", "apikey", "api_key", "credential", "credentials", "authorization", "auth", "login", "aws_secret_access_key", "access_key", "private_key"},
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank", "banque", "banco", "bic", "swift", "transfer"},
}
#: Words before a value that is none of these kinds.
_AGAINST = {"version", "v", "release", "order", "invoice", "isbn", "issn", "doi", "build", "serial", "page", "pages", "figure", "table", "chapter", "section", "commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "uuid", "example", "ref", "sku", "lot"}
_WORDS = re.compile(r"[\w@.-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def randomness(s: str) -> float:
    """Bits a character, by the counts of its characters."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strict matches: leftmost, not overlapping within a kind."""
    if not text:
        return []
    out = []
    last = at = 0
    while (at := text.find("@", at)) >= 0:
        room = text[max(last, at - 4096) : at]
        run = len(room) - len(room.rstrip(_LOCAL))
        if run == len(room) and at - run > last:  # a very long run
            run = at - last - len(text[last:at].rstrip(_LOCAL))
        if run and (m := _DOMAIN.match(text, at)):
            out.append((at - run, "email", m.end()))
            last = at = m.end()
        else:
            at += 1
    for m in _IP.finditer(text):
        if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> list[int]:
    """Each labeler's vote on a span: 1 yes, -1 no, 0 nothing to say."""
    s = text[start:end]
    d = _digits(s)
    lead = text[max(0, start - 80) : start]
    before = [w.lower().strip(".-") for w in _WORDS.findall(lead)]
    near = before[-6:]
    if kind == "email":
        shape, value = (1 if re.search(r"[.\])][ ]?[A-Za-z]{2,24}$", s) else -1), (-1 if len(s) > 80 else 0)
    elif kind == "ip":
        octets = s.split(".")
        shape, value = (1 if ":" in s or len(octets) == 4 and all(x == str(int(x)) for x in octets) else -1), (-1 if s.startswith(("0.", "255.")) else 0)
    elif kind == "card":
        shape, value = (1 if len(d) in (15, 16) else 0), (1 if luhn(d) else -1)
    elif kind == "phone":
        shape, value = (1 if 10 <= len(d) <= 15 else -1), (-1 if len(set(d)) < 3 else 0)
    elif kind == "iban":
        shape, value = 0, (1 if iban_ok(s) else -1)
    else:
        classes = sum(bool(re.search(x, s)) for x in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        shape = 1 if len(s) >= 16 and classes >= 2 and d else -1 if classes == 1 or "://" in s else 0
        value = 1 if len(s) >= 16 and randomness(s) >= 3.2 else -1 if randomness(s) < 2.5 else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    inside = left.isalnum() or right.isalnum() or left in ("_", "/", "#", "&", "@") and left != ""
    assigned = bool(re.search(r"[:=]\s?[\"']?$", lead))
    context = -1 if _AGAINST & set(before[-2:]) else 1 if assigned or _GAZETTEER[kind] & set(before[-2:]) else 0
    return [1 if strict else 0, shape, -1 if inside else 0, 1 if _GAZETTEER[kind] & set(near) else 0, context, value]


_CLASSES = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\n", "a" * 26 + "A" * 26 + "0" * 10 + " ")


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of the span's characters and of its neighbours; the votes are not among them."""
    s = text[start:end]
    told = f"<{s.translate(_CLASSES)}>"
    out = {f"{kind}|{told[i : i + 3]}" for i in range(len(told) - 2)}
    runs = re.sub(r"(.)\1+", r"\1+", told)
    out |= {kind, f"{kind}~{runs}", f"{kind}#{min(len(s).bit_length(), 10)}", f"{kind}%{int(2 * randomness(s))}", f"{kind}^{len(set(s)) // 4}"}
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 60) : start])[-3:]]
    behind = [w.lower() for w in _WORDS.findall(text[end : end + 40])[:2]]
    out |= {f"{kind}-{w}" for w in before} | {f"{kind}-1{w}" for w in before[-1:]} | {f"{kind}+{w}" for w in behind}
    out |= {f"{kind}[{text[max(0, start - 1) : start].translate(_CLASSES)}", f"{kind}]{text[end : end + 1].translate(_CLASSES)}", f"{kind}={bool(re.search(r'[:=]' + chr(92) + 's?[^' + chr(92) + 'w' + chr(92) + 's]?$', text[max(0, start - 4) : start]))}"}
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % PLACES for x in out})


def candidates(text: str | None) -> list[dict]:
    """Strict spans, and wide candidates that don't overlap them (but may overlap each other), with votes and features."""
    base = base_spans(text)
    if not text:
        return []
    found = [(a, k, b, True) for a, k, b in base]
    starts, ends = [], []  # what is taken, as disjoint ranges in order
    for a, _, b in base:
        if starts and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    wide = set()
    for kind, pattern, group, quick in _WIDE:
        if not quick.search(text):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            k = bisect_right(starts, a)
            if not (k and ends[k - 1] > a or bisect_left(starts, b) > k):
                wide.add((a, kind, b))
    found += [(*x, False) for x in sorted(wide)]
    return [{"s": a, "k": k, "e": b, "base": own, "v": votes(text, k, a, b, own), "f": features(text, k, a, b)} for a, k, b, own in found]


_CANDS = pa.list_(pa.struct([("s", pa.int64()), ("k", pa.string()), ("e", pa.int64()), ("base", pa.bool_()), ("v", pa.list_(pa.int8())), ("f", pa.list_(pa.int16()))]))


def find_candidates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, cands."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [candidates(t) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _CANDS)], names=["id", "cands"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, cands array<struct<s:long,k:string,e:long,base:boolean,v:array<tinyint>,f:array<smallint>>>")


#: What each labeler is believed to do before any data: shares of no, nothing and yes on spans that are none, and on spans that are.
BELIEFS = {
    "strict": ((0.6, 0.3, 0.1), (0.1, 0.3, 0.6)),
    "shape": ((0.4, 0.35, 0.25), (0.15, 0.3, 0.55)),
    "surroundings": ((0.5, 0.45, 0.05), (0.02, 0.93, 0.05)),
    "gazetteer": ((0.1, 0.7, 0.2), (0.1, 0.4, 0.5)),
    "context": ((0.5, 0.4, 0.1), (0.02, 0.48, 0.5)),
    "value": ((0.4, 0.35, 0.25), (0.15, 0.3, 0.55)),
}
_ANY = ((0.6, 0.3, 0.1), (0.1, 0.3, 0.6))


def em(patterns: np.ndarray, weight: np.ndarray, kinds: np.ndarray, beliefs: list | None = None, steps: int = 60, belief: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the patterns and each labeler's P(vote | class); patterns: rows of votes.

    Each kind has reliabilities of its own, over a belief that weighs ``belief`` of its
    candidates: it tells the classes apart where a kind has one sort of candidates only.
    """
    n, labelers = patterns.shape
    seen = patterns + 1  # 0 no, 1 nothing, 2 yes
    told = np.array(beliefs or [_ANY] * labelers).transpose(1, 0, 2)
    places = np.arange(labelers)
    q = 1 / (1 + np.exp(-(np.log(told[1, places, seen]) - np.log(told[0, places, seen])).sum(1)))
    total = np.zeros((2, labelers, 3))
    for kind in sorted(set(kinds)):
        own = kinds == kind
        votes_, w, p = seen[own], weight[own], q[own]
        mass = max(2.0, belief * w.sum())
        for _ in range(steps):
            prior = (np.sum(w * p) + 1) / (w.sum() + 2)
            shares = np.empty((2, labelers, 3))
            for c, part in ((0, w * (1 - p)), (1, w * p)):
                for j in range(labelers):
                    counts = np.bincount(votes_[:, j], part, minlength=3) + mass * told[c, j]
                    shares[c, j] = counts / counts.sum()
            logit = np.full(len(p), np.log(prior) - np.log1p(-prior))
            for j in range(labelers):
                logit += np.log(shares[1, j, votes_[:, j]]) - np.log(shares[0, j, votes_[:, j]])
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        q[own] = p
        total += shares * w.sum()
    return q, total / weight.sum()


def posteriors(counts: list[tuple[str, list[int], int]]) -> tuple[dict, dict]:
    """(probability by (kind, votes), reliability by labeler) from counted vote patterns."""
    if not counts:
        return {}, {}
    kinds = np.array([k for k, _, _ in counts])
    q, tab = em(np.array([v for _, v, _ in counts], int), np.array([n for _, _, n in counts], float), kinds, [BELIEFS[x] for x in LABELERS])
    return {(k, tuple(v)): float(p) for (k, v, _), p in zip(counts, q, strict=True)}, {name: tab[:, j].tolist() for j, name in enumerate(LABELERS)}


def fit_classifier(rows: list[list[int]], q: np.ndarray, weight: np.ndarray, steps: int = 300, l2: float = 1e-5) -> np.ndarray:
    """Weights of the hashed features (the last one is the offset) from soft labels."""
    w = np.zeros(PLACES + 1)
    if not rows:
        return w
    flat = np.concatenate([np.array(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    own = np.sqrt(weight) / np.sqrt(weight).sum()  # a candidate that many copies hold must not drown the others
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[flat], len(rows)) + w[-1]
        err = own * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q)
        g = np.append(np.bincount(flat, err[row], PLACES), err.sum()) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def train(found: DataFrame, max_rows: int) -> tuple[np.ndarray, dict]:
    """The span classifier's weights and the labelers' reliabilities, from candidates (id, cands)."""
    each = found.select(F.explode("cands").alias("c")).select("c.k", "c.v", "c.f")
    votes_ = each.groupBy("k", "v").count().orderBy("k", "v").collect()
    post, reliability = posteriors([(r["k"], list(r["v"]), r["count"]) for r in votes_])
    kinds = table(each.groupBy("k", "v", "f").agg(F.count(F.lit(1)).alias("n")), "pii-kinds")
    sizes = {r["k"]: r["count"] for r in kinds.groupBy("k").count().collect()}
    if not sizes:
        return np.zeros(PLACES + 1), reliability
    rate = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(int(min(1.0, max_rows / n) * 1_000_003)))])
    rows = kinds.filter(F.pmod(F.xxhash64(F.lit(9), "k", "v", "f"), F.lit(1_000_003)) <= F.element_at(rate, F.col("k"))).orderBy("k", "v", "f").collect()
    q = np.array([post[r["k"], tuple(r["v"])] for r in rows])
    return fit_classifier([r["f"] for r in rows], q, np.array([r["n"] for r in rows], float)), reliability


def accepted(spans: list[dict], score: list[float], threshold: float) -> list[bool]:
    """Strict spans, and of the others those of at least ``threshold`` that overlap no more probable one (ties: the first, then the longest)."""
    stays = [s["base"] for s in spans]
    starts: list[int] = []
    ends: list[int] = []
    order = sorted((-score[i], s["start"], -s["end"], s["rank"], i) for i, s in enumerate(spans) if not s["base"] and score[i] >= threshold)
    for _, a, b, _, i in order:
        k = bisect_right(starts, a)
        if not (k and ends[k - 1] > a or bisect_left(starts, -b) > k):
            starts.insert(k, a)
            ends.insert(k, -b)
            stays[i] = True
    return stays


def find_pii(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.9, max_rows: int = 2000) -> DataFrame:
    """One row per document: ``id_col`` and spans, an array of (start, rank, kind, end, base, score) in order."""
    found = table(find_candidates(docs, text_col=text_col, id_col=id_col), "pii-candidates")
    weights, _ = train(found, max_rows)
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(held.value, np.float32)
        for batch in batches:
            score, stays = [], []
            for spans, f in zip(batch.column(0).field("spans").to_pylist(), batch.column(1).to_pylist(), strict=True):
                score.append([float(1 / (1 + np.exp(-np.clip(w[x].sum() + w[-1], -30, 30)))) for x in f])
                stays.append(accepted(spans, score[-1], threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.list_(pa.float64())), pa.array(stays, pa.list_(pa.bool_()))], names=["c", "score", "stays"])

    kinds = F.array(*[F.lit(k) for k in (*KINDS, *ADDED_KINDS)])
    plain = F.transform("cands", lambda c: F.struct(c["s"].alias("start"), F.array_position(kinds, c["k"]).alias("rank"), c["k"].alias("kind"), c["e"].alias("end"), c["base"].alias("base")))
    span = "struct<start:bigint,rank:bigint,kind:string,end:bigint,base:boolean>"
    kind = found.schema["id"].dataType.simpleString()
    src = found.select(F.struct("id", plain.alias("spans")).alias("c"), F.transform("cands", lambda c: c["f"]).alias("f"))
    scored = src.mapInArrow(run, f"c struct<id:{kind},spans:array<{span}>>, score array<double>, stays array<boolean>")
    both = F.zip_with("c.spans", "score", lambda c, p: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"), p.alias("score")))
    return scored.select(F.col("c.id").alias(id_col), F.sort_array(F.filter(both, lambda c, i: F.get("stays", i))).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    told = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    n = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(told(base), 256).alias("base_sha256"), told("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
