"""Operators that map each document: brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import chat, contamination, licenses, pii, quality_pu, rules, tokens

WORD10 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# ------------------------------------------------------------ decontamination


def brute10(docs, items, window):
    norm = lambda t: WORD10.findall((t or "").translate(FOLD))
    wins = []
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.append((str(i), w[k : k + window]))
    out = []
    for d, t in docs:
        w, hit, ids = norm(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    ids.add(i)
        out.append((d, len(w), len(hit), len(ids), sorted(ids)))
    return out


@pytest.mark.parametrize("block_chars", [4_000_000, 60])
def test_contamination(spark, block_chars):
    r = random.Random(3)
    vocab = ["a", "B", "é", "x1", "日本", "q"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 5, 9])))) for i in range(12)] + [(3, None), (20, "!!"), (21, "a, B; a")]
    docs = [(k, "".join(x + r.choice([" ", ", ", "\n"]) for x in r.choices(vocab, k=r.randint(0, 40)))) for k in range(40)] + [(41, None), (41, ""), (42, "A b A")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, hits int")
    got = contamination.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), window=5, block_chars=block_chars).collect()
    key = lambda x: (x[0], x[1], x[2])
    assert sorted([(g["doc_id"], g["n_words"], g["n_hit"], len(g["items"]), sorted(g["items"])) for g in got], key=key) == sorted(brute10(docs, items, 5), key=key)
    for g in got:  # offsets are those of the original text
        text = dict(docs)[g["doc_id"]] if g["doc_id"] != 41 else ""
        for a, b in zip(g["spans"][::2], g["spans"][1::2], strict=True):
            assert WORD10.fullmatch(text[a].translate(FOLD)) and WORD10.fullmatch(text[b - 1].translate(FOLD))


def test_contamination_memory():
    """A benchmark of 4 million characters: its automaton and tables stay under 300 MB."""
    import subprocess
    import sys

    told = """
import random, resource
from veilframe.llm.contamination import Windows
r = random.Random(1)
vocab = [f"w{i}".encode() for i in range(60000)]
parts = [b" ".join(r.choices(vocab, k=400)) for _ in range(4_000_000 // 2500)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
x = Windows([str(k) for k in range(len(parts))], parts, 13)
n, hits, items = x.scan((b"before it " + parts[7][:300] + b" after").decode())
assert items == {"7"} and hits[0] == 2, (hits, items)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1000)
"""
    mb = float(subprocess.run([sys.executable, "-c", told], capture_output=True, text=True, check=True).stdout)
    assert mb < 300, mb


def test_contamination_long_items(spark, monkeypatch):
    """Items longer than a part; many items with one window; a short item that is also a stretch of another."""
    monkeypatch.setattr(contamination, "PART_WORDS", 9)
    r = random.Random(5)
    long = [f"v{r.randrange(30)}" for _ in range(60)]
    items = [(1, " ".join(long)), (2, " ".join(long[10:40])), (3, " ".join(long[:3])), (4, " ".join(long[:5])), (4, "x " + " ".join(long[20:26]))]
    docs = [(k, " ".join(long[a : a + n])) for k, (a, n) in enumerate([(0, 60), (3, 12), (17, 5), (17, 4), (0, 3), (22, 30)])]
    got = contamination.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5).collect()
    assert sorted((g["doc_id"], g["n_words"], g["n_hit"], len(g["items"]), sorted(g["items"])) for g in got) == sorted(brute10(docs, items, 5))


def test_contamination_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = [d for k, d in enumerate(docs) if k % 8 == 0]
    rows = {r["doc_id"]: r for r in contamination.op10_decontamination(spark, sf).collect()}
    assert len(rows) == len(docs)
    for d, n, hit, k, ids in brute10(some, items, 13):
        r = rows[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, k, hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= n)


def test_contamination_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert contamination.find_contamination(none, items).count() == 0
    assert contamination.find_contamination(spark.createDataFrame([(None, "a b")], none.schema), items).first()["n_words"] == 2


# ------------------------------------------------------------------- tokens


def token_texts():
    r = random.Random(1)
    texts = ["Hello world", "  two  spaces\n\nand lines", "naïve café größer", "日本語 text 𝄞", "a" * 300, "x", "1234567 89", "¿Qué?", " " * 37 + "x" + " " * 16, "\t\t\n", "𝄞𝄞 𝄞", "aaab" * 50]
    texts += ["".join(r.choices("abcde fghi éß.,", k=80)) for _ in range(100)]
    return texts + ["".join(r.choices(["the", "ing", "er", " ", "tion", "a", "s", "qu", "\n", "Ü", "ß"], k=60)) for _ in range(200)]


def test_bpe_ids_are_those_of_the_library():
    import pyarrow.parquet as pq
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.default_model())
    seg = tokens.Segmenter(tokens.load_model(tokens.default_model()))
    texts = token_texts() + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for t in texts:
        ids = seg.encode(t).tolist()
        assert ids == sp.encode(t), t[:80]
        assert seg.decode(ids) == t


def test_unigram_ids_are_those_of_the_library():
    """The same pieces as a unigram model with log-probabilities."""
    import math

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(open(tokens.default_model(), "rb").read())
    proto.trainer_spec.model_type = tokens.UNIGRAM
    for k, p in enumerate(proto.pieces):
        if p.type == 1:
            p.score = -math.log(2.0 + (k * 7919 % 32003)) - 3
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    seg = tokens.Segmenter(tokens.read_model(proto))
    total = lambda ids: sum(proto.pieces[i].score for i in ids if proto.pieces[i].type == 1)
    same = 0
    for t in token_texts():
        ids, theirs = seg.encode(t).tolist(), sp.encode(t)
        # Segmentations of one sum: the library adds in 32 bits, so either may win.
        assert ids == theirs or total(ids) == pytest.approx(total(theirs), rel=1e-6), t
        same += ids == theirs
        assert seg.decode(ids) == t
    assert same >= 0.97 * len(token_texts())


def test_models_that_change_texts_are_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.trainer_spec, "treat_whitespace_as_suffix", True), lambda m: setattr(m.pieces[400], "type", 4), lambda m: setattr(m.trainer_spec, "model_type", 4)):
        proto = pb.ModelProto.FromString(open(tokens.default_model(), "rb").read())
        change(proto)
        with pytest.raises(ValueError):
            tokens.read_model(proto)


def test_tokens_round_trip(spark, sf):
    rows = [(1, None), (2, ""), (3, " ▁ literal ▁mark"), (4, "\x00\x01 bytes"), (None, "z" * 5000), (4, "\x00\x01 bytes")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, ids int")
    out = tokens.encode(df, tokens.default_model())
    assert all(r["round_trip"] in (True, None) for r in out.collect())
    back = tokens.decode(out, tokens.default_model()).collect()
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in back])) == sorted(map(str, rows))
    assert tokens.op4_sentencepiece(spark, sf).filter("NOT round_trip OR round_trip IS NULL").count() == 0
    assert tokens.encode(df.limit(0), tokens.default_model()).count() == 0


# ------------------------------------------------------------------ quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_pu.op2_quality(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = out.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 100_000), (1, None)], "doc_id long, text string")
    model = quality_pu.fit(df, spark.createDataFrame([], "doc_id long"))
    assert [r["score"] for r in quality_pu.score(df, model).collect()] == [0.5] * 4
    assert quality_pu.score(df.limit(0), model).count() == 0


def test_features_do_not_depend_on_batches():
    r = random.Random(2)
    texts = [None, "", "a"] + ["".join(r.choices("ab C1!|#\n ", k=r.randint(0, 600))) for _ in range(600)]
    whole = quality_pu.features(pa.array(texts))
    one = np.vstack([quality_pu.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, one)


def test_prior_and_non_negative_risk():
    g = np.random.default_rng(1)
    p = g.normal(2, 1, (2000, 3))
    u = np.vstack([g.normal(2, 1, (1400, 3)), g.normal(-2, 1, (600, 3))])
    model = quality_pu.fit_arrays(p, u)
    assert 0.6 < model["prior"] < 0.8
    assert np.mean(quality_pu.apply_arrays(model, g.normal(-2, 1, (500, 3))) < 0.3) > 0.97


# --------------------------------------------------------------------- rules


def test_rules_remove_frequent_lines(spark):
    name = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    body = lambda k: " ".join(f"w{name(k)}x{j}" for j in range(60))
    rows = [(k, f"{body(k)}\nBuy  Now {k}!", "h1") for k in range(12)]
    rows += [(100 + k, "\n".join([" ".join(f"same{j}" for j in range(60)), body(k)[:40]]), "h2") for k in range(12)]
    rows += [(200, body(200) + "\nbuy now 1!", "h3"), (201, None, None), (202, "", "h1"), (203, body(203), None)]
    df = spark.createDataFrame([(a, b, c, True) for a, b, c in rows], "doc_id long, text string, source string, kept boolean")
    out = {r["doc_id"]: r for r in rules.apply_rules(df).collect()}
    assert len(out) == len(rows)
    # Digits count as 0: ten texts have "buy now 0!", two have "buy now 00!".  The long lines of h1 have different words.
    assert [(out[k]["n_removed_lines"], out[k]["kept"]) for k in range(12)] == [(1, True)] * 10 + [(0, True)] * 2
    assert all(out[100 + k]["n_removed_words"] == 60 and not out[100 + k]["kept"] and not out[100 + k]["base_failed"] for k in range(12))
    assert out[200]["kept"] and out[203]["kept"] and out[201]["base_failed"] and not out[202]["kept"]
    copies = spark.createDataFrame([(k, body(1), "h") for k in range(30)], "doc_id long, text string, source string")
    # Documents are counted, not texts: the lines of 30 copies stand in 30 documents; of 8, in too few.
    assert not any(r["kept"] for r in rules.apply_rules(copies).collect())
    assert all(r["kept"] for r in rules.apply_rules(copies.filter("doc_id < 8")).collect())
    assert all(r["kept"] for r in rules.apply_rules(copies, share=1.0).collect())
    assert rules.apply_rules(copies.limit(0)).count() == 0


def test_repeat_words(spark):
    texts = ["a b c a b c", "a a a a", "a b", "x y z w x y", "", "a b c d a b c e a b c"]

    def brute(t):
        w = t.split()
        seen = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({j for i, s in enumerate(seen) if seen.count(s) > 1 for j in range(i, i + 3)})

    df = spark.createDataFrame([(t, "h", k) for k, t in enumerate(texts)], "text string, source string, doc_id int")
    assert {r["doc_id"]: r["n_repeat_words"] for r in rules.apply_rules(df).collect()} == {k: brute(t) for k, t in enumerate(texts)}


# ------------------------------------------------------------------ licences


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ,")), (2, "intro\nReleased under the MIT Licence!\nRELEASED UNDER THE MIT LICENSE\nAll rights  reserved"), (3, None), (None, ""), (4, "Copyright 2020"), (5, mit + " more")]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, license string")
    out = {r["doc_id"]: (r["license"], list(r["line_licenses"]), r["n_license_lines"]) for r in licenses.scan_licenses(df).collect()}
    assert out[1][0] == "MIT" and out[5][0] is None
    assert out[2] == (None, ["MIT"], 2)
    assert out[3] == out[None] == out[4] == (None, [], 0)
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_whole_license_files(spark):
    """Texts as they stand in repositories: titles, copyright lines, other wrapping; and a caller's own table."""
    import textwrap

    texts = dict(licenses.KNOWN[:3] + [x for x in licenses.KNOWN if x[0] in ("BSD-3-Clause", "Unlicense", "BSL-1.0")])
    wrap = lambda t: "\n\n".join(textwrap.fill(p, 60, break_on_hyphens=False) for p in t.split("\n\n"))
    rows = [(n, f"{n} License\n\nCopyright (c) 2021 Jane Roe\n\n{wrap(t)}\n") for n, t in texts.items()] + [(f"{n}+", wrap(t)) for n, t in texts.items()]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in out} == {n: n for n in texts} | {f"{n}+": n for n in texts}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {n for _, n in licenses.listed()}
    own = licenses.digests_of(spark.createDataFrame([("Own-1.0", "Own Licence\n\nDo as you like, always.")], "license string, text string"))
    got = licenses.scan_licenses(spark.createDataFrame([(1, "own LICENSE\n(c) me\ndo as you like   always"), (2, "do as you like - always"), (3, "no")], "doc_id long, text string"), own).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {1: "Own-1.0", 2: "Own-1.0", 3: None}


# ---------------------------------------------------------------------- chat


def test_chat(spark):
    rows = [(1, 1, "assistant", "hi ### user: x </turn>\n"), (1, 0, "user", None), (1, 2, "user", "\\ back\\\\"), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (None, None, None, ":"), (1, 2, "user", "\\ back\\\\"), (3, 0, "sys: tem", "q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    for c in (1, 2, 3, None):
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        x = out[c]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_probe_is_absent_from_the_conversation(spark):
    turns = [("a\ue000", "x\ue000\ue001"), ("assistant", "\ue000"), ("user", "q")]
    out, whole, inner, bad = chat.spans(chat.plain_template, turns)
    assert not bad and [chat.unescape(out[a:b]) for a, b in inner] == [t for _, t in turns]


def test_own_conversation_minus_seven(spark, tmp_path):
    spark.createDataFrame([(-7, 0, "user", "mine"), (1, 0, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat.op7_chat(spark, str(tmp_path)).collect()) == [(-7, 1, 0), (-7, 2, len(chat.HARD)), (1, 1, 0)]


def test_rewriting_template():
    shout = lambda turns: f"{len(turns)} turns:" + chat.plain_template(turns)
    assert chat.spans(shout, [("user", "a"), ("assistant", "b")])[3]
    out, whole, inner, bad = chat.spans(chat.plain_template, [("user", "a"), ("assistant", " </turn>\n"), ("user", "")])
    assert not bad and "".join(out[a:b] for a, b in whole) == out and [chat.unescape(out[a:b]) for a, b in inner] == ["a", " </turn>\n", ""]


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    out = {r["conv_id"]: r for r in chat.op7_chat(spark, sf).collect()}
    hard = hashlib.sha256(f"user\n{chat.HARD}\nassistant\n{chat.HARD}\n".encode()).hexdigest()
    assert out[-7]["turns_sha256"] == hard and out[-7]["loss_sha256"] == hashlib.sha256(chat.HARD.encode()).hexdigest()
    assert len(out) == 1 + len({r["conv_id"] for r in rows})


# ----------------------------------------------------------------------- PII

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute9(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), "email", m.end()) for m in _EMAIL.finditer(text)]
    out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[1])))


def test_base_spans():
    r = random.Random(8)
    for _ in range(4000):
        t = "".join(r.choices(["1", "23", "4", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "%", "4111111111111111"], k=r.randint(0, 25)))
        assert pii.base_spans(t) == brute9(t), t
    for t in ("a" * 10_000 + "@x.y", "a@b.c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1" * 5000, "0" * 5000 + ".1.2.3"):
        assert pii.base_spans(t) == (brute9(t) if len(t) < 6000 and not t.startswith("0") else pii.base_spans(t))
    assert pii.base_spans("a" * 10_000 + "@x.y") == [(0, "email", 10_004)]


def test_added_spans(spark):
    rows = [(k, f"call me: phone 0{k % 90 + 10} 555 0{k % 90 + 10} or mail joe{k}@x.org") for k in range(60)]
    rows += [(100, None), (None, ""), (101, "card 4111111111111111"), (102, "write to ann [at] example [dot] org please")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, spans int")
    out = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert all([s["kind"] for s in out[k] if s["base"]] == ["email"] for k in range(60))
    assert sum([s["kind"] for s in out[k] if not s["base"]] == ["phone"] for k in range(60)) >= 57
    assert out[100] == out[None] == [] and [s["kind"] for s in out[101]] == ["card"]
    for spans in out.values():
        for a, b in zip(spans, spans[1:], strict=False):
            assert a["end"] <= b["start"] or a["base"] and b["base"]
    assert pii.find_pii(df.limit(0)).count() == 0


def test_planted_secrets(spark):
    """Secrets of several shapes in prose are found; long words, versions, digests and numbers are left alone."""
    r = random.Random(7)
    prose = lambda n: " ".join("".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 9))) for _ in range(n))
    hexed = lambda n: "".join(r.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    planted, rows = {}, []
    shapes = [lambda: ('token = "', hexed(40), '"'), lambda: ("api_key: ", mixed(32), ""), lambda: ("password=", mixed(20), ""), lambda: ("Bearer token is ", mixed(43), "")]
    clean = [lambda: "version 20240112abcdef3456789 of it", lambda: "commit " + hexed(40), lambda: "sha256 " + hexed(64), lambda: "Donaudampfschifffahrtsgesellschaftskapitän", lambda: "order 12345 678 90", lambda: "the secret of life", lambda: "page 123-456-789"]
    for k in range(400):
        lead, value, tail = shapes[k % 4]() if k % 2 else (clean[k // 2 % len(clean)](), "", "")
        text = f"{prose(20)} {lead}"
        if value:
            planted[k] = f"secret:{len(text)}:{len(text) + len(value)}"
        rows.append((k, f"{text}{value}{tail} {prose(15)}"))
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {x["doc_id"]: [f"{s['kind']}:{s['start']}:{s['end']}" for s in x["spans"] if not s["base"]] for x in found}
    assert sum(planted[k] in added[k] for k in planted) >= 0.95 * len(planted)
    assert sum(bool(added[k]) for k in added if k not in planted) <= 0.02 * 200


def test_candidates_are_linear():
    import time

    took = []
    for n in (4000, 32000):
        text = " ".join(f"{k % 90 + 10} 555 0{k % 90 + 10}" for k in range(n))
        begun = time.perf_counter()
        assert len(pii.candidates(text)) > n / 2
        took.append(time.perf_counter() - begun)
    assert took[1] < 20 * took[0]
    for t in ("a" * 200_000, "1." * 100_000, "aA1" * 60_000, "token " * 40_000, "a@" * 50_000, "[at] " * 40_000, "AB12 " * 40_000, "-" * 100_000, "A1B2" * 50_000):
        begun = time.perf_counter()
        pii.candidates(t)
        assert time.perf_counter() - begun < 20, t[:9]


def test_em_finds_the_bad_labeler():
    g = np.random.default_rng(3)
    truth = g.random(4000) < 0.4
    votes = [tuple(int(v) for v in np.where(g.random(4) < acc, np.where(t, 1, -1), np.where(t, -1, 1))) for t in truth for acc in [np.array([0.9, 0.85, 0.8, 0.5])]]
    rows = {}
    for v in votes:
        rows[v] = rows.get(v, 0) + 1
    q, tab = pii.em(np.array(list(rows)), np.array(list(rows.values()), float), np.array(["x"] * len(rows)))
    assert tab[1, 0, 2] > 0.8 and abs(tab[1, 3, 2] - tab[0, 3, 2]) < 0.15


def test_pii_query(spark, sf):
    rows = {r["doc_id"]: r for r in pii.op9_pii(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want, r = brute9(d["text"] or ""), rows[d["doc_id"]]
        told = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in want) for k in pii.KINDS]
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))


def test_pii_has_no_caps(spark):
    """Values of 900 and 10,000 characters are covered to their end, and a token may have its first digit late."""
    r = random.Random(12)
    token = lambda n: "".join(r.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", k=n - 12)) + "7" + "".join(r.choices("23456789XYZqrs", k=11))
    texts = [f"the password: {token(n)} is set" for n in (20, 900, 10_000)] + [f"use {token(n)} here" for n in (60, 800, 10_000)]
    for t in texts:
        (want,) = re.findall(r"\S{20,}", t)
        spans = [(c["s"], c["e"]) for c in pii.candidates(t) if c["k"] == "secret"]
        assert (t.index(want), t.index(want) + len(want)) in spans, t[:60]
    local, host = "x" * 90, "y" * 80
    mail = f"write to {local} [at] {host} [dot] example [dot] co [dot] a-b [dot] c-d [dot] org now"
    assert mail[9:-4] in [mail[c["s"] : c["e"]] for c in pii.candidates(mail) if c["k"] == "email"]
    rows = [(k, f"note {k}: my password is {token(24)} and token = {token(40)}") for k in range(300)] + [(900, texts[1]), (901, texts[2])]
    found = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"]] for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (14, 914) in found[900] and (14, 10_014) in found[901]


def test_pii_overlaps_are_settled_after_scoring():
    span = lambda a, b, base=False: {"start": a, "rank": 1, "kind": "x", "end": b, "base": base}
    spans = [span(0, 5, True), span(10, 30), span(20, 25), span(24, 40), span(30, 32)]
    assert pii.accepted(spans, [0, 0.2, 0.95, 0.93, 0.91], 0.9) == [True, False, True, False, True]
    assert pii.accepted(spans, [0, 0.99, 0.95, 0.93, 0.91], 0.9) == [True, True, False, False, True]
    assert pii.accepted(spans, [0, 0.9, 0.9, 0.5, 0.9], 0.9) == [True, True, False, False, True]


def test_contamination_blocks_share_one_map(spark):
    """Many blocks: one Python map, texts cross once, and the same result as with one block."""
    r = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(words, k=30))) for k in range(80)]
    docs = [(k, " ".join(r.choices(words, k=20) + items[k % 80][1].split()[3:25] + r.choices(words, k=9))) for k in range(300)] + [(999, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    one, many = (contamination.find_contamination(df, bench, block_chars=n, offsets=False) for n in (4_000_000, 500))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    told = lambda x: sorted((a["doc_id"], a["n_words"], a["n_hit"], tuple(a["hits"]), tuple(a["items"])) for a in x.collect())
    assert told(one) == told(many) and sum(x[2] > 0 for x in told(one)) == 300


def test_pairs_of_pieces_stay_as_merging_says():
    """Undoing last merges tells the same as merging, for pieces cut anywhere and for any two pieces."""
    model = tokens.load_model(tokens.default_model())
    merges, r, pieces = tokens.Merges(model["pieces"]), random.Random(5), list(model["pieces"])
    assert len(merges.plain) > 0.99 * len(pieces)
    seen = 0
    for k in range(20_000):
        a, b = r.choice(pieces), r.choice(pieces)
        if k % 2:
            at = r.randint(1, len(a + b) - 1)
            a, b = (a + b)[:at], (a + b)[at:]
        if a in merges.scores and b in merges.scores:
            stays = tokens.merge(a + b, merges.scores) == [a, b]
            assert merges.stays(a, b) == stays, (a, b)
            seen += stays
    assert seen > 5000 and all(merges.stays("", p) == (tokens.merge(p, merges.scores) == [p]) for p in pieces[:5000])
