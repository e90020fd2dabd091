"""Required texts of patterns, and packs of hundreds of detectors."""

import random
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from veilframe.operators import inspect as ins
from veilframe.plans import packs
from veilframe.plans.literals import required


@pytest.mark.parametrize("pattern,want", [(r"\bPROJECT-(?:ORION|VEGA)\b", {"PROJECT-"}), ("(?:foo|bar|quux)[0-9]+", {"foo", "bar", "quux"}), ("abc?def", {"def"}), ("(?:abcd)?xyz", {"xyz"}), ("(abc|d)+xyz1", {"xyz1"}), ("(a+)+b", None), ("(?i)abcdef", None), ("x(?i:abcde)y", None), (r"\p{Nd}abc", None), ("ab", None), ("(?:abc|[0-9]+)x", None), ("(x", None)])
def test_required(pattern, want):
    assert required(pattern) == (want and frozenset(want))


def test_every_match_holds_a_required_text():
    r = random.Random(2)
    piece = lambda: r.choice(["abc", "xyz", "a", "[bc]", "(?:abc|xyzz)", "(?:abc)?", "b+", "(?:ca|ab){2}", "x*", "(?:a(?:bcd|xyz)|cab)"])
    told = 0
    for _ in range(400):
        p = "".join(piece() for _ in range(r.randint(1, 4)))
        texts = ["".join(r.choices("abcxyzd", k=40)) for _ in range(30)]
        if (need := required(p)) is None:
            continue
        told += 1
        for m in (m for t in texts for m in re.finditer(p, t)):
            assert any(x in m[0] for x in need), (p, m[0])
    assert told > 150


def _pack(n):
    return packs.load_pack({"pack": "many", "version": "1", "detectors": [{"id": f"d{k}", "name": f"D{k}", "category": "x", "pattern": rf"\b(?:CODE-{k:03d}|NAME_{k:03d})-[0-9]{{2,4}}\b", "keywords": ["secret"], "proximity": 20} for k in range(n)]})


def _texts(n):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9)))
    out = []
    for k in range(n):
        w = [word() for _ in range(300)]
        if k % 9 == 0:
            w[r.randrange(300)] = f"CODE-{r.randrange(300):03d}-{r.randrange(10, 9999)}"
            w[r.randrange(300)] = f"NAME_{r.randrange(300):03d}-{r.randrange(10, 9999)}"
        out.append(" ".join(w))
    return pa.array([*out, None, ""])


def test_many_detectors_find_the_same(monkeypatch):
    """300 detectors: the hits are those of detectors that are all tried, and it takes less than twice the time of 12."""
    texts = _texts(1500)
    many, few = list(_pack(300).detectors), list(_pack(12).detectors)
    fast, slow = ins.scan(many, ins.Budget()), None
    with monkeypatch.context() as m:
        m.setattr(ins, "FEW", 10_000)
        slow = ins.scan(many, ins.Budget())
        twelve = ins.scan(few, ins.Budget())
    assert fast(texts).equals(slow(texts)) and sum(len(x) for x in fast(texts).field("spans").to_pylist()) > 250

    def best(run):
        took = []
        for _ in range(3):
            begun = time.perf_counter()
            run(texts)
            took.append(time.perf_counter() - begun)
        return min(took)

    a, b = best(fast), best(twelve)
    assert a < 2 * b, (a, b)


def test_columns_of_the_caller_stay(spark):
    df = spark.createDataFrame([("pay by card 4111 1111 1111 1111", 1, 2, 3)], "text string, found int, __scan int, __pscan int")
    (row,) = ins.inspect(df).collect()
    assert (row["found"], row["__scan"], row["__pscan"]) == (1, 2, 3) and row["inspection"]["hits"][0]["detector"] == "credit_card"
    with pytest.raises(ValueError):
        ins.detected(df, "credit_card")
    assert len(ins.detected(df, "credit_card", out_col="cards").first()["cards"]) == 1


def test_packs_merge_end_to_end(spark):
    """Two packs from JSON, with b64: vectors and a sha256: dummy value, through the self test."""
    import base64
    import hashlib
    import json

    vector = "b64:" + base64.b64encode(b"token ACME-12345 here").decode()
    dummy = "sha256:" + hashlib.sha256(b"ACME99999").hexdigest()
    one = packs.load_pack(json.dumps({"pack": "acme", "version": "2", "detectors": [{"id": "acme", "name": "Acme", "category": "x", "pattern": r"ACME-[0-9]{5}", "base_confidence": "high", "test_values": [dummy], "tests": {"match": [vector], "no_match": ["ACME-99999", "ACME-1"]}}]}))
    two = packs.load_pack(json.dumps({"pack": "other", "version": "1", "detectors": [{"id": "plate", "name": "Plate", "category": "x", "pattern": r"[A-Z]{2}-[0-9]{4}", "tests": {"match": ["AB-1234"], "no_match": ["A-1"]}}]}))
    assert pc.all(pa.array([r["ok"] for r in ins.self_test(spark, [one, two]).collect()])).as_py()
    assert [tuple(r) for r in ins.detector_ids(spark, [one, two]).collect()] == [(0, "acme"), (1, "plate")]
    (row,) = ins.inspect(spark.createDataFrame([("ACME-99999 and AB-1234",)], "text string"), packs=[two, one]).collect()
    assert row["inspection"]["packs"] == ["other@1", "acme@2"]
    assert [(h["detector"], h["max_confidence"]) for h in row["inspection"]["hits"]] == [("plate", "medium"), ("acme", "low")]
    with pytest.raises(packs.PackError):
        packs.merge([one, one])
