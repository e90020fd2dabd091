"""Queries of the catalogue over whole tables, against plain Python."""

import hashlib

from veilframe.functions import validators
from veilframe.plans.queries import QUERIES


def verhoeff(digits):
    product, perm = validators._verhoeff_tables()
    c = 0
    for k, x in enumerate(reversed(digits)):
        c = product[10 * c + perm[(k % 8) * 10 + int(x)]]
    return c == 0


def test_verhoeff_of_every_key(spark, tmp_path):
    keys = [1, 2, 64574, 64575, 64576, 10**6, 10**9, *range(150000, 150200)]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    values = {k: str((k * 15485863 + 7) % 10**12).rjust(12, "2") for k in keys}
    got = {r["o_orderkey"]: (r["verhoeff_ok"], r["aadhaar_ok"]) for r in QUERIES["val_verhoeff"](spark, str(tmp_path)).collect()}
    assert got == {k: (verhoeff(v), verhoeff(v) and v[0] not in "01") for k, v in values.items()}
    assert any(x for x, _ in got.values())


def test_truncate_and_masks_of_whole_texts(spark, tmp_path):
    texts = ["", "a", "é" * 500, "é" * 501, "a" + "é" * 5000, "first line\n" * 900, "ab\ncdefgh", "x" * 1000, "\U0001f600" * 251, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: {r["doc_id"]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()}

    def cut(t):
        return None if t is None else t.encode()[:1000].decode(errors="ignore")

    want = {k: (None,) * 4 if t is None else (len(t.encode()) > 1000, len(str(len(cut(t)))), len(cut(t)), hashlib.md5(cut(t).encode()).hexdigest()) for k, t in enumerate(texts)}
    assert rows("norm_truncate") == want
    told = {
        "mask_partial": lambda x: "*" * len(x) if len(x) <= 6 else x[:2] + "*" * (len(x) - 4) + x[-2:],
        "mask_secret": lambda x: f"{x[: min(4, len(x) // 4)]}…[{len(x)} chars]",
        "mask_full": lambda x: f"[{len(x)} chars]",
    }
    for name, f in told.items():
        assert rows(name) == {k: (None if t is None else f(t),) for k, t in enumerate(texts)}, name


def test_detection_folds_compatibility_characters(spark, tmp_path):
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    card, mail = "4916 7305 2218 6409", "jane.roe@example.org"
    texts = [f"visa {card} or {mail}", wide(f"visa {card} or {mail}"), wide("none")]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"contact {t}") for k, t in enumerate(texts)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert rows("det_card_counts") == [(0, 1, 0), (1, 1, 0)]
    assert rows("det_card_masked") == [(0, "491673******6409"), (1, "491673******6409")]
    assert rows("det_email_counts") == [(0, 1), (1, 1)]
    assert rows("det_email_confidence") == [(0, 0, 1), (1, 0, 1)]
    assert rows("hits_by_lang") == [("en", 3, 2, 2)]
    assert rows("hits_by_source") == [("s", 3, 2, 2)]
    assert [r[2] for r in rows("conv_prompt_policy")] == ["block", "block", "allow"]
    found = rows("det_all_long")
    assert [r[1:] for r in found if r[0] == 0] == [r[1:] for r in found if r[0] == 1] != []
