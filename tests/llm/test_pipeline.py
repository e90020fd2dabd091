"""The pipeline against a plain-Python version of its stages."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_line_templates import brute as brute_lines
from tests.llm.test_map_operators import brute10
from tests.llm.test_near_dup import brute as brute_near
from veilframe.llm import quality_pu


def made(folder):
    r = random.Random(11)
    word = lambda: "".join(r.choices(["an", "the", "ou", "re", "st", "ing", "ble"], k=r.randint(1, 4)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(n))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(6)]
    rows = []
    for k in range(160):
        t = prose(r.randint(4, 12))
        if k % 3 == 0:
            t += "\nAll rights of this text are reserved."
        if k % 11 == 0:
            t += "\n" + items[k % 6][1]
        if k % 4 == 1:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((k, t))
    rows += [(200 + k, rows[2 * k][1].replace("an", "an", 1)) for k in range(10)] + [(300, None), (301, ""), (302, "a b")]
    rows += [(400 + k, rows[7][1] + f" tail{k}") for k in range(30)]
    docs = [{"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 3}", "n_chars": len(t or "")} for i, t in rows]
    labels = [{"doc_id": k, "quality": int(k % 4 != 1), "toxic": 0} for k in range(160) if k % 7 < 4]
    for name, data in (("documents", docs), ("labels", labels), ("benchmark", [{"item_id": i, "text": t} for i, t in items])):
        pq.write_table(pa.Table.from_pylist(data), f"{folder}/{name}.parquet")
    return docs, labels, items


def test_stages_and_run(spark, tmp_path):
    docs, labels, items = made(tmp_path)
    import zlib

    train = {x["doc_id"] for x in labels if x["quality"] == 1 and zlib.crc32(str(x["doc_id"]).encode()) % 5}
    texts = lambda rows: pa.array([d["text"] for d in rows], pa.string())
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.STAGES[0][1](spark, frame, str(tmp_path)).collect()
    model = quality_pu.fit_arrays(quality_pu.features(texts([d for d in docs if d["doc_id"] in train])), quality_pu.features(texts([d for d in docs if d["doc_id"] not in train])))
    score = quality_pu.apply_arrays(model, quality_pu.features(texts(docs)))
    sure = {d["doc_id"] for d, s in zip(docs, score, strict=True) if abs(s - 0.3) > 0.05}
    kept = {d["doc_id"] for d, s in zip(docs, score, strict=True) if s >= 0.3}
    assert {r["doc_id"] for r in got} & sure == kept & sure
    now = sorted((r.asDict() for r in got), key=lambda d: d["doc_id"])

    drops = brute_lines([d["text"] for d in now], 20, 3, 0.8)
    for d, drop in zip(now, drops, strict=True):
        if d["text"] is not None:
            lines = d["text"].split("\n")
            if sum(len(lines[k].split()) for k in drop) <= 0.5 * len(d["text"].split()):
                d["text"] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
        d["n_chars"] = None if d["text"] is None else len(d["text"])
    assert any(drops)
    now = [d for d, x in zip(now, sorted(brute_near([(d["doc_id"], d["text"]) for d in now], 5, 80)), strict=True) if x[3]]
    hit = {d: n and 20 * n >= w for d, w, n, _, _ in brute10([(d["doc_id"], d["text"]) for d in now], items, 13)}
    now = [d for d in now if not hit[d["doc_id"]]]

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == [d["doc_id"] for d in now]
    assert all(r["round_trip"] for r in out if r["ids"] is not None)

    rows = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == frame.columns, name
        rows.write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in rows.filter("text IS NOT NULL").collect()) == [(d["doc_id"], d["text"], d["n_chars"]) for d in now if d["text"] is not None]
