"""Line dedup: the same lines in corpora of several sizes."""

import random

import pytest

from veilframe.llm.line_templates import dedup_lines, stage


@pytest.mark.parametrize("values", [7, 40])
def test_word_fields_at_two_sizes(spark, values):
    """Two fields of equally many values: fields in a small corpus and in one where each value passes min_docs."""
    r = random.Random(3)
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    for n in (120, 900 if values == 7 else 3000):
        rows = [(k, f"alone{word(k)} {word(r.randrange(9999))}\nThis long page was posted by {word(r.randrange(values))}x and {word(r.randrange(values))}y on the open board") for k in range(n)]
        out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=20).collect()
        assert {r["n_dropped"] for r in out} == {1}, n


def test_stage_drops_boilerplate_pages_but_not_copies(spark):
    """Recurring lines hold most of a page: they go; the lines of 25 near copies of one text stay."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrst", k=7))
    menu = "\n".join(" ".join(word() for _ in range(9)) for _ in range(4))
    pages = [(k, f"{menu}\n" + " ".join(word() for _ in range(25))) for k in range(25)]
    body = "\n".join(" ".join(word() for _ in range(9)) for _ in range(8))
    copies = [(100 + k, f"{body}\n{word()}") for k in range(25)]
    docs = spark.createDataFrame(pages + copies, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in stage(spark, docs.withColumn("n_chars", docs["doc_id"]), "").collect()}
    assert got == {k: t.split("\n")[-1] for k, t in pages} | dict(copies)


def test_stage_drops_long_lines_from_two_texts_on(spark):
    """60 words in 2 texts and 35 in 9 go; 35 words in 2 texts and a line of two near copies stay; so at two corpus sizes."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrst", k=7))
    line = lambda n: " ".join(word() for _ in range(n))
    long, nine, two, copied = line(60), line(35), line(35), line(60)
    shared = [(long, 2), (nine, 9), (two, 2)]
    rows = [(100 * k + j, f"{x}\n{line(45)}") for k, (x, n) in enumerate(shared) for j in range(n)] + [(900, f"{copied}\nend one"), (901, f"{copied}\nend two")]
    for more in (0, 2000):
        docs = spark.createDataFrame(rows + [(1000 + k, line(60)) for k in range(more)], "doc_id long, text string")
        got = {x["doc_id"]: x["text"] for x in stage(spark, docs.withColumn("n_chars", docs["doc_id"]), "").collect()}
        gone = {k for k, t in rows if got[k] == t.split("\n")[1]}
        assert gone == {k for k, _ in rows if k < 200}
        assert all(got[k] == t for k, t in rows if k >= 200) and len(got) == len(rows) + more
