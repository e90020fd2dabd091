"""Chat formatting with black-box templates.

A template is any function from a list of (role, text) turns to a string.  It is
rendered on successive prefixes of the conversation; where each output continues
the last one, the new part is the turn's span.  Rendering the same turn with a
probe character and with no text shows where the text stands inside the span, so
that the loss mask covers assistant texts and nothing else.  A template whose
output for a longer prefix does not begin with its output for the shorter one
rewrites history: the conversation is marked and gets no mask.  The probe is a
character that stands nowhere in the conversation or its output.  Three renderings
of each prefix are what the method asks for, so a conversation costs the square of
its turns.

Rows are dealt by conversation and sorted inside partitions, then read as a
stream: a task holds one conversation at a time.

Defined results: null text is empty, null role is ''; rows with the same turn
are ordered by role, then text; null turns come first; a null conversation id is
a conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"


def escape(s: str) -> str:
    """No control string is left in the result, and unescape() gives s back."""
    return s.replace("\\", "\\\\").replace("### ", "#\\## ").replace("</turn>", "<\\/turn>")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def plain_template(turns: Turns) -> str:
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + ':')}{MID}{escape(text)}{CLOSE}" for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns of an output of plain_template."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        m = re.match(r"### ((?:[^\\:]|\\.)*): ", part, re.S)
        out.append((unescape(m[1]), unescape(part[m.end() :])))
    return out


def spans(template: Callable[[Turns], str], turns: Turns) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The output, each turn's span, each turn's text span, and whether history is rewritten."""
    done, whole, inner = template([]), [], []
    used = set(template(turns)).union(*[role + text for role, text in turns])
    probe_char = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used)
    for k, (role, _) in enumerate(turns):
        out = template(turns[: k + 1])
        if not out.startswith(done):
            return template(turns), [], [], True
        bare, probe = template([*turns[:k], (role, "")]), template([*turns[:k], (role, probe_char)])
        head = probe.find(probe_char, len(done))
        tail = len(bare) - head
        # What follows the text must be the same in all three renderings.
        if head < 0 or out[:head] != bare[:head] or bare[head:] != out[len(out) - tail :]:
            return template(turns), [], [], True
        whole.append((len(done), len(out)))
        inner.append((head, len(out) - tail))
        done = out
    return done, whole, inner, False


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_chats(rows: DataFrame, template: Callable[[Turns], str] = plain_template, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_col``, formatted, turn_spans, loss_spans, rewrites."""
    src = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(done: list) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1]), pa.array(cols[2], _SPAN), pa.array(cols[3], _SPAN), pa.array(cols[4])], names=["conv", "formatted", "turn_spans", "loss_spans", "rewrites"])

        def close() -> None:
            out, whole, inner, rewrites = spans(template, turns)
            both = [[{"start": a, "end": b} for a, b in x] for x in (whole, [s for s, (r, _) in zip(inner, turns, strict=False) if r in loss_roles])]
            done.append((now, out, *both, rewrites))

        now, turns, done, kind, size, begun = None, [], [], pa.int64(), 0, False
        for batch in batches:
            kind = batch.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != now:
                    close()
                    size += len(done[-1][1])
                    turns = []
                    if size > 4_000_000:
                        yield told(done)
                        done, size = [], 0
                now, begun = conv, True
                turns.append((role, text))
        if begun:
            close()
            yield told(done)

    kind_ = src.schema["conv"].dataType.simpleString()
    span = "array<struct<start:long,end:long>>"
    out = src.mapInArrow(run, f"conv {kind_}, formatted string, turn_spans {span}, loss_spans {span}, rewrites boolean")
    return out.withColumnRenamed("conv", conv_col)


def digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    src = chats.select(F.col(conv_col).alias("conv"), "formatted", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, chars, loss, size = [], [], [], [], []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                under = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                n.append(len(turns))
                sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
                chars.append(len(under))
                loss.append(hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = src.schema["conv"].dataType.simpleString()
    return src.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)


HARD = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.struct(F.lit(False).alias("added"), "conv_id").alias("conv"), "turn", "role", "text")
    hard = spark.createDataFrame([((True, -7), 0, "user", HARD), ((True, -7), 1, "assistant", HARD)], rows.schema)
    # A conversation of the table that has this id itself stays apart.
    return digests(format_chats(rows.unionByName(hard), conv_col="conv"), "conv").withColumn("conv", F.col("conv.conv_id")).withColumnRenamed("conv", "conv_id")
