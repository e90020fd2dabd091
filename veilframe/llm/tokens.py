"""SentencePiece encoding and decoding by an Aho-Corasick Viterbi.

The pieces of a ``.model`` file form one Aho-Corasick automaton.  A text is read
once; at each position the automaton's output links name the pieces that end
there, longest first, and each is tried as the last piece of the text so far.
Backtracking gives the ids.  Characters that no piece covers are written as byte
pieces; decoding gives the very text back.

What makes a piece the best one at a position depends on the model:

* unigram: the highest sum of the model's scores;
* BPE: the same pass over steps that are restricted: a piece may follow the best last
  piece of the text before it only if merging the two alone leaves both as they are.
  Merging gives every prefix one last piece, so one of the pieces that end at a
  position passes, and the ids are those of the library.  The highest sum of BPE
  scores, without the restriction, would give other ids.  Tests on pairs are memoised.

No piece has the space mark after its first other character, so no piece, and no
merge, crosses into a run of space marks.  Texts are therefore cut there, and a
worker segments each recent distinct chunk once (memos are bounded, and lose what
is oldest first).  The model file is read
on the driver (path is a parameter) and broadcast: its size is that of a
vocabulary file and doesn't grow with the data.

Models that change texts first (a character map, dropped extra spaces, marks
behind words, user-defined pieces), or that have no byte pieces, are refused.

Defined results: null text: null ids; empty text: no ids; a literal U+2581 in a
text is written as byte pieces, so that decoding stays exact (the library takes it
for a space).  Extra columns are ignored; repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Types of pieces and of models in the file format, and the library's score below the least for unknown characters.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Entries of the memos of chunks (some 200 bytes each) and of pairs; half of them at least are the latest.
MEMO, PAIRS = 320_000, 100_000
_CHUNK = re.compile("▁+[^▁]*|[^▁]+")
_built: dict = {}


def load_model(path: str) -> dict:
    """Pieces, scores and options of a .model file, as plain values."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        return read_model(pb.ModelProto.FromString(f.read()))


def read_model(proto) -> dict:
    norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
    pieces, byte_ids = {}, [-1] * 256
    for i, p in enumerate(proto.pieces):
        if p.type == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
        elif p.type == NORMAL:
            pieces[p.piece] = (i, p.score)
    checks = {
        "is neither unigram nor BPE": kind not in (UNIGRAM, BPE),
        "has a character map": bool(norm.precompiled_charsmap),
        "drops extra spaces": norm.remove_extra_whitespaces,
        "does not mark spaces": not norm.escape_whitespaces,
        "puts marks behind words": proto.trainer_spec.treat_whitespace_as_suffix,
        "has user-defined or unused pieces": any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in proto.pieces),
        "has no byte pieces": -1 in byte_ids,
        "has a piece with the space mark inside": any(MARK in p.lstrip(MARK) for p in pieces),
    }
    if wrong := [what for what, is_so in checks.items() if is_so]:
        raise ValueError(f"the model {', and '.join(wrong)}")
    return {"pieces": pieces, "bytes": byte_ids, "prefix": norm.add_dummy_prefix, "bpe": kind == BPE, "unk": min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY}


_NONE = float("-inf")


def merge(symbols: str | list[str], scores: dict[str, float]) -> list[str]:
    """The neighbours with the highest score as one piece are joined, the leftmost of equals, until none are a piece."""
    symbols, get = list(symbols), scores.get
    pair = [get(a + b, _NONE) for a, b in pairwise(symbols)]
    while pair and (best := max(pair)) > _NONE:
        at = pair.index(best)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = get(symbols[at] + symbols[at + 1], _NONE)
        if at:
            pair[at - 1] = get(symbols[at - 1] + symbols[at], _NONE)
    return symbols


class _Recent(dict):
    """What ``f`` gives for each key, kept for the latest keys: when half of ``most`` are new, all that were not asked for since go."""

    def __init__(self, f, most: int):
        self.f, self.half, self.old = f, most // 2, {}

    def __missing__(self, key):
        told = self.old.get(key)
        if told is None:
            told = self.f(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = told
        return told


class _Chunks(_Recent):
    """Ids (bytes of int32) of each chunk; long ones are not kept."""

    def __missing__(self, key):
        told = self.old.get(key)
        if told is None:
            told = array("i", self.f(key)).tobytes()
        if len(key) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = told
        return told


class Merges:
    """How merging makes each piece, and which pairs of pieces it leaves as they are.

    ``rank``: a piece's place by falling score, -1 for a single character.  ``halves``: what a piece's
    last merge joins.  Where every merge inside a piece comes before its last one (``plain``), two
    pieces are tested by undoing their last merges one by one, the later one first: if what then
    meets at the border makes a piece that would have been merged before, the pair doesn't stay.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.scores = {p: score for p, (_, score) in pieces.items()}
        by_score = sorted((p for p in pieces if len(p) > 1), key=lambda p: -self.scores[p])
        self.rank = {p: k for k, p in enumerate(by_score)} | {p: -1 for p in pieces if len(p) == 1}
        alike = Counter(self.scores[p] for p in by_score)  # of equal scores the place decides, not the rank
        self.halves: dict[str, tuple[str, str]] = {}
        self.plain = {p for p, r in self.rank.items() if r < 0}
        for p in by_score:  # parts that come later are no parts of a plain piece
            cuts = [(a, b) for a, b in ((p[:k], p[k:]) for k in range(1, len(p))) if a in self.plain and b in self.plain and self.rank[a] < self.rank[p] > self.rank[b] and self.apart(a, b, self.rank[p])]
            if alike[self.scores[p]] == 1 and len(cuts) == 1:
                self.halves[p] = cuts[0]
                self.plain.add(p)

    def apart(self, left: str, right: str, limit: int) -> bool:
        """Do two plain pieces stay apart until merges of rank ``limit``?"""
        rank, halves = self.rank, self.halves
        while True:
            both = rank.get(left + right)
            if both is not None and both < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, left = a, halves[left][1]
            elif b < 0:
                return True
            else:  # of equal pieces the left one is merged first
                limit, right = b + 1, halves[right][0]

    def stays(self, left: str, right: str) -> bool:
        """Merging the characters of both gives these two (``left`` may be empty)."""
        if right in self.plain and (left in self.plain or not left):
            return not left or self.apart(left, right, len(self.rank))
        return merge(left + right, self.scores) == ([left, right] if left else [right])


class Segmenter:
    def __init__(self, model: dict):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in model["pieces"].items():
            self.automaton.add_word(piece, (len(piece), i) if model["bpe"] else (len(piece), i, score))
        self.automaton.make_automaton()
        self.memo = _Chunks(self.best, MEMO)
        self.merges = Merges(model["pieces"]) if model["bpe"] else None
        self.pairs = _Recent(self._stays, PAIRS) if model["bpe"] else None
        self.piece_of = {i: p for p, (i, _) in model["pieces"].items()}
        self.byte_of = {i: b for b, i in enumerate(model["bytes"])}
        self._table = None

    def best(self, s: str) -> list[int]:
        """Single-pass Viterbi over the automaton's matches, in order of their ends; among equal scores the longest piece.

        Matches that end at one place come longest first, along the output links.  A place that no
        match relaxes has its last character alone, as bytes.
        """
        size, piece = self._by_score(s) if self.pairs is None else self._by_pair(s)
        out: list[int] = []
        at = len(s)
        while at:
            if (i := piece[at]) >= 0:
                out.append(i)
                at -= size[at]
            else:
                out += [self.model["bytes"][b] for b in reversed(s[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
        out.reverse()
        return out

    def _by_score(self, s: str) -> tuple[list[int], list[int]]:
        """Unigram, the highest sum of scores: size and number (-1: none) of the best last piece of each prefix."""
        size, piece = [1] * (len(s) + 1), [-1] * (len(s) + 1)
        unk, score, done = self.model["unk"], [0.0], 0
        for end, (k, i, gain) in self.automaton.iter(s):
            while done <= end:  # a new place: at first, its character alone
                score.append(score[done] + unk)
                done += 1
            if (x := score[done - k] + gain) > score[done]:
                score[done], size[done], piece[done] = x, k, i
        return size, piece

    def _by_pair(self, s: str) -> tuple[list[int], list[int]]:
        """BPE, the same: a match is a step only if it stays beside the best last piece of the text before it; then no other one at its end does."""
        n, pairs = len(s), self.pairs
        size, piece = [1] * (n + 1), [-1] * (n + 1)
        left: list[int | None] = [None] * (n + 1)  # the first half of a pair's key
        left[0] = -1 << 32
        for end, (k, i) in self.automaton.iter(s):
            end += 1
            if piece[end] < 0:
                key = left[end - k]
                if key is None:  # a character alone
                    key = left[end - k] = -2 - ord(s[end - k - 1]) << 32
                if pairs[key | i]:
                    size[end], piece[end], left[end] = k, i, i << 32
        return size, piece

    def _stays(self, pair: int) -> bool:
        left = pair >> 32
        return self.merges.stays(self.piece_of[left] if left >= 0 else chr(-2 - left) if left < -1 else "", self.piece_of[pair & 0xFFFFFFFF])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        out = []
        for k, part in enumerate(text.split(MARK)):  # a literal mark goes as bytes
            if k:
                out.append(np.array([self.model["bytes"][b] for b in MARK.encode()], np.int32).tobytes())
            s = part.replace(" ", MARK)
            if not k and self.model["prefix"]:
                s = MARK + s
            out.extend(map(self.memo.__getitem__, _CHUNK.findall(s)))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all pieces end to end, and where each id's bytes start and how many they are."""
        known = {i: p.replace(MARK, " ").encode() for i, p in self.piece_of.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}
        parts = [known.get(i, b"") for i in range(max(known) + 1)]
        size = np.array([len(p) for p in parts])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What the ids stand for, with numpy: the bytes of each piece, one after another."""
        if self._table is None:
            self._table = self.table()
        flat, start, size = self._table
        n = size[ids]
        at = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = flat[at].tobytes()
        return out[1:] if self.model["prefix"] and len(ids) else out


def _segmenter(key: str, model) -> Segmenter:
    """The worker's segmenter for a broadcast model, built once."""
    if key not in _built:
        _built.clear()
        _built[key] = Segmenter(model.value)
    return _built[key]


def encode(docs: DataFrame, model_path: str, *, text_col: str = "text", id_col: str = "doc_id", check: bool = True) -> DataFrame:
    """One row per document: ``id_col``, ids, n_tokens and, with ``check``, whether decoding the ids gives the text back."""
    spark = docs.sparkSession
    model, key = spark.sparkContext.broadcast(load_model(model_path)), uuid.uuid4().hex
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(key, model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, same = [], []
                for text in part.column(1).to_pylist():
                    ids = None if text is None else seg.encode(text)
                    rows.append(ids)
                    if check:
                        same.append(None if ids is None else seg.decode_bytes(ids) == text.encode("utf-8", "surrogatepass"))
                n = [None if x is None else len(x) for x in rows]
                flat = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.int32)])
                offs = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([x or 0 for x in n], out=offs[1:])
                ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in rows]))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(n, pa.int64()), pa.array(same if check else [None] * len(rows), pa.bool_())], names=["id", "ids", "n_tokens", "round_trip"])

    kind = src.schema["id"].dataType.simpleString()
    out = src.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, round_trip boolean")
    return out.select(F.col("id").alias(id_col), "ids", "n_tokens", *(["round_trip"] if check else []))


def decode(df: DataFrame, model_path: str, *, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """One row per row: ``id_col`` and the text that the ids stand for (null ids: null)."""
    model, key = df.sparkSession.sparkContext.broadcast(load_model(model_path)), uuid.uuid4().hex
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(key, model)
        for batch in batches:
            texts = [None if x is None else seg.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_col), "text")


def default_model() -> str:
    """The public vocabulary file of this box; a cluster passes its own path."""
    import os

    return os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, default_model())
    return out.select("doc_id", "n_tokens", "ids", "round_trip")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the check that they decode to its text."""
    return encode(docs, default_model()).select("doc_id", "n_tokens", "ids", "round_trip")
