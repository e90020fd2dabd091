"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

A linear model on character-class bigrams and word-repetition features is fitted
to trusted positives (labelled quality = 1) against unlabelled web text.  The
risk is  pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])  with logistic
loss; where the second part goes below zero its gradient is reversed.  The class
prior pi is estimated from positives and unlabelled text alone: a discriminator
between the two is cut at the score whose upper tail gives the lowest ratio of
unlabelled to positive mass (with a deviation bound).  One split into halves gives
0.78 to 0.82 where 0.80 is right, and a prior that is too high costs more than one
that is too low; so the estimate is the mean over SPLITS splits, less their deviation.

``max_rows`` bounds the sample of positives and of unlabelled rows that the fit
sees (different rows, by a hash of id and text); the driver holds only those
feature vectors.
Scoring is one narrow map over every whole text.

Defined results: null or empty text has all features zero and gets a score; a
null id counts as the text '' in the fold rule; repeated rows are scored alike;
no positives at all: every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grams, slices, words

#: Character classes of bytes; a byte not listed is a control byte.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n", ".,", "'\"", "-_", "!", "?", "#", "*", "$", "%", "&", "|", "<>", "/\\", "()[]{}", ";:", "@+=~^`"]
N_CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, N_CLASSES - 1, np.int32)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g.encode())] = _i
_CLASS[128:] = N_CLASSES - 2
N_PAIRS = N_CLASSES * N_CLASSES
N_FEATURES = N_PAIRS + 7


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES floats for each text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for lo, hi, data, offs in slices(texts):
        n = hi - lo
        size = np.diff(offs)
        for at in range(0, n, 256):  # pair counts of at most 256 rows at a time
            end = min(n, at + 256)
            a, b = offs[at], offs[end]
            pair_counts = np.zeros((end - at) * N_PAIRS, np.float32)
            for x in range(a, b - 1, 1 << 22):  # a long text in parts that overlap by one byte
                c = _CLASS[data[x : min(b, x + (1 << 22) + 1)]]
                row = np.searchsorted(offs[at : end + 1], np.arange(x, x + len(c) - 1), "right") - 1 if end - at > 1 else np.zeros(len(c) - 1, np.int64)
                if end - at > 1:  # no pair across two texts
                    inner = np.arange(x + 1, x + len(c)) < offs[at + 1 : end + 1][np.minimum(row, end - at - 1)]
                    pair_counts += np.bincount((row * N_PAIRS + c[:-1] * N_CLASSES + c[1:])[inner], minlength=len(pair_counts))
                else:
                    pair_counts += np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_PAIRS)
            out[lo + at : lo + end, :N_PAIRS] = np.sqrt(pair_counts.reshape(end - at, N_PAIRS) / np.maximum(size[at:end], 1)[:, None])
        start, stop, h, row = words(data, offs)
        if not len(h):
            continue
        n_words = np.bincount(row, minlength=n)
        some = np.maximum(n_words, 1)
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        r = out[lo:hi, N_PAIRS:]
        r[:, 0] = np.bincount(row[1:][same], minlength=n) / some
        r[:, 1] = _distinct(row, h, n) / some
        g = grams(h, 3)
        inside = row[2:] == row[:-2] if len(h) > 2 else np.zeros(0, bool)
        r[:, 2] = _distinct(row[: len(g)][inside], g[inside], n) / some
        r[:, 3] = np.log1p(n_words) / 10
        r[:, 4] = np.bincount(row, stop - start, minlength=n) / some / 10
        r[:, 5] = np.bincount(row, (stop - start) > 25, minlength=n) / some
        r[:, 6] = n_words > 0
    return out


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((row.astype(np.uint64) << np.uint64(42)) | (h >> np.uint64(22)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(42)).astype(np.int64), minlength=n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _adam(grad, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


#: Splits into halves over which the class prior is averaged.
SPLITS = 4


def estimate_prior(p: np.ndarray, u: np.ndarray, steps: int = 150) -> float:
    """Share of positives among the unlabelled: mean less deviation of the estimates of several splits."""
    if len(p) < 2 or len(u) < 2:
        return 0.5
    each = [_split_prior(p[_order(p, k)], u[_order(u, k)], steps) for k in range(SPLITS)]
    return float(np.clip(np.mean(each) - np.std(each), 0.02, 0.98))


def _split_prior(p: np.ndarray, u: np.ndarray, steps: int) -> float:
    """The share from the upper tails of a discriminator that is fitted on one half of each."""
    ptrain, phold, utrain, uhold = p[::2], p[1::2], u[::2], u[1::2]

    def grad(w):
        w = w.astype(np.float32)
        return -ptrain.T @ _sigmoid(-(ptrain @ w)) / len(ptrain) + utrain.T @ _sigmoid(utrain @ w) / len(utrain) + 1e-3 * w

    w = _adam(grad, p.shape[1], steps)
    sp, su = np.sort(phold @ w), np.sort(uhold @ w)
    cuts = np.quantile(sp, np.linspace(0, 0.98, 99))
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(sp))) + np.sqrt(np.log(40) / (2 * len(su)))
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.02, 0.98))


def _order(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """An order of the rows by their values, so that halves of them don't depend on how they came."""
    return np.argsort([zlib.crc32(np.asarray(r, np.float32).tobytes(), seed) for r in x], kind="stable")


def fit_arrays(p: np.ndarray, u: np.ndarray, prior: float | None = None, steps: int = 400, l2: float = 1e-3) -> dict:
    """The model (plain values) from feature rows of positives and unlabelled."""
    if not len(p) or not len(u):
        return {"w": np.zeros(N_FEATURES), "b": 0.0, "prior": 0.5}
    p, u = p[_order(p)], u[_order(u)]
    both = np.concatenate([p, u]).astype(np.float32, copy=False)
    mean, std = both.mean(0, dtype=np.float64), both.std(0, dtype=np.float64)
    del both
    scale = np.where(std > 1e-6, 1 / np.maximum(std, 0.01), 0.0)

    def one(x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), x.shape[1] + 1), np.float32)
        for lo in range(0, len(x), 1024):
            out[lo : lo + 1024, :-1] = np.clip((x[lo : lo + 1024] - mean) * scale, -8, 8)
        return out

    p, u = one(p), one(u)
    prior = estimate_prior(p, u) if prior is None else prior
    keep = np.ones(p.shape[1])
    keep[-1] = 0

    def grad(w):
        w = w.astype(np.float32)
        gp, gu = p @ w, u @ w
        pos = -prior * p.T @ _sigmoid(-gp) / len(p)
        neg = u.T @ _sigmoid(gu) / len(u) - prior * p.T @ _sigmoid(gp) / len(p)
        risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        return (pos + neg if risk >= 0 else -neg) + l2 * keep * w

    w = _adam(grad, p.shape[1], steps)
    return {"w": w[:-1], "b": float(w[-1]), "mean": mean, "scale": scale, "prior": prior}


def apply_arrays(model: dict, x: np.ndarray) -> np.ndarray:
    if "mean" not in model:
        return np.full(len(x), 0.5)
    return _sigmoid(np.clip((x - model["mean"]) * model["scale"], -8, 8) @ model["w"] + model["b"])


def _sampled(rows: DataFrame, max_rows: int) -> np.ndarray:
    """Feature rows of about ``max_rows`` different (id, text) rows at most, told by hash.

    Which rows is decided before any text is read by Python, in every partition alone;
    features, not texts, are exchanged, and repeated rows count once.
    """
    order = F.xxhash64(F.lit(17), "id", "text")
    n = rows.agg(F.approx_count_distinct(order, 0.02)).first()[0]
    some = rows.withColumn("order", order).filter(F.pmod("order", F.lit(1_000_003)) < -(-max_rows * 1_000_003 // max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in features(batch.column(0))], pa.binary())], names=["order", "f"])

    told = some.select("text", "order").mapInArrow(run, "order long, f binary").groupBy("order").agg(F.first("f").alias("f"))
    got = told.orderBy("order").toArrow().column("f")
    return np.frombuffer(b"".join(x.as_py() for x in got), np.float32).reshape(-1, N_FEATURES)


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, positives: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", max_rows: int = 8000, prior: float | None = None) -> dict:
    """Fit on documents whose ids stand in ``positives`` (one id column) against all others as unlabelled."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most max_rows ids, so this side of the join has a fixed bound.
    trusted = positives.select(F.col(positives.columns[0]).alias("id")).dropna().distinct().orderBy(F.xxhash64(F.lit(17), "id"), "id").limit(max_rows)
    p = _sampled(src.join(F.broadcast(trusted), "id", "left_semi"), max_rows)
    u = _sampled(src.join(F.broadcast(trusted), "id", "left_anti"), max_rows)
    return fit_arrays(p, u, prior)


def score(docs: DataFrame, model: dict, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``id_col`` and score (0 to 1)."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(apply_arrays(model, features(part.column(1))), pa.float64())], names=["id", "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")


def train_positives(labels: DataFrame) -> DataFrame:
    """Ids labelled good, and only good, outside the held-out fold."""
    rows = labels.filter(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")


THRESHOLD = 0.3


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs, fit(docs, train_positives(labels)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, unchanged."""
    model = fit(docs, train_positives(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    whole = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return score(whole, model, id_col="doc").filter(F.col("score") >= THRESHOLD).select("doc.*")
