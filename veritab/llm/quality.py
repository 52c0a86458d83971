"""Text quality by positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm.common import texts_of

#: Trusted positives and unlabelled texts that the model is fitted on, at most.
MOST_POSITIVE = 4000
MOST_UNLABELLED = 8000
#: Scores from here on count as good.
THRESHOLD = 0.3
HASHED = 256


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, newline, UTF-8 beyond ASCII, control, and each ASCII mark its own."""
    table = np.full(256, 6, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[ord(" "), ord("\t")]], table[[ord("\n"), ord("\r")]], table[128:] = 3, 4, 5
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = 7 + np.arange(len(marks))
    return table


_CLASS = _byte_classes()
_CLASSES = int(_CLASS.max()) + 1
_COARSE = np.minimum(_CLASS, 7)
WIDTH = _CLASSES + 64 + HASHED + 8


def features(text: str) -> np.ndarray:
    """WIDTH numbers of a whole text: byte classes, pairs of coarse classes, hashed byte trigrams, word and line repeats."""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return out
    out[:_CLASSES] = np.bincount(_CLASS[data], minlength=_CLASSES) / n
    coarse = _COARSE[data]
    if n > 1:
        out[_CLASSES : _CLASSES + 64] = np.bincount(coarse[:-1] * 8 + coarse[1:], minlength=64) / (n - 1)
    if n > 2:
        wide = data.astype(np.uint32)
        slots = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(24)
        out[_CLASSES + 64 : _CLASSES + 64 + HASHED] = np.sqrt(np.bincount(slots.astype(np.int64), minlength=HASHED) / (n - 2))
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:]))
    capitals = sum(map(str.isupper, words))
    out[-8:] = (np.log1p(n) / 10, np.log1p(w) / 10, len(set(words)) / w, again / w, sum(map(len, words)) / w / 10, 1 - len(set(lines)) / len(lines), capitals / w, np.log1p(len(lines)) / 10)
    return out


@dataclass
class Model:
    """A linear scorer on standardised features; prior is the estimated share of good texts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, width: int, rounds: int, rate: float) -> np.ndarray:
    """Adam from zero; gradient(w) for w of width numbers, the bias last."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled texts from scores of both: the least ratio of their upper tails.

    The cut is where the ratio's upper confidence bound is smallest, so that the thin end of the tail does not decide.
    """
    p, u = np.sort(p), np.sort(u)
    cuts = np.unique(np.concatenate([p, u]))
    above_p = 1 - np.searchsorted(p, cuts, "left") / len(p)
    above_u = 1 - np.searchsorted(u, cuts, "left") / len(u)
    fine = above_p > 0.05
    slack = np.sqrt(np.log(4 / delta) / (2 * len(p))) + np.sqrt(np.log(4 / delta) / (2 * len(u)))
    bound = above_u[fine] / above_p[fine] + slack / above_p[fine]
    best = int(bound.argmin())
    return float(np.clip(above_u[fine][best] / above_p[fine][best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, rounds: int = 400, ridge: float = 1e-3) -> Model:
    """Minimise the non-negative unbiased risk of logistic loss over a linear scorer.

    risk = prior * E_p[loss(z)] + max(0, E_u[loss(-z)] - prior * E_p[loss(-z)]); where the second part is negative its
    gradient is turned round, so that the fit cannot push it lower. Without a prior, a scorer of positive against
    unlabelled texts is fitted on one half and estimate_prior() reads the prior off the other half.
    """
    mean = np.concatenate([positive, unlabelled]).mean(axis=0)
    scale = np.maximum(np.concatenate([positive, unlabelled]).std(axis=0), 1e-3)
    xp, xu = (np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    decay = np.full(xp.shape[1], ridge)
    decay[-1] = 0
    if prior is None:
        a, b, c, d = xp[::2], xp[1::2], xu[::2], xu[1::2]
        if not len(b) or not len(d):
            prior = 0.5
        else:
            w = _descend(lambda w: -a.T @ _sigmoid(-(a @ w)) / len(a) + c.T @ _sigmoid(c @ w) / len(c) + 10 * decay * w, xp.shape[1], rounds // 2, 0.05)
            prior = estimate_prior(b @ w, d @ w)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = xp @ w, xu @ w
        negative = _softplus(zu).mean() - prior * _softplus(zp).mean()
        g_negative = xu.T @ _sigmoid(zu) / len(xu) - prior * (xp.T @ _sigmoid(zp)) / len(xp)
        g_positive = -prior * (xp.T @ _sigmoid(-zp)) / len(xp)
        return (g_positive + g_negative if negative >= 0 else -g_negative) + decay * w

    w = _descend(gradient, xp.shape[1], rounds, 0.03)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null id has no label, so it is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of the texts of at most `most` ids, those with the smallest hashes; one text of a repeated id."""
    some = ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                texts = texts_of(batch.column("text").slice(a, 256))
                yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in texts], pa.binary())], ["x"])

    # At most `most` ids of 8 bytes, so the broadcast has a proven bound.
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = own.select("text").mapInArrow(run, "x binary").collect()
    return np.frombuffer(b"".join(sorted(bytes(r.x) for r in rows)), np.float32).reshape(len(rows), WIDTH)


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model | None:
    """Fit on texts of docs (doc_id, text): positives are rows of labels (doc_id, quality) with quality 1.

    Only ids outside the held-out fold are used, for positives and unlabelled texts alike; other labels are not read.
    None without a positive text. Null texts count as empty, very long ones are read whole, an empty table has no
    positive text, a repeated id counts once, and other columns are not read.
    """
    own = docs.filter(~held_out(F.col("doc_id")))
    good = labels.filter("quality = 1").select("doc_id").filter(~held_out(F.col("doc_id")))
    positive = _sample(own, good, most_positive)
    unlabelled = _sample(own, own.select("doc_id"), most_unlabelled)
    if not len(positive) or not len(unlabelled):
        return None
    # Rows come sorted; mixed by a fixed permutation so that halves are alike.
    rng = np.random.Generator(np.random.PCG64(7))
    return fit(positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))])


def score(docs: DataFrame, model: Model | None, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs and the score (replacing a column of its name): from the whole text and nothing else.

    Null counts as empty; without a model every score is 0.5. Rows are independent, so repeated rows score alike.
    """
    keep = [c for c in keep if c != name]
    has_text = "text" in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text" if has_text else "__text")
            for a in range(0, batch.num_rows, 256):
                some = texts_of(column.slice(a, 256))
                scores = model.score(np.array([features(t) for t in some])) if model else np.full(len(some), 0.5)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, 256) for c in keep], pa.array(scores, pa.float64())], [*keep, name])

    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(name, F.lit(0.0)).schema
    text = [] if has_text else [F.col("text").alias("__text")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], *text).mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
