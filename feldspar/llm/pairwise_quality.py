"""Bradley-Terry quality classifier: scores learned from preference pairs.

Each document is a vector of figures about its whole text. A better and a worse labelled document make a preference
pair; logistic loss on the difference of their vectors gives weights, and a document's strength is the weighted sum. The
threshold is a quantile of the labelled strengths: the part of them labelled 1 lies above it. A score is the logistic
function of the distance to the threshold, so 0.5 is the threshold.

Edge cases: null and empty texts have a vector of zeros and get a score; null ids are never labelled; a doc_id with
several labels counts with each; with labels of one kind only, or none, every score is that kind's (1 without any).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Punctuation and symbols whose parts of a text are figures of their own.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}"


def figures(text: bytes) -> np.ndarray:
    """The vector of one UTF-8 text; zeros if it has no words."""
    out = np.zeros(20 + len(MARKS))
    words = text.split()
    if not words:
        return out
    n, chars = len(words), len(text)
    byte = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    marks = byte[list(MARKS)]
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = [x[-1:] in b".!?\"" for x in lines]
    firsts = {w[:1] for w in words}
    lengths = np.fromiter(map(len, words), float, n)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    lower, upper, digit = byte[97:123].sum(), byte[65:91].sum(), byte[48:58].sum()
    out[:20] = (
        1, np.log1p(n), np.log1p(chars), min(n, 50) / 50, lengths.mean(), lengths.std(), lower / chars, upper / chars, digit / chars, byte[128:].sum() / chars,
        marks.sum() / chars, len(set(words)) / n, pairs, len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(ends) / len(lines),
        upper / max(1, upper + lower), (lengths == 1).mean(), len(firsts) / min(n, 256), (lengths > 20).mean(),
    )
    out[20:] = np.sqrt(marks / n)
    return out


@dataclass(frozen=True)
class BradleyTerry:
    """Weights of standardised figures, and the threshold of the strength."""

    mean: list[float]
    spread: list[float]
    weights: list[float]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - np.array(self.mean)) / np.array(self.spread)) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(strength - self.threshold, -500, 500)))

    def to_json(self) -> str:
        return json.dumps(self.__dict__)


def fit(x: np.ndarray, good: np.ndarray, *, pairs: int = 100_000, penalty: float = 1e-3, steps: int = 25, seed: int = 7) -> BradleyTerry:
    """Learn from ``pairs`` seeded preference pairs by Newton steps on the logistic loss of figure differences."""
    d = x.shape[1]
    if good.all() or not good.any():
        return BradleyTerry([0.0] * d, [1.0] * d, [0.0] * d, -30.0 if good.all() else 30.0)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1
    z, random = (x - mean) / spread, np.random.default_rng(seed)
    diff = z[random.choice(np.flatnonzero(good), pairs)] - z[random.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d)
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))  # probability given to the wrong order
        gradient = -(diff * p[:, None]).mean(axis=0) + penalty * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + penalty * np.eye(d)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    strength = z @ w
    at = 1 - good.mean()
    # halfway between the strengths on both sides of the quantile
    threshold = (np.quantile(strength, at, method="lower") + np.quantile(strength, min(1.0, at + 1 / len(x)), method="higher")) / 2
    return BradleyTerry(mean.tolist(), spread.tolist(), w.tolist(), float(threshold))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_labels: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> BradleyTerry:
    """Fit on the labelled rows that aren't held out; of more than ``max_labels``, on those with the smallest hashes of their ids."""
    order = F.xxhash64("__id")
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
    known = known.where(F.col("__id").isNotNull() & F.col("__label").isin(0, 1) & ~held_out(F.col("__id"))).orderBy(order, "__id", "__label").limit(max_labels)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [figures(t or b"").tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__label"), pa.array(x, pa.list_(pa.float64()))], names=["__id", "__label", "x"])

    found = texts.join(F.broadcast(known), "__id").select("__id", "__label", "text")  # known: max_labels rows at most
    found = found.mapInArrow(rows, "__id long, __label int, x array<double>").orderBy(order, "__id", "__label", "x").limit(max_labels).collect()
    if not found:
        d = len(figures(b""))
        return BradleyTerry([0.0] * d, [1.0] * d, [0.0] * d, -30.0)
    return fit(np.array([r.x for r in found]), np.array([r["__label"] == 1 for r in found]), **options)


def score(docs: DataFrame, model: BradleyTerry, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; a narrow pass over the whole texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = model.score(np.array([figures(t or b"") for t in part.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype("i4"))], names=["doc_id", "held_out", "score", "predicted"])

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return taken.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
