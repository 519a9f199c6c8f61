"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts is unlabelled, toxic ones among
them, whose share, the class prior, is estimated from the two samples. The risk of calling an unlabelled text toxic is the unlabelled risk less the share
the class prior leaves to positives, which is not let under zero: where a step would push
it there, it is undone instead (Kiryo et al., 2017). The classifier is linear over hashed
words and word beginnings that occur in a text, fitted with numpy on the driver on at most
``PER_CLASS`` positives and four times as many unlabelled ones; every text is scored.

Null and empty texts have no features and get the score of the offset alone. Without a
positive to learn from every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.hashing import NOT_ALNUM_EITHER_CASE, U, as_bytes, blocks, mix, words
from plumbline.llm.tables import bounded_sample, for_workers, unused

#: Bound of the sample that is fitted, slots that features are hashed to, features of the model.
PER_CLASS, SLOTS, MOST = 1500, 1 << 18, 1024
#: Bytes of the word beginnings.
BEGINNINGS = (4, 5, 6)


def features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Each text's distinct slots, of its words and of their beginnings."""
    for _, data, ends in blocks(texts):
        word, start, end = words(data, NOT_ALNUM_EITHER_CASE)
        place = np.searchsorted(start, ends)
        length = end - start
        parts = [word]
        for n in BEGINNINGS:
            value = np.full(len(start), n, U)
            for i in range(n):
                byte = data[np.minimum(start + i, len(data) - 1)].astype(U)
                byte = np.where((byte >= 65) & (byte <= 90), byte + U(32), byte)
                value = value * U(0x100000001B3) + byte
            value = mix(value)
            parts.append(np.where(length >= n, value, word))
        slots = (np.stack(parts) % U(SLOTS)).astype(np.int32)
        for a, b in zip(place[:-1], place[1:], strict=True):
            yield np.unique(slots[:, a:b])


class Model:
    """``slots`` (sorted), their weights, the offset."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400):
        n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
        in_p = np.bincount(np.concatenate([*positive, np.zeros(0, np.int32)]), minlength=SLOTS)
        in_u = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int32)]), minlength=SLOTS)
        # what tells the two sets apart best, in standard errors, among what is frequent enough to learn from
        share = (in_p + in_u) / (n_p + n_u)
        error = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-9
        apart = np.where(in_p + in_u >= 5, np.abs(in_p / n_p - in_u / n_u) / error, 0)
        self.slots = np.sort(np.argsort(-apart, kind="stable")[:MOST]).astype(np.int32)
        # inputs that tell little have little room to fit noise
        scale = (apart[self.slots] / max(1e-9, float(apart.max()))).astype(np.float32)
        x_p, x_u = self._dense(positive), self._dense(unlabelled)
        x_p *= scale
        x_u *= scale
        self.weights, self.offset = np.zeros(len(self.slots), np.float32), np.float32(0)
        first, second = np.zeros(len(self.slots) + 1, np.float32), np.zeros(len(self.slots) + 1, np.float32)
        for t in range(1, rounds + 1):
            # sigmoid loss: l(z) = 1 / (1 + exp(z)); its slope is -l(1 - l)
            l_p = 1 / (1 + np.exp(np.clip(x_p @ self.weights + self.offset, -30, 30)))
            l_u = 1 / (1 + np.exp(np.clip(x_u @ self.weights + self.offset, -30, 30)))
            d_p, d_u = l_p * (1 - l_p), l_u * (1 - l_u)
            negative = float((1 - l_u).mean()) - prior * float((1 - l_p).mean())
            up, uu = -prior * d_p / n_p, d_u / n_u
            if negative >= 0:
                slope = np.append(x_p.T @ (2 * up) + x_u.T @ uu, (2 * up).sum() + uu.sum())
            else:
                slope = -np.append(x_p.T @ up + x_u.T @ uu, up.sum() + uu.sum())
            slope[:-1] += 2e-5 * self.weights
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
            move = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            self.weights = (self.weights - move[:-1]).astype(np.float32)
            self.offset = np.float32(self.offset - move[-1])
        self.weights *= scale

    def _dense(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.slots)), np.float32)
        for i, row in enumerate(rows):
            out[i, self._mine(row)] = 1
        return out

    def _mine(self, row: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.slots, row), len(self.slots) - 1)
        return at[self.slots[at] == row]

    def score(self, row: np.ndarray) -> float:
        z = float(self.weights[self._mine(row)].sum(dtype=np.float64) + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [f.tobytes() for f in features(as_bytes(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("confirmed"), pa.array(data, pa.binary())], names=["confirmed", "data"])


def prior_of(positive: list[np.ndarray], unlabelled: list[np.ndarray], guess: float = 0.2, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, from both samples alone, and one standard error
    more, as a prior that is too small costs positives first. Each half of the rows is ranked by a model
    of the other, fitted with a guess. The share of unlabelled rows over a threshold is at least the
    prior times that of positives, with equality where only positives are left. The threshold is the one
    where that bound, with the error of both shares, is lowest (best bin estimation)."""
    order, sides = np.random.default_rng(5), [positive, unlabelled]
    if min(len(rows) for rows in sides) < 2:
        return guess
    half = [order.permutation(len(rows)) % 2 for rows in sides]
    ranks = [np.zeros(len(rows)) for rows in sides]
    for k in (0, 1):
        model = Model(*([row for row, h in zip(rows, of, strict=True) if h != k] for rows, of in zip(sides, half, strict=True)), guess)
        for rows, of, rank in zip(sides, half, ranks, strict=True):
            rank[of == k] = [model.score(rows[i]) for i in np.flatnonzero(of == k)]
    s_p, s_u = (np.sort(rank) for rank in ranks)
    n_p, n_u = len(s_p), len(s_u)
    over_p = 1 - np.searchsorted(s_p, s_p) / n_p
    over_u = 1 - np.searchsorted(s_u, s_p) / n_u
    error = np.sqrt(np.log(4 / doubt) / 2 / n_p) + np.sqrt(np.log(4 / doubt) / 2 / n_u)
    best = int(np.argmin((over_u + 1.01 * error) / over_p))
    q, u = over_p[best], over_u[best]
    spread = np.sqrt(u * (1 - u) / n_u + (u / q) ** 2 * q * (1 - q) / n_p) / q
    return float(np.clip(u / q + spread, 0.5 / n_u, 0.95))


def fit(docs: DataFrame, confirmed: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> Model | None:
    """``docs``: the rows to learn from, all of them unlabelled; ``confirmed``: doc_id and a boolean of
    the same name, true for the positives; its other rows say nothing. Nothing else is known of a row: no label says
    that it is not toxic, and the class prior is estimated. None without a positive. Where ids are
    repeated, so many of their rows as the bound lets are chosen by their features."""
    docs = for_workers(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    positive = bounded_sample(confirmed.filter("confirmed").select("doc_id", "confirmed"), "confirmed", per_class)
    other = bounded_sample(docs.select("doc_id", F.lit(False).alias("confirmed")), "confirmed", 4 * per_class)
    # at most 5 * per_class ids
    chosen = positive.union(other).distinct()
    found = docs.join(F.broadcast(chosen), "doc_id").select("confirmed", "text").mapInArrow(_featured, "confirmed boolean, data binary")
    got = bounded_sample(found, "confirmed", 4 * per_class, "data").orderBy("confirmed", F.xxhash64("data"), "data").toArrow()
    rows = {True: [], False: []}
    for is_confirmed, data in zip(got.column("confirmed").to_pylist(), got.column("data").to_pylist(), strict=True):
        rows[is_confirmed].append(np.frombuffer(data, np.int32))
    positives, unlabelled = rows[True][:per_class], rows[False]
    return Model(positives, unlabelled, prior_of(positives, unlabelled)) if positives else None


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            scores = [0.0 if m is None else m.score(f) for f in features(as_bytes(batch.column(batch.num_columns - 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return scored


def score(docs: DataFrame, model: Model | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and score, per row of ``docs``. No name in ``keep`` may be score;
    any other column of ``docs`` may have any name."""
    kept = for_workers(docs).select(*(c.alias(n) for n, c in keep.items()))
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).cast("string").alias(unused("_text", list(keep))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared), schema)
