"""Quality of a text by a factorisation machine.

Inputs are hashed words that occur in a text, statistics of its structure in steps, and its
length in steps (metadata). Every input has a weight and a vector of ``FACTORS`` numbers; a
text's score is the offset, the weights and all products of two inputs' vectors, summed in
linear time: half of (square of the sum - sum of the squares) in each factor. Words
share one unit of length however many there are. Fitted with numpy on the driver, on at
most ``PER_CLASS`` texts of either label; every text is scored.

Null and empty texts have the inputs of an empty text. Without both labels to learn from
every score is the share of good ones, or 1 without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.llm.hashing import U, WHITE, as_bytes, blocks, shingles, words
from plumbline.llm.tables import bounded_sample, for_workers, unused

#: Bound of the sample that is fitted; slots of hashed words; factors; steps of a statistic.
PER_CLASS, SLOTS, FACTORS, STEPS = 2000, 1 << 14, 8, 16
_CLASS = np.zeros(256, np.int8)
for _name, _at in enumerate(("#*$%&|<>{}[]\\^~=_@", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?"), 1):
    _CLASS[list(_at.encode())] = _name
N_STATISTICS = 11


def _statistics(data: np.ndarray, word: np.ndarray, length: np.ndarray, rolled: np.ndarray) -> np.ndarray:
    """Shares and scaled sizes, each from 0 to 1."""
    n, m = max(1, len(data)), max(1, len(word))
    kind = np.bincount(_CLASS[data], minlength=5) / n
    lines = np.count_nonzero(data == 10) + 1
    _, count = np.unique(word, return_counts=True)
    top = count.max() / m if len(count) else 0
    twice = 1 - len(np.unique(rolled)) / max(1, len(rolled))
    neighbours = np.count_nonzero(word[1:] == word[:-1]) / m
    return np.array(
        [
            min(1, 4 * kind[1]),
            min(1, 4 * kind[2]),
            kind[3],
            min(1, 4 * kind[4]),
            len(count) / m,
            top,
            twice,
            neighbours,
            min(1, length.mean() / 16) if len(length) else 0,
            min(1, lines / m),
            min(1, np.log1p(len(data)) / 14),  # the text's size, as metadata would have it
        ]
    )


def inputs(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's slots and their values: the statistics' steps, then the words'."""
    for _, data, ends in blocks(texts):
        word, start, end = words(data, WHITE)
        place, length, rolled = np.searchsorted(start, ends), end - start, shingles(word, 5)
        for i, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
            stats = _statistics(data[ends[i] : ends[i + 1] - 1], word[a:b], length[a:b], rolled[a : max(a, b - 4)])
            steps = np.minimum((np.sqrt(stats) * STEPS).astype(np.int64), STEPS - 1) + STEPS * np.arange(N_STATISTICS)
            slots = np.unique(word[a:b] % U(SLOTS)).astype(np.int64) + STEPS * N_STATISTICS
            values = np.full(len(slots), 1 / np.sqrt(max(1, len(slots))))
            yield np.concatenate([steps, slots]), np.concatenate([np.ones(N_STATISTICS), values])


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, share: float, rounds: int = 12):
        """``share``: of good ones among all labelled texts, to which the sample is weighted."""
        size = STEPS * N_STATISTICS + SLOTS
        rng = np.random.default_rng(7)
        self.w = np.zeros(size)
        self.v = rng.normal(0, 0.02, (size, FACTORS))
        self.offset = float(np.log(share / (1 - share)))
        held = {"w": np.full(size, 1e-8), "v": np.full((size, FACTORS), 1e-8), "o": 1e-8}
        weight = np.where(good, share / good.mean(), (1 - share) / (1 - good.mean()))
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for batch in np.array_split(order, max(1, len(order) // 64)):
                slots = np.concatenate([rows[i][0] for i in batch])
                values = np.concatenate([rows[i][1] for i in batch])
                sizes = [len(rows[i][0]) for i in batch]
                first = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(batch)), sizes)
                scaled = self.v[slots] * values[:, None]
                total = np.add.reduceat(scaled, first)
                z = self.offset + np.add.reduceat(self.w[slots] * values, first)
                z = z + 0.5 * (total**2 - np.add.reduceat(scaled**2, first)).sum(axis=1)
                slope = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good[batch]) / len(batch)
                distinct, at = np.unique(slots, return_inverse=True)
                step_w = np.bincount(at, slope[owner] * values) + 1e-5 * self.w[distinct]
                each = slope[owner][:, None] * values[:, None] * (total[owner] - scaled)
                step_v = np.stack([np.bincount(at, each[:, f]) for f in range(FACTORS)], axis=1) + 1e-4 * self.v[distinct]
                held["w"][distinct] += step_w**2
                held["v"][distinct] += step_v**2
                held["o"] += slope.sum() ** 2
                self.w[distinct] -= 0.2 * step_w / np.sqrt(held["w"][distinct])
                self.v[distinct] -= 0.05 * step_v / np.sqrt(held["v"][distinct])
                self.offset -= 0.2 * slope.sum() / np.sqrt(held["o"])

    def score(self, slots: np.ndarray, values: np.ndarray) -> float:
        scaled = self.v[slots] * values[:, None]
        pairs = 0.5 * float((scaled.sum(axis=0) ** 2 - (scaled**2).sum(axis=0)).sum())
        z = self.offset + float(self.w[slots] @ values) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(inputs(as_bytes(batch.column("text"))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary())], names=["label", "data"]
        )


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> Model | float:
    """``labels``: doc_id and label (1 good, 0 not; others are left out) of the rows to learn from."""
    docs = for_workers(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select("doc_id", "label").filter("label IN (0, 1)")
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return 0.0 if set(counts) == {0} else 1.0
    chosen = bounded_sample(known, "label", per_class).groupBy("doc_id").agg(F.max("label").alias("label"))
    # at most 2 * per_class ids; where they are repeated, their rows are cut as well
    got = docs.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_featured, f"label {chosen.schema['label'].dataType.simpleString()}, data binary")
    got = bounded_sample(got, "label", per_class, "data").orderBy("label", "data").toArrow()
    rows = []
    for data in got.column("data").to_pylist():
        slots = np.frombuffer(data, np.int32).astype(np.int64)
        n = len(slots) - N_STATISTICS
        rows.append((slots, np.concatenate([np.ones(N_STATISTICS), np.full(n, 1 / np.sqrt(max(1, n)))])))
    good = got.column("label").to_numpy() == 1
    share = counts[1] / (counts[0] + counts[1])
    return Model(rows, good, share) if 0 < good.sum() < len(good) else share


def _scored(model):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            found = inputs(as_bytes(batch.column(batch.num_columns - 1)))
            scores = [m if isinstance(m, float) else m.score(*x) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return scored


def score(docs: DataFrame, model: Model | float, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and score, per row of ``docs``. No name in ``keep`` may be score;
    any other column of ``docs`` may have any name."""
    kept = for_workers(docs).select(*(c.alias(n) for n, c in keep.items()))
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).cast("string").alias(unused("_text", list(keep))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scored(shared), schema)
