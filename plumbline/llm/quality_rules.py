"""Quality rules: a decision list learned from labelled statistics of texts.

Sequential covering: a rule is grown on two thirds of the sample by adding the threshold
condition of the largest information gain until it covers no good text, and pruned on the
last third by dropping its last conditions. Texts a rule covers are taken out and the next
one is grown, until a pruned rule is right in less than ``PRECISION`` of the texts it
covers. The list is a chain of Spark conditional expressions over the statistics. It is
fitted on the driver, on statistics of at most ``PER_CLASS`` texts of either label.

Null and empty texts have all counts and shares 0 and fail the base rule. Repeated rows are
judged once a row. Without both labels to learn from, no rule is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from plumbline.llm.hashing import WHITE, as_bytes, blocks, shingles, words
from plumbline.llm.tables import bounded_sample, for_workers, unused

#: Bound of the sample that is fitted; least share of bad texts a rule may cover, and least number.
PER_CLASS, PRECISION, LEAST = 4000, 0.95, 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True  # fixed values of the contract
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "upper_share", "mark_share", "distinct_share", "top_share", "repeat_share", "neighbour_share", "mean_length", "dup_line_share")


def _repeated(rolled: np.ndarray, n_words: int, k: int = 5) -> int:
    """Words in windows that occur twice or more."""
    if len(rolled) < 2:
        return 0
    _, at, count = np.unique(rolled, return_inverse=True, return_counts=True)
    begin = np.flatnonzero(count[at] > 1)
    if not len(begin):
        return 0
    edge = np.zeros(n_words + 1, np.int64)
    edge[begin] += 1
    edge[begin + k] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1]) > 0))


def statistics(texts: list[bytes | None]) -> Iterator[tuple[int | float, ...]]:
    """Each text's COUNTS and SHARES."""
    for first, data, ends in blocks(texts):
        word, start, end = words(data, WHITE, fold=False)
        place, rolled = np.searchsorted(start, ends), shingles(word, 5)
        for i, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
            part = data[ends[i] : ends[i + 1] - 1]
            n, m = int(b - a), max(1, len(part))
            points = int(np.count_nonzero((part & 0xC0) != 0x80) - np.count_nonzero(WHITE[part]))
            symbols = int(np.count_nonzero(_SYMBOL[part]))
            lines = [x for x in (texts[first + i] or b"").split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            dup = len(lines) - len(set(lines))
            repeat = _repeated(rolled[a : max(a, b - 4)], n)
            mine = word[a:b]
            _, count = np.unique(mine, return_counts=True)
            w = max(1, n)
            yield (
                n,
                points,
                symbols,
                dup,
                repeat,
                symbols / m,
                float(np.count_nonzero(_UPPER[part])) / m,
                float(np.count_nonzero(_MARK[part])) / m,
                len(count) / w,
                float(count.max()) / w if n else 0.0,
                repeat / w,
                float(np.count_nonzero(mine[1:] == mine[:-1])) / w,
                points / w,
                dup / max(1, len(lines)),
            )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = COUNTS + SHARES
    for batch in batches:
        rows = list(zip(*statistics(as_bytes(batch.column(batch.num_columns - 1))), strict=True)) or [()] * len(names)
        arrays = [pa.array(x, pa.int64() if n in COUNTS else pa.float64()) for n, x in zip(names, rows, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], *names])


def measured(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of ``keep`` and the statistics, per row of ``docs``."""
    kept = for_workers(docs).select(*(c.alias(n) for n, c in keep.items()))
    fields = [StructField(n, LongType()) for n in COUNTS] + [StructField(n, DoubleType()) for n in SHARES]
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).cast("string").alias(unused("_text", list(keep))))
    return rows.mapInArrow(_measured, StructType([*kept.schema.fields, *fields]))


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, SHARES.index(self.statistic)]
        return column >= self.threshold if self.at_least else column <= self.threshold

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c >= self.threshold if self.at_least else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of the largest gain for bad texts until only they are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while (p := (inside & bad).sum()) and (inside & ~bad).any():
        n = (inside & ~bad).sum()
        now, best, gain = np.log2(p / (p + n)), None, 1e-9
        for i, name in enumerate(SHARES):
            value = x[inside, i]
            edges = np.unique(np.quantile(value, np.linspace(0, 1, 65)))
            edges = np.unique(np.concatenate([edges, (edges[1:] + edges[:-1]) / 2]))
            mine = bad[inside]
            order = np.argsort(value, kind="stable")
            sums = np.concatenate([[0], np.cumsum(mine[order])])
            low = np.searchsorted(value[order], edges, side="right")  # <= edge
            high = np.searchsorted(value[order], edges, side="left")  # < edge
            for at_least, p1, all1 in ((False, sums[low], low), (True, p - sums[high], len(value) - high)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p1 > 0, p1 * (np.log2(p1 / np.maximum(1, all1)) - now), 0)
                k = int(np.argmax(g))
                if g[k] > gain:
                    gain, best = float(g[k]), Condition(name, at_least, float(edges[k]))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule of the best (p - n) / (p + n); the shorter one of equal ones."""
    best, value = rule, -2.0
    for k in range(1, len(rule) + 1):
        inside = _covers(rule[:k], x)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if (v := (p - n) / (p + n) if p + n else -1.0) > value:
            best, value = rule[:k], v
    return best


def learn(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules, each of which says bad; what none covers is good."""
    order = np.random.default_rng(3).permutation(len(x))
    x, bad, third = x[order], bad[order], np.arange(len(x)) % 3 == 0
    left, rules = np.ones(len(x), bool), []
    while (left & bad & ~third).sum() >= LEAST:
        rule = _grow(x[left & ~third], bad[left & ~third])
        rule = _prune(rule, x[left & third], bad[left & third]) if rule else rule
        inside = _covers(rule, x) & left
        if not rule or (inside & bad).sum() < LEAST or (inside & bad).sum() < precision * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", per_class: int = PER_CLASS) -> list[Rule]:
    """``labels``: doc_id and label (1 good, 0 bad; others are left out) of the rows to learn from."""
    known = labels.select("doc_id", "label").filter("label IN (0, 1)")
    chosen = bounded_sample(known, "label", per_class).groupBy("doc_id").agg(F.max("label").alias("label"))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most 2 * per_class ids; where they are repeated, their rows are cut as well
    rows = docs.join(F.broadcast(chosen), "doc_id")
    found = measured(rows, {"label": F.col("label").cast("int")}).select("label", F.struct(*SHARES).alias("shares"))
    got = bounded_sample(found, "label", per_class, "shares").select("label", "shares.*").orderBy(*SHARES, "label").toArrow()
    x = np.stack([got.column(n).to_numpy() for n in SHARES], axis=1)
    bad = got.column("label").to_numpy() == 0
    return learn(x, bad) if 0 < bad.sum() < len(bad) else []


def verdict(rules: list[Rule]) -> Column:
    """True where no rule says bad: the list as one conditional expression, first rule first."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, the statistics, base_failed, kept."""
    rows = measured(docs, {"doc_id": F.col(doc_id)}, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
