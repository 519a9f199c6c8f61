"""Language identification in two steps: the family, then one-versus-one linear support
vector machines between the languages of that family.

Features are hashed n-grams of one to three UTF-8 bytes around words (digits and
punctuation count as gaps), as square roots of their shares. The machines are fitted with
numpy on the driver, on at most ``PER_LANGUAGE`` texts of each language; every text is scored.

A null text, and one without a letter, is ``und`` with score 0. Ties between languages go to
the first in alphabetical order. With nothing to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from plumbline.llm.hashing import as_bytes, blocks, gaps
from plumbline.llm.tables import bounded_sample, for_workers, unused

#: Bound of the sample that is fitted; slots of the hashed n-grams.
PER_LANGUAGE, SLOTS = 400, 2048
# Families of languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "da de en is nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "semitic": "ar he",
    "indic": "bn hi mr ne ur",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_GAP = gaps((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Letters are 1-26 in either case, bytes over 127 keep their value, gaps are 0.
_CODE = np.arange(256, dtype=np.int64)
_CODE[_GAP] = 0
_CODE[65:91] = _CODE[97:123] = np.arange(1, 27)


def features(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for _, data, ends in blocks(texts):
        code = np.concatenate([[0], _CODE[data], [0, 0]])
        # runs of gaps are one gap
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
        code, place = code[keep], np.concatenate([[0], np.cumsum(keep[1:-2])])[ends]
        a, b, c = code[:-2], code[1:-1], code[2:]
        two, three = a * 256 + b, (a * 256 + b) * 256 + c
        slots = np.stack([a, 256 + two * 40503 % 65537 % 640, 896 + (three * 2654435761 >> 7) % 1000003 % (SLOTS - 896)])
        for x, y in zip(place[:-1], place[1:], strict=True):
            count = np.bincount(slots[:, x:y].ravel(), minlength=SLOTS).astype(np.float32)
            count[0] = 0  # how many words there are says nothing
            yield np.sqrt(count / max(1.0, float(count.sum())))


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, cost: float = 10.0) -> np.ndarray:
    """Weights and offset of a linear machine, y in (-1, 1), classes weighted alike:
    subgradient descent over the whole sample with averaged steps on the squared hinge."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, velocity = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    step = 1.0 / (1.0 / cost + 4.0)
    for _ in range(rounds * 4):
        ahead = w + 0.9 * velocity
        slack = np.maximum(0, 1 - y * (x @ ahead))
        slope = ahead / cost / len(ahead) - 2 * (x.T @ (share * y * slack))
        velocity = 0.9 * velocity - step * slope
        w = w + velocity
    return w


def _one_versus_one(x: np.ndarray, names: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    kinds = sorted(set(names.tolist()))
    out = []
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            mine = (names == a) | (names == b)
            out.append((a, b, _svm(x[mine], np.where(names[mine] == a, 1, -1).astype(np.float32))))
    return out


class Model:
    def __init__(self, x: np.ndarray, languages: list[str]):
        names = np.array(languages, dtype=object)
        families = np.array([_FAMILY.get(n, n) for n in languages], dtype=object)
        self.families = sorted(set(families.tolist()))
        self.between = _one_versus_one(x, families)
        self.members = {f: sorted(set(names[families == f].tolist())) for f in self.families}
        self.inside = {f: _one_versus_one(x[families == f], names[families == f]) for f in self.families}

    @staticmethod
    def _choose(x: np.ndarray, kinds: list[str], machines: list) -> tuple[str, float]:
        """The kind of most votes, then of the widest margins; how sure its closest vote is."""
        votes, margins, least = dict.fromkeys(kinds, 0), dict.fromkeys(kinds, 0.0), dict.fromkeys(kinds, np.inf)
        for a, b, w in machines:
            margin = float(x @ w[:-1] + w[-1])
            votes[a if margin >= 0 else b] += 1
            for kind, m in ((a, margin), (b, -margin)):
                margins[kind] += m
                least[kind] = min(least[kind], m)
        best = min(kinds, key=lambda k: (-votes[k], -margins[k], k))
        return best, 1.0 if least[best] == np.inf else float(1 / (1 + np.exp(-4 * np.clip(least[best], -50, 50))))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, sure = self._choose(x, self.families, self.between)
        language, more = self._choose(x, self.members[family], self.inside[family])
        return language, sure * more


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [f.tobytes() for f in features(as_bytes(batch.column("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(data, pa.binary())], names=["lang", "data"])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the rows with a language and a letter; None without any. The sample is chosen by
    id before any text is read; where ids are repeated, so many of their rows as the bound lets
    are chosen by their features."""
    rows = for_workers(rows).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL")
    chosen = bounded_sample(rows.select("doc_id", "lang"), "lang", per_language).distinct()
    # as many ids as PER_LANGUAGE for each language
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")
    sample = bounded_sample(sample.mapInArrow(_featured, "lang string, data binary"), "lang", per_language, "data")
    got = sample.orderBy("lang", "data").toArrow()
    data = got.column("data").to_pylist()
    x = np.zeros((len(data), SLOTS), np.float32)
    for i, row in enumerate(data):
        x[i] = np.frombuffer(row, np.float32)
    known = x.any(axis=1)
    languages = [n for n, k in zip(got.column("lang").to_pylist(), known, strict=True) if k]
    return Model(x[known], languages) if languages else None


def _predicted(model):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            raw = as_bytes(batch.column(batch.num_columns - 1))
            names, scores = [], []
            for text, x in zip(raw, features(raw), strict=True):
                if m is None or text is None or not _LETTER.search(text.decode("utf-8", "replace")):
                    name, score = "und", 0.0
                else:
                    name, score = m.predict(x)
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"]
            )

    return predicted


def identify(docs: DataFrame, model: Model | None, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of ``keep``, lang_pred and score, per row of ``docs``. Names in ``keep`` must
    not be those two; any other column of ``docs`` may have any name."""
    kept = for_workers(docs).select(*(c.alias(n) for n, c in keep.items()))
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), F.col(text).cast("string").alias(unused("_text", list(keep))))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicted(shared), schema)
