"""Benchmark passages in documents, by a prefix-filtered containment join of shingles.

A window is a run of an item's words. A document contains it only if it contains all its
shingles, so of its shingles in order of rarity (occurrences in the documents, counted in
a first read) the prefix that must be joined is the first one. Where a document has
that shingle, its offset in the window fixes the only place the window can be
(positional bound), which must lie inside the document (length bound); there all words are
compared.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, each broadcast; a
benchmark of more words takes more reads of the documents.

Null and empty texts have no words. Repeated documents are reported once a row. Repeated
item ids count once; an item without an id marks words but is not listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import NOT_ALNUM_EITHER_CASE, U, as_bytes, blocks, shingles, words
from plumbline.llm.tables import for_workers

#: Words of benchmark items that are broadcast together: 8 bytes each, as often as windows overlap.
BLOCK_WORDS = 1_000_000
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 5
_SLOTS = 1 << 20


class Windows:
    """Distinct windows of a block of items, by length and by shingle."""

    def __init__(self, items: list[tuple], size: int):
        self.by_length: dict[int, list] = {}
        found: dict[int, dict[bytes, set[str]]] = {}
        for first, data, ends in blocks([t for _, t in items]):
            word, start, _ = words(data, NOT_ALNUM_EITHER_CASE)
            place = np.searchsorted(start, ends)
            for i, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
                length, name = min(size, int(b - a)), items[first + i][0]
                for p in range(a, b - length + 1) if length else ():
                    names = found.setdefault(length, {}).setdefault(word[p : p + length].tobytes(), set())
                    if name is not None:
                        names.add(name)
        for length, windows in sorted(found.items()):
            table = np.frombuffer(b"".join(windows), U).reshape(-1, length)
            k = min(SHINGLE, length)
            parts = np.stack([shingles(table[:, i : i + k].ravel(), k)[::k] for i in range(length - k + 1)], axis=1)
            self.by_length[length] = [table, list(windows.values()), k, parts]

    def sizes(self) -> list[int]:
        return sorted({k for _, _, k, _ in self.by_length.values()})

    def tokens(self, k: int) -> np.ndarray:
        return np.unique(np.concatenate([p.ravel() for _, _, j, p in self.by_length.values() if j == k]))

    def index(self, counts: dict[int, np.ndarray]) -> list[tuple]:
        """Per length: the windows sorted by their rarest shingle, and its offset in each."""
        out = []
        for length, (table, names, k, parts) in self.by_length.items():
            often = counts[k][np.searchsorted(self.tokens(k), parts)]
            offset = np.argmin(often, axis=1)
            anchor = parts[np.arange(len(parts)), offset]
            order = np.argsort(anchor, kind="stable")
            out.append((length, k, anchor[order], offset[order], table[order], [names[i] for i in order]))
        return out


def _filter(tokens: np.ndarray) -> np.ndarray:
    slots = np.zeros(_SLOTS, bool)
    slots[(tokens % U(_SLOTS)).astype(np.int64)] = True
    return slots


def _tally(tokens, sizes: list[int]):
    """Occurrences of the benchmark's shingles, summed in each task."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = tokens.value
        counts = {k: np.zeros(len(wanted[k]), np.int64) for k in sizes}
        slots = {k: _filter(wanted[k]) for k in sizes}
        for batch in batches:
            for _, data, ends in blocks(as_bytes(batch.column(0))):
                word, start, _ = words(data, NOT_ALNUM_EITHER_CASE)
                for k in sizes:
                    rolled = shingles(word, k)  # over the ends of texts too: this only orders
                    rolled = rolled[slots[k][(rolled % U(_SLOTS)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(wanted[k], rolled), len(wanted[k]) - 1)
                    at = at[wanted[k][at] == rolled]
                    counts[k] += np.bincount(at, minlength=len(counts[k]))
        for k, count in counts.items():
            at = np.flatnonzero(count)
            arrays = [np.full(len(at), k, np.int32), at, count[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k", "at", "n"])

    return tally


def _occurrences(word: np.ndarray, index: tuple, slots: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first word, window) of each place in ``word`` where a window stands."""
    length, k, anchors, offsets, table, _ = index
    rolled = shingles(word, k)
    at = np.flatnonzero(slots[(rolled % U(_SLOTS)).astype(np.int64)])
    low, high = np.searchsorted(anchors, rolled[at]), np.searchsorted(anchors, rolled[at], side="right")
    n = high - low
    place = np.repeat(at, n)
    window = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = place - offsets[window]
    inside = (begin >= 0) & (begin + length <= len(word))
    begin, window = begin[inside], window[inside]
    for i in range(0, len(begin), 1 << 16):
        b, w = begin[i : i + (1 << 16)], window[i : i + (1 << 16)]
        same = (word[b[:, None] + np.arange(length)] == table[w]).all(axis=1)
        yield from zip(b[same].tolist(), w[same].tolist(), strict=True)


def _judge(indexes):
    """Per row: its words, the first word of each run of hit words and the runs' ends, items."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = indexes.value
        slots = [_filter(x[2]) for x in held]
        for batch in batches:
            n_words, runs, items = [], [], []
            for _, data, ends in blocks(as_bytes(batch.column("_text"))):
                word, start, _ = words(data, NOT_ALNUM_EITHER_CASE)
                place = np.searchsorted(start, ends)
                for a, b in zip(place[:-1], place[1:], strict=True):
                    edge, names = np.zeros(b - a + 1, np.int32), set()
                    for x, s in zip(held, slots, strict=True):
                        if b - a >= x[0]:
                            for begin, window in _occurrences(word[a:b], x, s):
                                edge[begin] += 1
                                edge[begin + x[0]] -= 1
                                names |= x[5][window]
                    n_words.append(int(b - a))
                    hit = (np.cumsum(edge[:-1]) > 0).astype(np.int8) if names or edge.any() else np.zeros(0, np.int8)
                    cuts = np.flatnonzero(np.diff(hit, prepend=0, append=0)) if len(hit) else hit
                    runs.append(cuts.tolist())
                    items.append(sorted(names))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(n_words, pa.int64())]
                + [pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*batch.schema.names[:-1], "n_words", "runs", "items"],
            )

    return judge


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins what the blocks of the benchmark found in a row."""
    for batch in batches:
        hit, count, digest, found = [], [], [], []
        for n, runs, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "all_runs", "all_items")), strict=True):
            if len(runs) == 1:
                merged = runs[0]
            else:
                edge = np.zeros(n + 1, np.int32)
                for r in runs:
                    np.add.at(edge, r[::2], 1)
                    np.add.at(edge, r[1::2], -1)
                merged = np.flatnonzero(np.diff((np.cumsum(edge[:-1]) > 0).astype(np.int8), prepend=0, append=0)).tolist()
            names = sorted(set().union(*items))
            hit.append(sum(merged[1::2]) - sum(merged[::2]))
            count.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            found.append(merged)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 2))]
            + [pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(found, pa.list_(pa.int64()))],
            names=[*batch.schema.names[:-2], "n_hit", "n_items", "items_sha256", "runs"],
        )


def _judge_alone(indexes):
    """As ``_judge`` and ``_summary`` for the only block of a benchmark, in one worker a task: two steps
    on end would keep two at work, and an executor twice as many afterwards."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _judge(indexes)(batches):
            each = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(each, batch.column(c)) for c in ("runs", "items")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *lists], names=[*batch.schema.names[:-2], "all_runs", "all_items"])

    def judge_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summary(single(batches))

    return judge_alone


def _tokens_and_index(docs: DataFrame, items: list[tuple], size: int):
    """The block's windows by rarest shingle, broadcast."""
    context = docs.sparkSession.sparkContext
    windows = Windows(items, size)
    tokens = {k: windows.tokens(k) for k in windows.sizes()}
    counts = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
    if tokens:
        tally = docs.select("_text").mapInArrow(_tally(context.broadcast(tokens), list(tokens)), "k int, at long, n long")
        got = tally.groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
        for k in tokens:
            mine = got.filter(pc.equal(got.column("k"), k))
            counts[k][mine.column("at").to_numpy()] = mine.column("n").to_numpy()
    return context.broadcast(windows.index(counts))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", doc_id: str = "doc_id", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, runs (bounds of the
    runs of hit words, in words, end exclusive), contaminated."""
    docs = for_workers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text")))
    held = benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("t")).filter("t IS NOT NULL")
    total = held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] // 2
    n_blocks = max(1, -(-total // block_words))
    held = held.withColumn("block", F.pmod(F.xxhash64("id", "t"), F.lit(n_blocks)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, runs array<long>"
    row = F.monotonically_increasing_id().alias("_row")
    out = None
    for block in range(n_blocks):
        items = [(r.id, r.t.encode()) for r in held.filter(F.col("block") == block).select("id", "t").collect()]
        index = _tokens_and_index(docs, items, size)
        if n_blocks == 1:
            return docs.mapInArrow(_judge_alone(index), found).withColumn("contaminated", F.col("n_hit") > 0)
        schema = f"_row long, doc_id {id_type}, n_words long, runs array<long>, items array<string>"
        part = docs.select(row, "doc_id", "_text").mapInArrow(_judge(index), schema)
        out = part if out is None else out.union(part)
    # a row was read once for each block
    out = out.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("runs").alias("all_runs"), F.collect_list("items").alias("all_items")
    )
    out = out.select("doc_id", "n_words", "all_runs", "all_items")
    return out.mapInArrow(_summary, found).withColumn("contaminated", F.col("n_hit") > 0)


#: DuckDB SQL for the registered query, of ``documents`` and ``benchmark``.
SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS l, w[p:p + least(10, len(w)) - 1] AS s
    FROM (SELECT *, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (
    SELECT r, l, p, w[p:p + l - 1] AS s FROM (
        SELECT r, w, l, unnest(generate_series(1, len(w) - l + 1)) AS p
        FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
hit AS (SELECT dw.r, dw.p, dw.l, win.item_id FROM dw JOIN win ON dw.l = win.l AND dw.s = win.s),
per_words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + l - 1)) AS q FROM hit) GROUP BY r),
per_items AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_words USING (r) LEFT JOIN per_items USING (r)
"""
