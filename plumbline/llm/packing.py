"""Packing of tokenised documents into sequences along a space-filling curve.

Hashed words of a document are projected to a few dimensions by random signs; the Hilbert
index of that point orders documents so that neighbours share vocabulary. Ties go by the
text's hash and the id, so a group of copies can be dealt over several ranges.

A document's full runs of ``size`` tokens are sequences of their own. What is left of it is
laid behind its predecessor's rest on the curve, and the line of rests is cut every
``size`` tokens: only the last sequence of all has padding. Places on the line come from
sums for each range and a running sum over the ranges.

A null or empty text is one token, the end of a document. Repeated rows are packed once a
row. Tokens are counted on whole texts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.hashing import U, WHITE, as_bytes, blocks, constants, mix, words
from plumbline.llm.tables import for_workers, settle

DIMENSIONS, BITS = 4, 8
END = 0  # fixed: the id behind each document
_EDGE = constants(1, 5)[0]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points (n, d) of ``bits``-bit integers: Gray-code
    each level's orthant, exchanging and inverting the lower bits as the curve turns."""
    x = points.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def _points(word: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each text's sum of its words' signs, scaled by the root of their number, as
    integers that normally distributed values fill evenly."""
    n = np.diff(place)
    out = np.zeros((len(n), DIMENSIONS))
    for d in range(DIMENSIONS):
        total = np.concatenate([[0], np.cumsum(1 - 2 * ((word >> U(7 * d + 5)) & U(1)).astype(np.int64))])
        out[:, d] = total[place[1:]] - total[place[:-1]]
    z = out / np.sqrt(np.maximum(n, 1))[:, None]
    share = 1 / (1 + np.exp(-1.702 * np.clip(z, -6, 6)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


#: What a worker goes on to its next task with; the tokenizer itself, which is large, goes.
_KNOWN: dict[str, tuple] = {}


class Encoder:
    """Token ids of many texts. A pre-token never goes on behind a visible character that
    white space follows, so texts are cut there, and each distinct piece is encoded once for
    as long as it is remembered: pieces that follow each other may be encoded as one text,
    whose tokens' lengths in bytes tell them apart again."""

    #: Pieces remembered, about 30 bytes each.
    MOST = 1_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        # a character of a byte-level token stands for a byte
        self.bytes = np.zeros(1 << 16, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.forget()
        if path in _KNOWN:
            self.names, self.start, self.size, self.flat, self.seen = _KNOWN[path]

    def forget(self) -> None:
        self.names, self.start, self.size, self.flat = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.seen = np.zeros(0, bool)
        self.new: list[tuple] = []
        self.n_new = 0

    def block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of the whole block, where each text's begin, word hashes, each text's first word."""
        word, start, end = words(data, WHITE, fold=False)
        place = np.searchsorted(start, ends)
        # a piece is a word with the white space before it, from its text's beginning at most
        texts = np.arange(len(ends) - 1)
        owner = np.repeat(texts, np.diff(place))
        begin = np.maximum(np.concatenate([[0], end])[:-1], ends[owner]) if len(word) else start
        gap = start - begin
        # white space at the end of a text is a piece of its own
        last = np.where(np.diff(place) > 0, np.concatenate([[0], end])[place[1:]], ends[:-1])
        tails = last < ends[1:] - 1
        if tails.any():
            begin = np.concatenate([begin, last[tails]])
            stop = np.concatenate([end, (ends[1:] - 1)[tails]])
            gap = np.concatenate([gap, (ends[1:] - 1 - last)[tails]])
            owner = np.concatenate([owner, texts[tails]])
            body = np.concatenate([word, np.full(tails.sum(), 1, U)])
            order = np.lexsort((begin, owner))
            begin, stop, gap, owner, body = begin[order], stop[order], gap[order], owner[order], body[order]
        else:
            stop, body = end, word
        raw = data.tobytes()
        lead = np.where(gap == 0, 1, 256 + data[np.minimum(begin, len(data) - 1)].astype(np.int64)).astype(U)
        for i in np.flatnonzero(gap > 1):
            lead[i] = zlib.crc32(raw[begin[i] : begin[i] + gap[i]]) * 512 + int(gap[i]) % 512 + (1 << 42)
        name = mix(body + mix(lead * _EDGE))
        distinct, first, at = np.unique(name, return_index=True, return_inverse=True)
        # alone: what has no white space before it, or nothing else
        flat, origin, sizes = self.ids(distinct, begin[first], stop[first], (gap[first] == 0) | (body[first] == 1), raw)
        per_piece = sizes[at]
        # one place more for the end of each text, behind its last piece
        per_text = np.bincount(owner, weights=per_piece, minlength=len(texts)).astype(np.int64) + 1
        out_start = np.concatenate([[0], np.cumsum(per_text)])
        before = np.cumsum(per_piece) - per_piece
        out = np.full(out_start[-1], END, np.uint16)
        step = np.arange(per_piece.sum())
        out[step + np.repeat(owner, per_piece)] = flat[step + np.repeat(origin[at] - before, per_piece)]
        return out, out_start, word, place

    def ids(self, names: np.ndarray, begin: np.ndarray, stop: np.ndarray, alone: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids one behind the other, and each piece's place and number among them."""
        at = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        known = self.names[at] == names if len(self.names) else np.zeros(len(names), bool)
        start, size = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        self.seen[at[known]] = True
        single, joined = np.flatnonzero(~known & alone), np.flatnonzero(~known & ~alone)
        found = self.tokenizer.encode_batch_fast([raw[begin[i] : stop[i]].decode() for i in single], add_special_tokens=False)
        parts = [np.array(e.ids, np.uint16) for e in found]
        size[single] = [len(x) for x in parts]
        text = b"".join([raw[a:b] for a, b in zip(begin[joined].tolist(), stop[joined].tolist(), strict=True)])
        ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint16)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(stop[joined] - begin[joined])) + 1
        size[joined] = np.diff(ends, prepend=0)
        new = np.concatenate([single, joined])
        flat = np.concatenate([*parts, ids])
        start[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
        every = np.concatenate([self.flat, flat])
        self.new.append((names[new], size[new], flat))
        self.n_new += len(new)
        if self.n_new > max(50_000, len(self.names) // 4):
            self.remember()
        return every, start, size

    def remember(self) -> None:
        if len(self.names) + self.n_new > self.MOST:
            self.forget_unseen()
        names = np.concatenate([self.names, *(n for n, _, _ in self.new)])
        size = np.concatenate([self.size, *(s for _, s, _ in self.new)])
        fresh = np.concatenate([s for _, s, _ in self.new])
        start = np.concatenate([self.start, len(self.flat) + np.cumsum(fresh) - fresh])
        self.flat = np.concatenate([self.flat, *(f for _, _, f in self.new)])
        seen = np.concatenate([self.seen, np.zeros(self.n_new, bool)])
        self.names, order = np.unique(names, return_index=True)
        self.start, self.size, self.seen = start[order], size[order], seen[order]
        self.new, self.n_new = [], 0

    def forget_unseen(self) -> None:
        """Pieces that came again since this was done last stay, if they are no more than half of MOST."""
        keep = np.flatnonzero(self.seen)
        if 2 * len(keep) > self.MOST or len(keep) + self.n_new > self.MOST:
            keep = keep[:0]
        start, size = self.start[keep], self.size[keep]
        place = np.cumsum(size) - size
        self.flat = self.flat[np.arange(size.sum()) + np.repeat(start - place, size)]
        self.names, self.start, self.size, self.seen = self.names[keep], place, size, np.zeros(len(keep), bool)


_READ = "curve long, text_hash long, doc_id {id}, doc_tokens long, full array<long>, rest binary"


def _encode(path: str, size: int):
    """Per text: its place on the curve, the checksums of its full runs, the rest's ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for first, data, ends in blocks(as_bytes(batch.column("text"))):
                ids, start, word, place = encoder.block(data, ends)
                full, rest = [], []
                for a, b in zip(start[:-1], start[1:], strict=True):
                    cut = a + (b - a) // size * size
                    wide = ids[a:cut].astype("<u4").tobytes()
                    full.append([zlib.crc32(wide[i : i + 4 * size]) for i in range(0, len(wide), 4 * size)])
                    rest.append(ids[cut:b].astype("<u2").tobytes())
                n = len(ends) - 1
                total = np.concatenate([[0], np.cumsum(mix(word), dtype=U)]).astype(U)
                text_hash = (total[place[1:]] - total[place[:-1]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hilbert(_points(word, place))), pa.array(text_hash), batch.column("doc_id").slice(first, n)]
                    + [pa.array(np.diff(start)), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.binary())],
                    names=["curve", "text_hash", "doc_id", "doc_tokens", "full", "rest"],
                )
        _KNOWN[path] = (encoder.names, encoder.start, encoder.size, encoder.flat, encoder.seen)

    return encode


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range's number, and the full runs and rest tokens before each row in it."""
    part, runs, tokens = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        full = pc.list_value_length(batch.column("full")).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = pc.binary_length(batch.column("rest")).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(np.full(len(full), part, np.int32))]
            + [pa.array(runs + np.cumsum(full) - full), pa.array(tokens + np.cumsum(rest) - rest)],
            names=[*batch.schema.names[2:], "part", "runs_before", "tokens_before"],
        )
        runs, tokens = runs + int(full.sum()), tokens + int(rest.sum())


def _pieces(size: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out, rows = {n: [] for n in names}, []
            columns = (batch.column(c).to_pylist() for c in ("doc_tokens", "full", "rest", "run", "at", "runs"))
            for row, (n, full, rest, run, at, runs) in enumerate(zip(*columns, strict=True)):
                found = [(i * size, size, crc, run + i, 0) for i, crc in enumerate(full)]
                ids = np.frombuffer(rest, "<u2").astype("<u4")
                a = 0
                while a < len(ids):
                    b = min(len(ids), a + size - (at + a) % size)
                    found.append((len(full) * size + a, b - a, zlib.crc32(ids[a:b].tobytes()), runs + (at + a) // size, (at + a) % size))
                    a = b
                rows += [row] * len(found)
                for start, length, crc, sequence, offset in found:
                    for name, value in zip(names, (start, length, crc, n, sequence, offset), strict=True):
                        out[name].append(value)
            ids = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(out[n], pa.int64()) for n in names)], names=["doc_id", *names])

    return pieces


def pack(docs: DataFrame, size: int = 1024, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Pieces of the documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Sequences are numbered from 0 on."""
    docs = for_workers(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    # settled, or else finding the ranges' bounds would encode every text once more
    read = settle(docs.mapInArrow(_encode(path, size), _READ.format(id=kind)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = read.repartitionByRange(n, "curve", "text_hash", "doc_id").sortWithinPartitions("curve", "text_hash", "doc_id")
    schema = f"doc_id {kind}, doc_tokens long, full array<long>, rest binary, part int, runs_before long, tokens_before long"
    lined = settle(lined.mapInArrow(_running, schema))
    # a row for each range: as many as shuffle partitions
    sums = lined.groupBy("part").agg(F.sum(F.size("full")).alias("runs"), F.sum(F.length("rest") / 2).cast("long").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "part",
        F.coalesce(F.sum("runs").over(before), F.lit(0)).alias("run_0"),
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("token_0"),
        F.sum("runs").over(every).alias("runs"),
    )
    placed = lined.join(F.broadcast(sums), "part").select(
        "doc_id", "doc_tokens", "full", "rest", (F.col("runs_before") + F.col("run_0")).alias("run"), (F.col("tokens_before") + F.col("token_0")).alias("at"), "runs"
    )
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(_pieces(size), schema)
