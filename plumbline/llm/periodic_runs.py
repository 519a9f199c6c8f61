"""Stretches of words that repeat with a period, found by Baier's grouping of suffixes.

A run is a stretch of words with smallest period q, at least twice as long as q and no
shorter than ``least`` words, that no neighbouring word extends. Texts are independent, so
each is handled in the task that reads it, in memory in proportion to its words:

1. Every word of a run but those of one word pair at its middle stands beside the same
   neighbour again in that run. Stretches of ``least`` words or more with at most one word
   pair that the text has once therefore hold all runs, whole; prose has few of them.
2. The first phase of Baier's suffix sorter groups a stretch's suffixes by their longest
   Lyndon prefix: groups are taken from the greatest down, and each suffix's group is appended
   to that of the nearest smaller suffix before it. The lengths of the groups' prefixes are the
   Lyndon array. It is done for the words' order and for the opposite one.
3. Each run has a Lyndon root in one of the arrays. Roots are extended both ways by longest
   common extensions, each run once.

A null or empty text has no words and no runs; its collapsed text is empty. Repeated rows are
reported once a row, a null id stays null, an empty table gives an empty one, and other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.hashing import as_bytes
from plumbline.llm.tables import for_workers

#: Fewest words of a run.
LEAST = 12
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def longest_lyndon(word: list[int], n_symbols: int) -> list[int]:
    """Length of the longest Lyndon word that starts at each position. Symbols are
    0 … ``n_symbols`` - 1, in their order.

    ``group`` names the group of each suffix, ``below`` and ``above`` chain the groups by
    their prefixes. A suffix of the greatest group left finds the nearest one before it
    that is in a smaller group; k of them with the same one append their prefix k times to
    its own, which moves it to a new group just above its old one.
    """
    n = len(word)
    members: list[list[int] | None] = [[] for _ in range(n_symbols)]
    for i, symbol in enumerate(word):
        members[symbol].append(i)
    group, size = list(word), [1] * n_symbols
    below, above = list(range(-1, n_symbols - 1)), list(range(1, n_symbols + 1))
    before = [-2] * (n + 1)  # -2: not yet grouped; index -1, before the first, never is
    lengths = [1] * n
    g = n_symbols - 1
    while g >= 0:
        appended: dict[int, int] = {}
        for s in members[g]:
            if group[s] == g:
                lengths[s] = size[g]
                p = s - 1
                while before[p] != -2:
                    p = before[p]
                before[s] = p
                if p >= 0:
                    appended[p] = appended.get(p, 0) + 1
        members[g] = None
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in appended.items():
            moved.setdefault((group[p], times), []).append(p)
        for (old, times), suffixes in sorted(moved.items(), reverse=True):
            new = len(members)
            members.append(suffixes)
            size.append(size[old] + times * size[g])
            below.append(old)
            above.append(above[old])
            below[above[old]], above[old] = new, new
            for p in suffixes:
                group[p] = new
        g = below[g]
    return lengths


def _common(word: np.ndarray, i: int, j: int) -> int:
    """How long the suffixes at ``i`` < ``j`` are equal, compared in growing blocks."""
    done, block, limit = 0, 16, len(word) - j
    while done < limit:
        m = min(block, limit - done)
        differ = word[i + done : i + done + m] != word[j + done : j + done + m]
        if differ.any():
            return done + int(differ.argmax())
        done, block = done + m, 4 * block
    return limit


def runs_of(word: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` symbols."""
    n = len(word)
    values, word = np.unique(word, return_inverse=True)
    at, periods = [], []
    for ranked in (word, len(values) - 1 - word):
        at.append(np.arange(n))
        periods.append(np.array(longest_lyndon(ranked.tolist(), len(values)), np.int64))
    i, p = np.concatenate(at), np.concatenate(periods)
    # a root with no equal word a period on or back can't be in a run
    onward = (i + p < n) & (word[np.minimum(i + p, n - 1)] == word[i])
    back = (i > 0) & (word[np.maximum(i - 1, 0)] == word[i + p - 1])
    i, p = i[onward | back], p[onward | back]
    order = np.lexsort((i, p))
    mirrored = word[::-1]
    found, last = [], (0, 0, 0)
    for start, period in zip(i[order].tolist(), p[order].tolist(), strict=True):
        if period == last[2] and last[0] <= start and start + period <= last[1]:
            continue
        end = start + period + _common(word, start, start + period)
        # the words before both, read backwards: the later one comes first there
        start -= _common(mirrored, n - start - period, n - start)
        last = (start, end, period)
        if end - start >= max(least, 2 * period):
            found.append((start, end - start, period))
    return found


def _stretches(word: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches of words, outside of which there are no runs."""
    n = len(word)
    if n < least:
        return []
    _, pair, count = np.unique(word[:-1] * n + word[1:], return_inverse=True, return_counts=True)
    once = np.concatenate([[-1], np.flatnonzero(count[pair] == 1), [n - 1]])
    # from after a single pair, over the next one, to the first word of the one after that
    low, high = (once[:-2] + 1, once[2:] + 1) if len(once) > 2 else (once[:1] + 1, once[1:] + 1)
    merged: list[tuple[int, int]] = []
    long = high - low >= least
    for a, b in zip(low[long].tolist(), high[long].tolist(), strict=True):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


def runs_of_words(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for a, b in _stretches(word, least):
        found += [(a + start, length, period) for start, length, period in runs_of(word[a:b], least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one blank between them, without those of a run after its first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def _find(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in as_bytes(batch.column("text")):
                words = (text or b"").split()  # bytes part at blank and tab to carriage return alone
                found = runs_of_words(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return find


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, its runs, and its text with each run cut to its
    first period and white space to single blanks."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return for_workers(rows).mapInArrow(_find(least), _FOUND)


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    length, period = -F.col("longest.shorter"), F.col("longest.period")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text), where a tenth of the ids have a periodic end: from word a on, the p words
    from there repeat. Ids are told by crc32 of their decimal text, a null one by that of the empty text."""
    h = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    rows = rows.select("doc_id", "text", "words", "g", n.alias("n"), F.when(n > 0, (F.col("g") % n).cast("int")).alias("a"))
    a, n = F.col("a"), F.col("n")
    rows = rows.select("doc_id", "text", "words", "n", "a", (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    repeated = F.transform("words", lambda w, i: F.when(i >= a, F.get("words", a + (i - a) % F.col("p"))).otherwise(w))
    return rows.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
