"""Order of whole values among leading values that are known by prefix and digest only.

Frequencies carry a long text as its beginning and its digest. If a tie of count and
beginning crosses the border of the k leading values, the beginning does not say which of
the tied texts belong to them. :func:`_descend` then goes down the texts level by level: it counts
only texts that begin like the border does, by their next characters, keeps what sorts before
the border for good, and goes on with what still ties on it. Each level reads the columns in
question once and returns at most k + 1 short rows per column; a border that no tie crosses
costs nothing. Two different texts differ somewhere, so the descent ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Characters compared on a level are this many times those of the level before, up to a limit.
GROWTH, MOST_CHARS = 4, 8192

Texts = Callable[[Iterable[int]], DataFrame]


@dataclass(frozen=True)
class _Border:
    """Of column ``cid``, ``wanted`` texts that begin with ``prefix`` and occur ``count`` times are still sought."""

    cid: int
    count: int
    prefix: str
    wanted: int


def in_value_order(head: DataFrame, k: int, inline_chars: int, texts: Texts) -> DataFrame:
    """(cid, rank, value, count): the k leading values of each column, equal counts in the order
    of whole values.

    ``head`` has the k + 1 leading (cid, rank, value, digest, count) rows per column, where a value
    with a digest is only the beginning of a text; it should be settled. ``texts(cids)`` gives
    (cid, value) of the long texts of columns.
    """
    leading = head.where(f"rank BETWEEN 1 AND {k}").select("cid", "rank", "value", "digest", "count")
    # bounded by the schema: at most k + 1 beginnings per text column
    long = head.where("digest IS NOT NULL").select("cid", "rank", "value", "digest", "count").collect()
    columns = sorted({r["cid"] for r in long if r["rank"] <= k})
    if not columns:
        return leading.drop("digest")
    borders = _borders(long, k)
    spark, of_long = head.sparkSession, F.col("cid").isin(columns)
    rows = leading.where(of_long)
    if borders:
        open_ties = spark.createDataFrame([(b.cid, b.prefix, b.count) for b in borders], "cid int, value string, count bigint")
        tied = rows.where("digest IS NOT NULL").join(F.broadcast(open_ties), ["cid", "value", "count"])
        chosen = spark.createDataFrame(_descend(borders, k, inline_chars, texts), "cid int, digest string, count bigint")
        settled = rows.join(F.broadcast(tied.select("cid", "rank")), ["cid", "rank"], "left_anti")
        rows = settled.select("cid", "value", "digest", "count").unionByName(chosen.withColumn("value", F.lit(None).cast("string")))
    # at most k texts per column in question
    wanted = rows.where("digest IS NOT NULL").select("cid", "digest")
    whole = (
        texts(columns)
        .withColumn("digest", F.sha2("value", 256))
        .join(F.broadcast(wanted), ["cid", "digest"])
        .groupBy("cid", "digest")
        # one text per digest: the set has one element and aggregates by hash
        .agg(F.element_at(F.collect_set("value"), 1).alias("whole"))
    )
    shown = rows.join(whole, ["cid", "digest"], "left").select("cid", F.coalesce("whole", "value").alias("value"), "count")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("count"), "value"))
    ordered = shown.withColumn("rank", rank)
    return leading.where(~of_long).select("cid", "rank", "value", "count").unionByName(ordered)


def _borders(long: list[Row], k: int) -> list[_Border]:
    """Ties of count and beginning that hold the last leading value and the one after it."""
    out = []
    for after in (r for r in long if r["rank"] == k + 1):
        tied = [r for r in long if (r["cid"], r["count"], r["value"]) == (after["cid"], after["count"], after["value"])]
        if len(tied) > 1:
            out.append(_Border(after["cid"], after["count"], after["value"], len(tied) - 1))
    return out


def _descend(borders: list[_Border], k: int, chars: int, texts: Texts) -> list[tuple[int, str, int]]:
    """(cid, digest, count) of the texts that belong to the leading values."""
    chosen = []
    while borders:
        chars = min(GROWTH * chars, MOST_CHARS)
        placed = _level(borders, k, chars, texts)
        further = []
        for b in borders:
            rows = sorted((r for r in placed if r["cid"] == b.cid), key=lambda r: r["place"])
            last, inside = rows[b.wanted - 1]["piece"], b.wanted
            if len(rows) > b.wanted and rows[b.wanted]["piece"] == last:
                inside = next(i for i, r in enumerate(rows) if r["piece"] == last)
                further.append(_Border(b.cid, b.count, b.prefix + last, b.wanted - inside))
            chosen += [(b.cid, r["digest"], b.count) for r in rows[:inside]]
        borders = further
    return chosen


def _level(borders: list[_Border], k: int, chars: int, texts: Texts) -> list[Row]:
    """At most k + 1 (cid, place, piece, digest) rows per border: the distinct texts on it, in
    the order of their next ``chars`` characters. A text that ends first comes first."""
    table = [(b.cid, b.prefix, b.count) for b in borders]
    rows = texts([b.cid for b in borders])
    on_border = F.broadcast(rows.sparkSession.createDataFrame(table, "cid int, prefix string, times bigint"))
    piece = F.expr(f"substring(value, length(prefix) + 1, {chars})")
    pieces = (
        rows.join(on_border, "cid")
        .where(F.startswith("value", "prefix"))
        .select("cid", "times", piece.alias("piece"), F.sha2("value", 256).alias("digest"))
        .groupBy("cid", "times", "piece", "digest")
        .count()
        .where("count = times")
    )
    place = F.row_number().over(Window.partitionBy("cid").orderBy("piece", "digest"))
    return pieces.select("cid", "piece", "digest", place.alias("place")).where(F.col("place") <= k + 1).collect()
