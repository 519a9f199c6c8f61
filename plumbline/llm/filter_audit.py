"""What each filter of a chain removes, for every order of the chain, by decision diagrams.

A document's failures are a mask of bits. One read finds the masks of texts; documents are
counted by part and mask (at most 2^k rows a part), and each part's counts become a diagram: a
level for each filter, two branches a node, passing and failing, and the counts of all documents
below. All orders follow from one another by exchanging two neighbouring levels, which
rebuilds only the nodes of these two. Along an order's path of passing branches stand what a
filter keeps and, beside it, what it removes.

A document repeats an earlier one if a smaller id has the same text. Ids and texts are joined
on both, so that neither a text nor an id with a third of all rows makes one task.

A null text counts as empty, a null part as the empty part. A null id is nobody's smaller id,
has none itself, and no label. Rows that repeat id and text do not repeat each other. A document is good or
toxic if any label row of its id says so. Without documents there are no parts and no rows. Other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import settle

WORD = r"[^\x20\x09-\x0D]+"
#: The filters' letters; the last is the one for repeated texts.
FILTERS = "ABCDE"
_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> list[Column]:
    """Which of the filters A to D a text fails: few words, few distinct words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]


def failure_counts(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", good: str = "quality", toxic: str = "toxic"
) -> DataFrame:
    """(part, mask, docs, good, toxic): counts of documents by what they fail."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    bits = [fails.cast("int") * (1 << i) for i, fails in enumerate(text_failures(F.col("text")))]
    masked = rows.select("doc_id", "part", F.sha2("text", 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    # used three times; rows of one id and text are one from here on
    masked = settle(masked.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    first = masked.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    first = first.withColumn("is_first", F.lit(True))
    says = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    says = says.agg(F.max((F.col(good) == 1).cast("int")).alias("good"), F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    # null ids are dealt by their texts: they find no label
    known, unknown = masked.filter("doc_id IS NOT NULL"), masked.filter("doc_id IS NULL")
    known = known.join(first, ["digest", "doc_id"], "left").join(says, "doc_id", "left")
    repeats = F.when(F.col("is_first"), 0).otherwise(1 << (len(FILTERS) - 1))
    known = known.select("part", (F.col("mask") + repeats).alias("mask"), "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    unknown = unknown.select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    sums = [F.sum("n").alias("docs"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic"))]
    return known.unionByName(unknown).groupBy("part", "mask").agg(*sums)


class Node:
    """Counts of the documents below, and where those go that pass and fail the node's filter.
    A node without branches is a leaf."""

    __slots__ = ("counts", "passing", "failing")

    def __init__(self, counts: tuple[int, ...], passing: Node | None = None, failing: Node | None = None) -> None:
        self.counts, self.passing, self.failing = counts, passing, failing


class Diagram:
    """Counts by mask, as a diagram whose equal parts are one node."""

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: str) -> None:
        self.order = list(filters)
        self._leaves: dict[tuple[int, ...], Node] = {}
        self._inner: dict[tuple[int, int], Node] = {}
        nothing = (0,) * len(next(iter(counts.values()), ()))
        level = [self._leaf(counts.get(mask, nothing)) for mask in range(1 << len(filters))]
        while len(level) > 1:  # the highest bit, the last filter, is joined first
            half = len(level) // 2
            level = [self._node(level[m], level[m + half]) for m in range(half)]
        self.root = level[0]

    def _leaf(self, counts: tuple[int, ...]) -> Node:
        return self._leaves.setdefault(counts, Node(counts))

    def _node(self, passing: Node, failing: Node) -> Node:
        key = (id(passing), id(failing))
        if key not in self._inner:
            both = tuple(a + b for a, b in zip(passing.counts, failing.counts, strict=True))
            self._inner[key] = Node(both, passing, failing)
        return self._inner[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one after it."""

        def rebuilt(node: Node, depth: int) -> Node:
            p, f = node.passing, node.failing
            if depth:
                return self._node(rebuilt(p, depth - 1), rebuilt(f, depth - 1))
            return self._node(self._node(p.passing, f.passing), self._node(p.failing, f.failing))

        self.root = rebuilt(self.root, level)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, counts kept, counts removed) along the path of passing branches."""
        out, node = [], self.root
        for name in self.order:
            out.append((name, node.passing.counts, node.failing.counts))
            node = node.passing
        return out


def neighbour_swaps(n: int) -> list[int]:
    """Levels to exchange with the next one so that all n! orders come by, each once."""
    if n < 2:
        return []
    inner, out = neighbour_swaps(n - 1), []
    for turn in range(factorial(n - 1)):
        down = turn % 2 == 0  # the last filter walks up to the front, then back
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if turn < len(inner):
            out.append(inner[turn] + (1 if down else 0))
    return out


def part_steps(counts: pd.DataFrame) -> pd.DataFrame:
    """All steps of all orders of one part, of its rows of :func:`failure_counts`."""
    by_mask = {int(r.mask): (int(r.docs), int(r.good), int(r.toxic)) for r in counts.itertuples()}
    fails, alone = ({}, {})
    for i, name in enumerate(FILTERS):
        fails[name] = sum(c[0] for mask, c in by_mask.items() if mask >> i & 1)
        alone[name] = by_mask.get(1 << i, (0, 0, 0))[0]
    diagram, rows, shapley = Diagram(by_mask, FILTERS), [], dict.fromkeys(FILTERS, 0)
    for swap in [None, *neighbour_swaps(len(FILTERS))]:
        if swap is not None:
            diagram.swap(swap)
        order = "".join(diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            shapley[name] += removed[0]
            rows.append((order, step, kept[0], removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2]))
    names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    out = pd.DataFrame(rows, columns=names)
    out.insert(0, "part", counts["part"].iloc[0])
    out["shapley"] = [shapley[order[step - 1]] for order, step in zip(out["filter_order"], out["step"], strict=True)]
    return out


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Per part, order and step: documents kept, removed, failing but removed before, failing this
    filter only, good and toxic ones removed, and the filter's removals over all orders."""
    return failure_counts(docs, labels, **columns).groupBy("part").applyInPandas(part_steps, _STEPS)


_P = "('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)"
_JOINS = " ".join(f"JOIN f f{b} ON f{b}.n NOT IN ({', '.join(f'f{a}.n' for a in range(1, b))})" for b in range(2, 6))
_STEP_ROWS = " UNION ALL ".join(
    f"SELECT o, {i} AS step, f{i} AS bit, {'0' if i == 1 else ' | '.join(f'f{a}' for a in range(1, i))} AS before FROM orders" for i in range(1, 6)
)
#: DuckDB SQL for the registered query, of ``documents`` and ``labels``.
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM t LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(n, bit) AS (VALUES {_P}),
orders AS (SELECT {' || '.join(f'f{i}.n' for i in range(1, 6))} AS o, {', '.join(f'f{i}.bit AS f{i}' for i in range(1, 6))} FROM f f1 {_JOINS}),
s AS ({_STEP_ROWS}),
r AS (
    SELECT part, o, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN docs ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN docs ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN docs ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c CROSS JOIN s GROUP BY part, o, step, bit)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
