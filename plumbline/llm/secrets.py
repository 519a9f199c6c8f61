"""Secrets in texts, told from copied examples by who owns a value across the corpus.

DataFrame functions only. One read finds each row's matches: positions come from the
lengths of what ``split`` leaves between the matches of a pattern. Values are hashed and
counted by distinct repositories and owners, first by (value, owner, repository), then by
(value, owner), then by value, each step combined before its shuffle, so that a value
in a third of all rows is one row per task. A value of more than ``max_owners`` owners
or in more than ``max_repositories`` repositories is a widely copied example, also where one owner
has all of them; one of few owners and repositories is taken as live.

The three base kinds are always spans. The further kinds are spans where their value is live.

In the registered query a document is a repository of its own, as the table names none; ``repository``
takes the column of one where there is one. A null text counts as empty; null repositories and owners are one unknown each. Repeated
rows are reported once a row. Matches may overlap between kinds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import settle, unused


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value (0: all), the value's least length,
    and a cheap test that every text with a match passes."""

    name: str
    pattern: str
    group: int
    least: int
    hint: str


# The base kinds, in the order their spans are listed.
BASE = (
    Kind(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        r"(?i)passw|secret|token|key",
    ),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32}"),
)
# A private key's body goes to its END line, past single dashes of header lines; without one, over
# lines of base64, parted by white space or escaped line ends. However long it is: a possessive
# group is matched in a loop, without a frame for each repetition.
_BEGIN, _END = "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----END [A-Z ]*PRIVATE KEY-----"
_CLOSED = rf"[^-]*+(?:-[^-]++)*+(?={_END})"
_OPEN = r"(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{1,15}+={1,2}+)?+"
#: What the method adds: credentials that a format alone makes likely.
FURTHER = (
    Kind("bearer", r"\b[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 27, "[Bb]earer"),
    Kind("prefixed", r"\b(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 15, "gh[pousr]_|xox[abprs]-|sk_live_"),
    Kind("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, "eyJ"),
    Kind("pem", f"{_BEGIN}({_CLOSED}|{_OPEN})(?:{_END})?", 1, 30, "PRIVATE KEY"),
)
_NONE = "array<struct<start: long, kind: int, end: long, name: string, value: string>>"
_JUDGED = "array<struct<start: long, kind: int, end: long, name: string, owners: long, repositories: long, live: boolean>>"


def matches(text: Column, kind: Kind, rank: int) -> Column:
    """The leftmost, non-overlapping matches whose value is long enough: positions in code points."""
    pattern = F.lit(kind.pattern)
    parts, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else found

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("kind"), end.alias("end"), F.lit(kind.name).alias("name"), F.sha2(x["value"], 256).alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= kind.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    gaps = F.transform(F.slice(parts, 1, F.size(found)), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("whole"), values.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_NONE).alias("spans"))
    return F.when(text.rlike(kind.hint), F.aggregate(rows, start, step)["spans"]).otherwise(F.array().cast(_NONE))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "doc_id", owner: str = "source", max_owners: int = 2, max_repositories: int = 10
) -> DataFrame:
    """Per row of ``docs``: its id, the hash of its text, base spans, all spans, how many
    spans hold a live value and a widely copied one, and of each span, by how many owners and
    repositories it was judged."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.xxhash64(body).alias("text_hash"),
        *(matches(body, k, i).alias(k.name) for i, k in enumerate(BASE + FURTHER)),
    )
    found = settle(
        found.select(
            "doc_id",
            "repository",
            "owner",
            "text_hash",
            F.array_sort(F.concat(*(F.col(k.name) for k in BASE))).alias("base"),
            F.array_sort(F.concat(*(F.col(k.name) for k in FURTHER))).alias("further"),
        )
    )
    spans = found.select("doc_id", "text_hash", "repository", "owner", F.explode(F.concat("base", "further")).alias("s"))
    spans = spans.withColumn("value", F.col("s.value"))
    owners = (
        spans.groupBy("value", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("value", "owner")
        .agg(F.count("*").alias("repositories"))
        .groupBy("value")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    )
    # as a table, so that both sides of the join come from shuffles, whose large partitions Spark splits
    judged = spans.join(settle(owners), "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    per_row = judged.groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.when(F.col("live") & (F.col("s.kind") >= len(BASE)), F.col("s")))).alias("added"),
        F.size(F.collect_set(F.when(F.col("live"), F.col("s")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(~F.col("live"), F.col("s")))).cast("long").alias("n_copied"),
        F.array_sort(F.collect_set(F.struct("s.start", "s.kind", "s.end", "s.name", "owners", "repositories", "live"))).alias("judged"),
    )
    per_row = per_row.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return found.join(per_row, same, "left").select(
        "doc_id",
        "text_hash",
        "base",
        F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_NONE)))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("judged", F.array().cast(_JUDGED)).alias("judged"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The registered query's columns."""
    counts = [F.size(F.filter("base", lambda s: s["name"] == name)).cast("long").alias(f"n_{name}") for name in (k.name for k in BASE)]
    shown = [F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")]
    return found.select("doc_id", *counts, *shown, "n_live", "n_copied")


def redacted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span of a text replaced by ``mark``; other rows as they are."""
    found = scan(docs, text, doc_id, **options).filter(F.size("spans") > 0)
    key, code, places = (unused(n, docs.columns) for n in ("_id", "_hash", "_spans"))
    found = found.select(F.col("doc_id").alias(key), F.col("text_hash").alias(code), F.transform("spans", lambda s: F.struct(s["start"], s["end"])).alias(places))
    found = found.dropDuplicates([key, code])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    both = docs.join(found, docs[doc_id].eqNullSafe(F.col(key)) & (F.xxhash64(body) == F.col(code)), "left")
    t = F.col(text)

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(t, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        new = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, F.concat(state["text"], gap, F.lit(mark))).otherwise(state["text"]).alias("text"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    done = F.aggregate(places, start, step)
    rest = F.concat(done["text"], F.substring(t, (done["at"] + 1).cast("int"), F.length(t)))
    return both.withColumn(text, F.when(F.col(places).isNull(), t).otherwise(rest)).select(*docs.columns)


def _kind_sql(kind: Kind, rank: int) -> str:
    pattern, value = kind.pattern.replace("'", "''"), "value"
    if kind.name == "pem":  # DuckDB's patterns do not look ahead: the END line is cut off the value
        pattern = f"{_BEGIN}(?:[^-]*(?:-[^-]+)*{_END}|{_OPEN_SQL})"
        value = f"regexp_replace(regexp_replace(whole, '^{_BEGIN}', ''), '{_END}$', '')"
    values = f"regexp_extract_all(t, '{pattern}', {kind.group if kind.name != 'pem' else 0})"
    return f"""
    SELECT r, {rank} AS kind, '{kind.name}' AS name, {value} AS value, "end" - length(whole) AS start, "end" FROM (
        SELECT r, whole, value, CAST(sum(gap + length(whole)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS "end" FROM (
            SELECT r, unnest(range(len(m))) AS i, unnest(m) AS whole, unnest(v) AS value, length(unnest(p[1:len(m)])) AS gap FROM (
                SELECT r, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, {values} AS v FROM d)))
    WHERE length({value}) >= {kind.least}"""


_OPEN_SQL = r"(?:(?:[\x09-\x0D\x20]|\\[nr])*[A-Za-z0-9+/]{16,}={0,2})*(?:(?:[\x09-\x0D\x20]|\\[nr])*[A-Za-z0-9+/]{1,15}={1,2})?"
#: DuckDB SQL for the registered query, of ``documents``.
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
s AS ({" UNION ALL ".join(_kind_sql(k, i) for i, k in enumerate(BASE + FURTHER))}),
o AS (
    SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners,
        count(DISTINCT coalesce('=' || source, '') || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '')) AS repositories
    FROM s JOIN d USING (r) GROUP BY value),
j AS (SELECT s.*, owners <= 2 AND repositories <= 10 AS live, name || ':' || start || ':' || "end" AS shown FROM s JOIN o USING (value)),
g AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base,
        string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)} OR live) AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
    FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (r)
"""
