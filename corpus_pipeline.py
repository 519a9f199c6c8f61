"""From raw documents to packed sequences: each stage reads what the one before it kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and is
the next one's ``docs``. All but the last return the columns of documents, and any further
columns of ``docs`` as they are, whatever their names.

Null texts, empty ones and such without a letter go with the first stage. An empty table passes
every stage as an empty table. Texts are read whole, however long.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, language, ngram_join, packing, secrets
from plumbline.llm.tables import fold, read, settle, shared_folder


#: The columns that stages may read.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(stage: Stage) -> Stage:
    """Columns that documents do not have get other names while the stage runs, so that they
    clash with none of its own, and their names back after it."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [n if n in COLUMNS else f"further_{i}" for i, n in enumerate(names)]
        found = stage(spark, docs.toDF(*plain), sf_dir)
        return found.toDF(*names) if found.columns == plain else found

    return run_stage


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key of id and text, so that null and repeated ids are told apart by their texts.
    Only rows of one id and one text share a key; what a stage decides is the same for these."""
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` without the rows of the given keys."""
    return keyed.join(settle(keys.select("_key").distinct()), "_key", "left_anti").select(*keyed.columns)


@_apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language, without text or a letter, go. The model learns from the same
    rows as in the registered query."""
    model = language.fit(docs.filter(fold("doc_id", 5) != 0))
    named = language.identify(docs, model, {c: F.col(c) for c in docs.columns})
    return named.filter(named[len(docs.columns)] != "und").select(*docs.columns)


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one document of the smallest id stays, a null id
    being the largest, in one row if id and text are repeated. Documents without words are
    nobody's duplicates."""
    keyed = _keyed(docs)
    found = settle(ngram_join.near_duplicates(keyed, doc_id="_key").select(F.col("doc_id").alias("_key"), "component_id"))
    groups, ids = found.distinct(), keyed.select("_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_key")).alias("first")
    stay = groups.join(ids, "_key").groupBy("component_id").agg(first).select("first._key")
    kept = _without(keyed, groups.join(stay, "_key", "left_anti"))
    repeated = settle(found.groupBy("_key").count().filter("count > 1").select("_key"))
    if not repeated.isEmpty():
        once = kept.join(repeated, "_key", "left_semi").select(*keyed.columns).dropDuplicates(["_key"])
        kept = _without(kept, repeated).union(once)
    return kept.select(*docs.columns)


@_apart
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    keyed = _keyed(docs)
    found = decontamination.contamination(keyed, read(spark, sf_dir, "benchmark"), doc_id="_key")
    return _without(keyed, found.filter("contaminated").withColumnRenamed("doc_id", "_key")).select(*docs.columns)


@_apart
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_apart
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, of every document that is left."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", hide_secrets),
    ("packing", pack),
]
#: Tokens and learned models can't be had in SQL; tests check what the stages from near duplicates
#: to secrets keep against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a table in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
