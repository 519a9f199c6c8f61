"""CSV input, header clean-up, and result output."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.operators.redaction import redact_profile


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: bool = True,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV with types inferred from every row, or with a given schema.

    Inference reads the file once more; give a schema for large inputs.
    Delimiter and header are stated, not guessed.
    """
    reader = spark.read.option("sep", sep).option("header", header)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).option("samplingRatio", 1.0).csv(path)


def clean_headers(headers: Sequence[object]) -> list[str]:
    """Usable, distinct column names: blanks become ``col_{i}``, repeats get ``_1``, ``_2``.

    Names are distinct regardless of case, generated ones included.
    """
    names: list[str] = []
    taken: set[str] = set()
    for i, header in enumerate(headers):
        base = str(header).strip() if header is not None else ""
        base = base or f"col_{i}"
        name, n = base, 0
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        names.append(name)
    return names


def as_text(df: DataFrame) -> DataFrame:
    """The table with clean headers and every value as text, as a sheet import delivers it."""
    named = df.toDF(*clean_headers(df.columns))
    return named.selectExpr(
        *[f"{X.rendered(f.name, f.dataType)} AS {X.quoted(f.name)}" for f in named.schema.fields]
    )


def _cells(sep: str) -> Column:
    """Cells of ``line``. A quoted cell may hold the separator, and quotes that are doubled;
    a quote elsewhere is an ordinary character."""
    at = re.escape(sep)
    quoted, plain = r'"[^"]*+(?:""[^"]*+)*+"' + rf"(?={at}|\z)", rf"(?s:.*?)(?={at}|\z)"
    found = F.regexp_extract_all(F.concat(F.lit(sep), "line"), F.lit(f"{at}({quoted}|{plain})"), 1)
    bare = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(c.rlike(r'(?s)\A"[^"]*+(?:""[^"]*+)*+"\z'), bare(c)).otherwise(c))


def sheet(spark: SparkSession, lines: DataFrame, sep: str = ",") -> DataFrame:
    """Text table from (number, line) rows whose line 0 holds the headers.

    Short rows are padded with NULL; cells beyond the headers get columns named like
    blank headers, as many as the longest row needs (one more read of the lines).
    Values are split in the executors; the header line and a width reach the driver.
    """
    first = lines.where("number = 0").select(_cells(sep).alias("cells")).first()
    if first is None:
        raise ValueError("the sheet has no header line")
    headers = first["cells"] or []
    width = lines.where("number > 0").agg(F.max(F.size(_cells(sep)))).first()[0] or 0
    names = clean_headers([*headers, *[None] * (width - len(headers))])
    rows = lines.where("number > 0").select(_cells(sep).alias("cells"))
    return rows.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def write_cleaned(df: DataFrame, folder: str) -> str:
    """Write a cleaned table as CSV with headers; returns the new directory of part files."""
    path = f"{folder.rstrip('/')}/cleaned_{uuid.uuid4().hex[:8]}"
    df.write.option("header", True).csv(path)
    return path


def save_results(profile: DataFrame, findings: DataFrame, folder: str, raw: bool = False) -> dict[str, str]:
    """Persist the profile per table, redacted unless ``raw``, and the findings; returns their paths."""
    profile = profile if raw else redact_profile(profile)
    folder = folder.rstrip("/")
    paths = {"profile": f"{folder}/profile", "findings": f"{folder}/findings"}
    profile.write.partitionBy("table").parquet(paths["profile"])
    findings.write.json(paths["findings"])
    return paths
