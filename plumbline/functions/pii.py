"""Redaction of personal data as native column expressions.

Entities are replaced in a fixed order (cards before phone numbers, because a
phone shape also matches card digits).  The chain is plain ``regexp_replace``,
so it stays in generated code and runs over whole texts in one narrow stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity name -> pattern, in the order they are applied.
ENTITY_PATTERNS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "CREDIT_CARD": r"\b([0-9][ -]?){12,15}[0-9]\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b",
    "PHONE_NUMBER": r"\+?[0-9][0-9 ()-]{7,}[0-9]",
    "URL": r"https?://[^ ]+",
    "IBAN_CODE": r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}\b",
}
ENTITIES = tuple(ENTITY_PATTERNS)


def marker(entity: str) -> str:
    return f"[REDACTED:{entity}]"


def _may_hold(text: Column, entity: str) -> Column:
    """Cheap necessary condition, so most texts never meet the expensive patterns."""
    if entity == "EMAIL_ADDRESS":
        return text.contains("@")
    if entity == "URL":
        return text.contains("://")
    return text.rlike("[0-9]")


def _runs(entities: Sequence[str]) -> list[list[str]]:
    """Consecutive entities that share their necessary condition."""
    runs: list[list[str]] = []
    for entity in entities:
        kind = entity if entity in ("EMAIL_ADDRESS", "URL") else "digits"
        if runs and runs[-1][0] == kind:
            runs[-1].append(entity)
        else:
            runs.append([kind, entity])
    return [run[1:] for run in runs]


def _replaced(text: Column, entity: str) -> Column:
    return F.regexp_replace(text, ENTITY_PATTERNS[entity], marker(entity))


def redact(text: Column, entities: Sequence[str] = ENTITIES) -> Column:
    """Every recognised entity replaced by its marker; blank text unchanged."""
    for run in _runs(entities):
        out = text
        for entity in run:
            out = _replaced(out, entity)
        text = F.when(_may_hold(text, run[0]), out).otherwise(text)
    return text


def entity_counts(text: Column, entities: Sequence[str] = ENTITIES) -> dict[str, Column]:
    """How many replacements :func:`redact` makes, per entity.

    Each count looks at the text as the earlier entities left it, so a card
    number is not counted a second time as a phone number.
    """
    counts = {}
    for run in _runs(entities):
        possible, left = _may_hold(text, run[0]), text
        for entity in run:
            hits = F.regexp_count(left, F.lit(ENTITY_PATTERNS[entity]))
            counts[entity] = F.when(possible, hits).when(text.isNotNull(), 0)
            left = _replaced(left, entity)
        text = F.when(possible, left).otherwise(text)
    return counts
