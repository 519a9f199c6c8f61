"""Products ``c = a * b`` among columns that a few rows of numbers do not refute.

A row is a bounded sample's row, NaN where a value is missing. It can refute a claim on three columns
that are all filled in it. Claims are not listed and tested: of the first row that fills
three columns, each product of two is looked up among the sorted values, which yields the
few claims that this row lets stand; the other rows then thin these out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Claim = tuple[int, int, int]


def as_matrix(rows: Sequence[Sequence[float | None]], width: int) -> np.ndarray:
    matrix = np.full((len(rows), width), np.nan)
    for i, row in enumerate(rows):
        matrix[i] = [np.nan if x is None else x for x in row]
    return matrix


def surviving(rows: np.ndarray, tolerance: float) -> list[Claim]:
    """(target, left, right) of all claims that some row could test and none refutes; left < right."""
    slack = tolerance * (1 + 1e-9) + 1e-9
    filled = np.isfinite(rows)
    # rows that fill much and hold many different values come first: they leave the fewest claims
    variety = [len(np.unique(r[f])) for r, f in zip(rows, filled, strict=True)]
    order = np.lexsort((-np.array(variety, int), -filled.sum(axis=1)))
    rows, filled = rows[order], filled[order]
    seen: list[np.ndarray] = []
    left: list[Claim] = []
    for row, full in zip(rows, filled, strict=True):
        if any(not (full & ~s).any() for s in seen):
            continue  # another row has filled all of these together
        for claims in _lookups(row, np.flatnonzero(full), slack):
            for s in seen:
                claims = claims[:, ~s[claims].all(axis=0)]
            left += map(tuple, _thinned(claims, rows, slack).T.tolist())
        seen.append(full)
    return left


def _lookups(row: np.ndarray, columns: np.ndarray, slack: float):
    """Claims that the row lets stand, as (3, n) arrays, one for each left column."""
    at = columns[np.argsort(row[columns], kind="stable")]
    values = row[at]
    for k, a in enumerate(columns[:-1]):
        with np.errstate(over="ignore", invalid="ignore"):
            product = row[a] * row[columns[k + 1 :]]
            reach = slack + 4 * np.abs(np.spacing(product))
            low, high = np.searchsorted(values, product - reach), np.searchsorted(values, product + reach, "right")
        count = np.maximum(high - low, 0)
        b = np.repeat(columns[k + 1 :], count)
        steps = np.arange(len(b)) - np.repeat(np.cumsum(count) - count, count)
        c = at[np.repeat(low, count) + steps]
        apart = (c != a) & (c != b)
        yield np.stack([c[apart], np.full(int(apart.sum()), a), b[apart]])


def _thinned(claims: np.ndarray, rows: np.ndarray, slack: float) -> np.ndarray:
    """Claims that no row refutes."""
    for row in rows:
        if not claims.shape[1]:
            break
        with np.errstate(all="ignore"):
            gap = np.abs(row[claims[0]] - row[claims[1]] * row[claims[2]])
        claims = claims[:, ~(gap > slack)]
    return claims


def unseen(rows: np.ndarray) -> list[Claim]:
    """All claims on three columns that no row fills together."""
    filled = np.isfinite(rows)
    out, n = [], rows.shape[1]
    for a in range(n):
        with_a = filled[filled[:, a]].astype(np.float32)
        b, c = np.nonzero(with_a.T @ with_a == 0)
        apart = (b > a) & (c != a) & (c != b)
        out += [(int(z), a, int(y)) for y, z in zip(b[apart], c[apart], strict=True)]
    return out
