"""All registered queries and their SQL."""

from __future__ import annotations

from contract import auditing, profiling, relating

MODULES = [profiling, relating, auditing]


def registered() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for module in MODULES:
        for name, entry in module.register().items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = entry
    return out
