"""All queries of the library outside the optional text-corpus subpackage."""

from __future__ import annotations

import importlib

from tallyward.plans import registry

MODULES = ("profiling", "preparation", "detection", "audit", "reconciliation", "workflow", "credit", "files", "extras")
FLAGSHIP = "rsk_16_risk_pipeline"


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tallyward.plans.{m}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.SQL)
