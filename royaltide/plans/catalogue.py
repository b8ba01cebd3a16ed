"""All registered queries and their check SQL."""

from __future__ import annotations

import importlib

from royaltide.plans.common import Query

SECTIONS = (
    "sources", "quality", "features", "search", "textops", "lookups", "monitoring", "guardrails",
    "evaluation", "streams", "tablefuncs",
)


def _sections():
    return [importlib.import_module(f"royaltide.plans.{name}").CAT for name in SECTIONS]


def queries() -> dict[str, Query]:
    return {name: q for section in _sections() for name, q in section.queries.items()}


def checks() -> dict[str, str]:
    return {name: sql for section in _sections() for name, sql in section.checks.items()}
