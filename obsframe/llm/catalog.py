"""Hands out the queries of this subpackage."""

from __future__ import annotations

from obsframe.llm import queries as _queries  # noqa: F401  registers them
from obsframe.llm.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
