"""Imports every query module and hands out the registry."""

from __future__ import annotations

import importlib
import pkgutil

import obsframe.plans as plans
from obsframe.plans.registry import CHECKS, QUERIES, Query

_HELPERS = {"registry", "binding", "catalog"}


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        if module.name not in _HELPERS:
            importlib.import_module(f"obsframe.plans.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
