"""Extension modules: operators, features, hooks and catalog patches from outside the package."""

from __future__ import annotations

import importlib
from dataclasses import dataclass, field
from types import ModuleType
from typing import Any

from pyspark.sql import DataFrame

from sluice.operators.registry import Registry
from sluice.plans.recipe import deep_merge


def module_names(raw: str | list[str] | None) -> list[str]:
    """Names in a comma-separated text or a list, each once, in order."""
    parts = raw.split(",") if isinstance(raw, str) else raw or []
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


@dataclass
class Extensions:
    modules: list[ModuleType] = field(default_factory=list)
    hooks: list[Any] = field(default_factory=list)

    def features(self, df: DataFrame, context: dict[str, Any] | None = None) -> DataFrame:
        """The pool after every module has added its feature columns."""
        for m in self.modules:
            if f := getattr(m, "precompute_features", None):
                df = f(df, context or {})
        return df

    def catalog(self, base: dict[str, Any]) -> dict[str, Any]:
        for m in self.modules:
            get = getattr(m, "get_operator_catalog_patch", None)
            base = deep_merge(base, (get() if get else getattr(m, "OPERATOR_CATALOG_PATCH", None)) or {})
        return base


def load(raw: str | list[str] | None, registry: Registry) -> Extensions:
    """Import the modules, let them register their operators, and gather their hooks."""
    out = Extensions()
    for name in module_names(raw):
        m = importlib.import_module(name)
        if f := getattr(m, "register_operators", None) or getattr(m, "register", None):
            f(registry)
        get = getattr(m, "get_recipe_hooks", None)
        hooks = get() if get else getattr(m, "RECIPE_HOOKS", None)
        if isinstance(hooks, str):
            raise TypeError(f"{name}: hooks are objects, not text")
        out.hooks += list(hooks) if isinstance(hooks, (list, tuple)) else [hooks] if hooks is not None else []
        out.modules.append(m)
    return out
