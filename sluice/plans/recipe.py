"""Recipes: short programs of operators, from YAML or JSON, resolved against a catalog, executed step by step."""

from __future__ import annotations

import copy
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.base import Context, cut
from sluice.operators.registry import Registry, default_registry
from sluice.plans.state import State, StateComputer, delta

#: Rows below which the rest of a recipe is skipped.
MIN_VIABLE = 500


@dataclass
class Step:
    operator: str
    params: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    enabled: bool = True

    @classmethod
    def of(cls, raw: dict[str, Any]) -> Step:
        raw = dict(raw)
        operator = raw.pop("operator", None) or raw.pop("type", None)
        if not operator:
            raise ValueError("a step without operator")
        return cls(operator, dict(raw.get("params") or {}), raw.get("name") or operator, bool(raw.get("enabled", True)))


@dataclass
class Recipe:
    name: str
    steps: list[Step]
    input_split: str = "train"

    @classmethod
    def of(cls, raw: dict[str, Any], catalog: dict[str, Any] | None = None) -> Recipe:
        steps = list(raw.get("steps") or [])
        if catalog and raw.get("operators"):
            steps = resolve(catalog, raw["operators"])
        return cls(raw.get("name") or "recipe", [Step.of(s) for s in steps], raw.get("input_split") or "train")

    @classmethod
    def load(cls, path: str, catalog: dict[str, Any] | None = None) -> Recipe:
        return cls.of(load_structured(path), catalog)

    def signature(self) -> str:
        """Equal for recipes that do the same: the enabled steps and their parameters."""
        return json.dumps([[s.operator, s.params] for s in self.steps if s.enabled], sort_keys=True)


def load_structured(path: str) -> dict[str, Any]:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def catalog_operators(catalog: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Operators of a catalog, in its order, from a map of operators or from families of them."""
    if "operators" in catalog:
        return dict(catalog["operators"])
    out: dict[str, dict[str, Any]] = {}
    for family in (catalog.get("families") or {}).values():
        ops = family.get("operators") or family.get("methods") or {}
        out |= dict(ops) if isinstance(ops, dict) else {o["name"]: o for o in ops}
    return out


def resolve(catalog: dict[str, Any], overrides: dict[str, dict[str, Any]]) -> list[dict[str, Any]]:
    """Steps of the catalog's operators that an override turns on, in the catalog's order; an unknown operator or
    parameter is an error."""
    known = catalog_operators(catalog)
    if unknown := [o for o in overrides if o not in known]:
        raise ValueError(f"Unknown operators: {', '.join(unknown)}")
    steps = []
    for name, spec in known.items():
        if name not in overrides:
            continue
        own = dict(overrides[name] or {})
        enabled = bool(own.pop("enabled", True))
        params = {k: v.get("default") if isinstance(v, dict) else v for k, v in (spec.get("params") or {}).items()}
        given = own.pop("params", own)
        if bad := [k for k in given if k not in params]:
            raise ValueError(f"Unknown parameters of {name}: {', '.join(bad)}")
        steps.append({"operator": name, "params": {k: v for k, v in (params | given).items() if v is not None}, "enabled": enabled})
    return steps


def clamp(catalog: dict[str, Any], operator: str, params: dict[str, Any]) -> dict[str, Any]:
    """Numbers within the catalog's ranges, whole where the default is; what it doesn't know passes."""
    spec = (catalog_operators(catalog).get(operator) or {}).get("params") or {}
    out = dict(params)
    for k, v in params.items():
        r = spec.get(k, {}).get("range") if isinstance(spec.get(k), dict) else None
        if r and len(r) == 2 and isinstance(v, (int, float)) and not isinstance(v, bool):
            v = min(max(v, r[0]), r[1])
            out[k] = round(v) if isinstance(spec[k].get("default"), int) else v
    return out


def deep_merge(base: dict[str, Any], patch: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(base)
    for k, v in patch.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


EVENTS = ("before_recipe", "after_recipe", "before_step", "after_step", "on_step_error")


class Hooks:
    """Objects with methods named as events; called with keywords, and what they raise goes on."""

    def __init__(self, hooks: list[Any] | None = None):
        self.hooks = list(hooks or [])

    def fire(self, event: str, **facts: Any) -> None:
        for h in self.hooks:
            if f := getattr(h, event, None):
                f(**facts)


class LoggingHook:
    def __init__(self, log: Callable[[str], None] = print):
        self.log = log

    def before_recipe(self, recipe: Recipe, **_: Any) -> None:
        self.log(f"recipe {recipe.name}: {len(recipe.steps)} steps")

    def after_step(self, step: Step, rows: int, **_: Any) -> None:
        self.log(f"step {step.name}: {rows} rows")


@dataclass
class Result:
    recipe: Recipe
    dataset: DataFrame
    rows: int
    initial: State
    final: State
    steps: list[dict[str, Any]]
    seconds: float

    def ids(self) -> DataFrame:
        return self.dataset.select("ord", "sample_id")

    def trace(self, task: str = "") -> dict[str, Any]:
        return {
            "task_name": task, "recipe_name": self.recipe.name, "input_split": self.recipe.input_split, "output_samples": self.rows, "initial_state": self.initial.as_dict(),
            "final_state": self.final.as_dict(), "total_wall_clock_sec": self.seconds, "steps": self.steps,
        }


class Executor:
    """Runs recipes over a fixed pool.

    Plans stay lazy inside a step.  After each step the narrow result is written out, so a step's counts, state and
    the next step read it instead of computing it again, and candidates that begin alike share those tables.
    """

    def __init__(self, pool: DataFrame, registry: Registry | None = None, *, min_viable: int = MIN_VIABLE, hooks: list[Any] | None = None, width: int = 0, ctx: Context | None = None, observe: bool = True):
        self.pool, self.registry, self.min_viable, self.hooks = pool, registry or default_registry(), min_viable, Hooks(hooks)
        self.ctx = ctx or Context(pool=pool)
        self.ctx.pool = pool
        self.observe = observe
        self.states = StateComputer(pool, width)
        self._prefixes: dict[str, tuple[DataFrame, int, dict]] = {}

    def run(self, recipe: Recipe) -> Result:
        steps = [s for s in recipe.steps if s.enabled]
        if not steps:
            raise ValueError("a recipe without enabled steps")
        began = time.time()
        self.hooks.fire("before_recipe", recipe=recipe)
        df, rows = self.pool, self.states.base["n"]
        initial = state = self.states.compute(df, same=True) if self.observe else State()
        done, prefix = [], []
        for index, step in enumerate(recipe.steps):
            if not step.enabled:
                continue
            self.hooks.fire("before_step", recipe=recipe, step=step, index=index)
            started = time.time()
            prefix.append([step.operator, step.params])
            key = json.dumps(prefix, sort_keys=True, default=str)
            shared = key in self._prefixes and step.operator != "union"
            try:
                if not shared:
                    op = self.registry.create(step.operator, **step.params)
                    out = cut(op.apply(df, self.ctx))
                    self._prefixes[key] = (out, out.count(), op.trace.as_dict())
                out, n, trace = self._prefixes[key]
            except Exception as e:
                self.hooks.fire("on_step_error", recipe=recipe, step=step, index=index, error=e)
                raise
            now = self.states.compute(out) if self.observe else State(retain_ratio=n / max(1, self.states.base["n"]))
            trace = copy.deepcopy(trace)
            trace["stats"] = {"input_samples": rows, "output_samples": n, "token_ratio": now.token_ratio}
            trace["cost"] = {"wall_clock_sec": time.time() - started, "shared": shared}
            done.append(
                {
                    "step_index": index, "step_name": step.name, "operator": step.operator, "state_before": state.as_dict(), "state_after": now.as_dict(),
                    "delta_loc": delta(now, state), "delta_glob": delta(now, initial), "trace": trace,
                }
            )
            df, rows, state = out, n, now
            self.hooks.fire("after_step", recipe=recipe, step=step, index=index, rows=n, state=now)
            if n < self.min_viable:
                break
        result = Result(recipe, df, rows, initial, state, done, time.time() - began)
        self.ctx.outputs[recipe.name] = result.ids()
        self.hooks.fire("after_recipe", recipe=recipe, result=result)
        return result


def manifest(df: DataFrame, recipe: Recipe) -> dict[str, Any]:
    """Counts by source and by task type, in order of their names, and the steps."""
    count = lambda c: {r[c]: r["count"] for r in sorted(df.groupBy(c).count().collect(), key=lambda r: str(r[c]))} if c in df.columns else {}
    return {"recipe_name": recipe.name, "sources": count("source_name"), "task_types": count("task_type"), "step_names": [s.name for s in recipe.steps if s.enabled]}


def safe_name(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_") or "unnamed"


def save(result: Result, folder: str, task: str = "") -> None:
    """Ids in order as a table, trace and manifest as JSON lines, under the recipe's name."""
    root = f"{folder}/{safe_name(result.recipe.name)}"
    spark = result.dataset.sparkSession
    result.ids().orderBy("ord").write.mode("overwrite").parquet(f"{root}/ids")
    for name, value in (("trace", result.trace(task)), ("manifest", manifest(result.dataset, result.recipe))):
        spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{name}")


def load_ids(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{safe_name(name)}/ids")


def source_entropy(df: DataFrame) -> DataFrame:
    """One row ``entropy``: of the shares of sources, in nats."""
    sizes = df.groupBy("source_name").count()
    total = sizes.agg(F.sum("count").alias("t"))
    p = F.col("count") / F.col("t")
    return sizes.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log(p + 1e-12)), F.lit(0.0)).alias("entropy"))
