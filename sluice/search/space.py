"""The space of recipes: families, parameter ranges, edits, warm-up recipes and their encoding as vectors."""

from __future__ import annotations

import random
from dataclasses import dataclass
from typing import Any

import numpy as np

from sluice.operators.registry import OFFICIAL
from sluice.plans.recipe import Recipe, Step, catalog_operators

#: Operators that warm-up designs leave out: they need an earlier recipe, or scale with the pool.
NOT_SAMPLED = ("union", "semdedup")
#: Operators that stand for each other; any other is of no family.
FAMILIES = {
    "source_mixing": ("source_mix", "truncate_samples", "varentropy_mix"),
    "task_relevance_selection": ("mona_filter", "ifd_filter", "ngram_entropy", "action_object_branching", "varentropy_filter"),
    "dedup_or_redundancy_control": ("semantic_dedup", "semdedup"),
    "set_operations": ("union",),
}
FRACTION_OPERATORS = ("mona_filter", "ifd_filter", "ngram_entropy", "action_object_branching", "varentropy_filter")


def family_of(operator: str) -> str:
    return next((f for f, ops in FAMILIES.items() if operator in ops), "unknown")


def operator_space(extra: tuple[str, ...] = (), sampled: bool = False) -> tuple[str, ...]:
    """The official operators in order, then the others; with ``sampled`` those that designs may draw."""
    out = tuple(dict.fromkeys((*OFFICIAL, *extra)))
    return tuple(o for o in out if o not in NOT_SAMPLED) if sampled else out


@dataclass(frozen=True)
class Action:
    kind: str  # enable, disable, method, adjust
    operator: str
    param: str | None = None
    value: Any = None

    def apply(self, recipe: Recipe, name: str) -> Recipe:
        steps = [Step(s.operator, dict(s.params), s.name, s.enabled) for s in recipe.steps]
        mine = next((s for s in steps if s.operator == self.operator), None)
        if self.kind == "enable":
            if mine is None:
                steps.append(Step(self.operator, dict(self.value or {}), self.operator))
            else:
                mine.enabled = True
        elif mine is not None and self.kind == "disable":
            mine.enabled = False
        elif mine is not None and self.kind == "method":
            mine.operator, mine.name, mine.params = self.value, self.value, {}
        elif mine is not None:
            mine.params[self.param] = self.value
        return Recipe(name, steps, recipe.input_split)


def actions(recipe: Recipe, catalog: dict[str, Any], share: float = 0.1) -> list[Action]:
    """Edits of a recipe: switch operators on and off, change the method in a family, move a number by a share of its
    range within it.  A parameter that the recipe doesn't set isn't moved."""
    known = catalog_operators(catalog)
    out: list[Action] = []
    on = {s.operator: s for s in recipe.steps if s.enabled}
    for op, spec in known.items():
        params = spec.get("params") or {}
        if op not in on:
            out.append(Action("enable", op, value={k: v["default"] for k, v in params.items() if isinstance(v, dict) and v.get("default") is not None}))
            continue
        out.append(Action("disable", op))
        out += [Action("method", op, value=other) for other in FAMILIES.get(family_of(op), ()) if other != op and other in known and other not in on]
        for k, v in params.items():
            r, now = v.get("range") if isinstance(v, dict) else None, on[op].params.get(k)
            if not r or len(r) != 2 or not isinstance(now, (int, float)) or isinstance(now, bool):
                continue
            step = (r[1] - r[0]) * share
            for to in (now - step, now + step):
                to = min(max(to, r[0]), r[1])
                to = round(to) if isinstance(v.get("default"), int) else round(to, 6)
                if to != now:
                    out.append(Action("adjust", op, k, to))
    return out


#: Retained shares that warm-up recipes aim at, in turn.
ZONES = ((0.60, 0.70), (0.30, 0.50), (0.05, 0.15))


def warmup(n: int, pool: int | None = None, operators: tuple[str, ...] | None = None, seed: int = 42) -> list[Recipe]:
    """Seed recipes that aim at zones of retention in turn: a cut to a number where the pool's size is known, and one to
    three filters whose fractions multiply to the rest."""
    rng = random.Random(seed)
    filters = [o for o in (operators or operator_space(sampled=True)) if o not in ("truncate_samples", "semantic_dedup", *NOT_SAMPLED)]
    out = []
    for i in range(n):
        low, high = ZONES[i % len(ZONES)]
        retain = rng.uniform(low, high)
        picked = rng.sample(filters, min(len(filters), rng.randint(1, 3)))
        steps = []
        parts = len(picked) + (pool is not None)
        if pool is not None:
            steps.append(Step("truncate_samples", {"total_samples": max(1, int(pool * retain ** (1 / parts)))}, "truncate_samples"))
        for o in picked:
            f = min(max(retain ** (1 / parts) * rng.uniform(0.92, 1.08), 0.05), 0.95)
            steps.append(Step(o, {"fraction": round(f, 2)}, o))
        out.append(Recipe(f"warmup_{i}", steps))
    return out


def latin_hypercube(n: int, dims: int, seed: int = 42) -> np.ndarray:
    """n points in the unit cube, one in each of n layers of every dimension."""
    rng = np.random.default_rng(seed)
    layers = np.stack([rng.permutation(n) for _ in range(dims)], axis=1) if n else np.zeros((0, dims))
    return (layers + rng.random((n, dims))) / max(n, 1)


#: Places of a design point and what they stand for.
DESIGN = (
    ("truncate_samples", (("total_samples", 0.1, 1.0),)),
    ("mona_filter", (("fraction", 0.05, 0.95),)),
    ("ifd_filter", (("fraction", 0.05, 0.95),)),
    ("ngram_entropy", (("fraction", 0.05, 0.95),)),
    ("action_object_branching", (("fraction", 0.05, 0.95),)),
    ("varentropy_filter", (("fraction", 0.05, 0.95),)),
    ("semantic_dedup", (("jaccard_threshold", 0.5, 0.99),)),
    ("semdedup", (("num_clusters", 0.01, 0.05), ("cosine_threshold", 0.3, 0.95))),
)
DIMENSIONS = sum(1 + len(p) for _, p in DESIGN)


def decode(point: np.ndarray, pool: int, name: str, least: int = 2, most: int = 4) -> Recipe:
    """A design point as a recipe: an operator is on above one half; too few or too many are settled by how much."""
    at, on, steps = 0, [], {}
    for op, params in DESIGN:
        on.append((float(point[at]), op))
        values = {}
        for k, (param, low, high) in enumerate(params):
            x = low + float(point[at + 1 + k]) * (high - low)
            if param == "total_samples":
                x = max(1, int(x * pool))
            elif param == "num_clusters":
                x = max(100, int(x * pool))
            values[param] = x if isinstance(x, int) else round(x, 2)
        if op == "semantic_dedup":
            values["strategy"] = "minhash"
        steps[op] = Step(op, values, op)
        at += 1 + len(params)
    strong = sorted(on, reverse=True)
    picked = [op for x, op in on if x > 0.5]
    if len(picked) < least:
        picked = [op for _, op in strong[:least]]
    elif len(picked) > most:
        picked = [op for _, op in strong[:most]]
    return Recipe(name, [steps[op] for op in picked])


def designs(n: int, pool: int, seed: int = 42) -> list[Recipe]:
    return [decode(p, pool, f"lhs_{i}") for i, p in enumerate(latin_hypercube(n, DIMENSIONS, seed))]


#: Parameters that say how strong an operator of an extension is, the first of them that it has.
STRENGTHS = ("fraction", "rate", "ratio", "threshold", "jaccard_threshold", "cosine_threshold", "temperature", "top_k", "total_samples")


def _unit(x: float) -> float:
    return max(0.0, min(1.0, x))


def _strength(params: dict[str, Any]) -> float:
    """0 to 1 from the parameter that is named for it (one half if that is no number), else from the first number of 0 or
    more; numbers above 1 by their logarithm."""

    def scaled(v: Any) -> float | None:
        try:
            x = float(v)
        except (TypeError, ValueError):
            return None
        return None if not x >= 0 else x if x <= 1 else _unit(float(np.log1p(x) / np.log1p(100_000)))

    named = next((k for k in STRENGTHS if k in params), None)
    found = [params[named]] if named else params.values()
    return next((y for y in map(scaled, found) if y is not None), 0.5)


def _slots(op: str, params: dict[str, Any] | None) -> list[float]:
    """An operator's part of the vector; one that is on but has no parameters counts as off."""
    p = params or {}
    if op == "semdedup":
        return [1.0, _unit(float(p.get("num_clusters", 1000)) / 10_000), _unit(float(p.get("cosine_threshold", 0.95)))] if p else [0.0, 0.1, 1.0]
    if op == "truncate_samples":
        return [1.0, _unit(float(p.get("total_samples", 10_000)) / 100_000)] if p else [0.0, 1.0]
    if op == "semantic_dedup":
        return [1.0, _unit(float(p.get("jaccard_threshold", 0.8)))] if p else [0.0, 1.0]
    if op in FRACTION_OPERATORS:
        return [1.0, float(p.get("fraction", 0.5))] if p else [0.0, 1.0]
    return [1.0, _strength(p)] if p else [0.0, 0.0]


def _own(recipe: Recipe, operators: tuple[str, ...]) -> np.ndarray:
    on = {s.operator: s.params for s in recipe.steps if s.enabled}
    return np.array([x for op in operators if op != "union" for x in _slots(op, on.get(op))])


def encode(recipe: Recipe, operators: tuple[str, ...] = OFFICIAL, known: dict[str, Recipe] | None = None) -> np.ndarray:
    """The recipe's own slots; for a union also those of its source, their difference and their maximum (zeros if the
    source isn't known), and a flag for a union."""
    own = _own(recipe, operators)
    source = next((s.params.get("source_recipe") for s in recipe.steps if s.enabled and s.operator == "union"), None)
    flag, none = [1.0 if source else 0.0], np.zeros_like(own)
    if source and known and source in known:
        other = _own(known[source], operators)
        return np.concatenate([own, other, np.abs(own - other), np.maximum(own, other), flag])
    return np.concatenate([own, none, none, none, flag])
