"""Who proposes recipes and who picks among them; local rules stand where a language model may be plugged in."""

from __future__ import annotations

import json
import random
from typing import Any, Protocol

from sluice.plans.recipe import Recipe, Step, clamp
from sluice.search.space import FRACTION_OPERATORS, actions, operator_space


class Proposer(Protocol):
    def propose(self, parent: Recipe, history: list[dict[str, Any]], n: int) -> list[Recipe]: ...


class Selector(Protocol):
    def select(self, candidates: list[Recipe], facts: list[dict[str, Any]]) -> int: ...


class LocalProposer:
    """Edits of the parent drawn by a seed; without a catalog, fractions move and filters come and go."""

    def __init__(self, catalog: dict[str, Any] | None = None, seed: int = 42):
        self.catalog, self.rng = catalog, random.Random(seed)

    def propose(self, parent: Recipe, history: list[dict[str, Any]], n: int) -> list[Recipe]:
        out: list[Recipe] = []
        seen = {parent.signature()}
        for attempt in range(20 * n):
            if len(out) == n:
                break
            name = f"{parent.name}.{len(history)}_{len(out)}"
            r = self._edit(parent, name)
            if r.signature() not in seen and any(s.enabled for s in r.steps):
                seen.add(r.signature())
                out.append(r)
        return out

    def _edit(self, parent: Recipe, name: str) -> Recipe:
        if self.catalog:
            return self.rng.choice(actions(parent, self.catalog)).apply(parent, name)
        steps = [Step(s.operator, dict(s.params), s.name, s.enabled) for s in parent.steps]
        movable = [s for s in steps if "fraction" in s.params]
        if movable and self.rng.random() < 0.6:
            s = self.rng.choice(movable)
            s.params["fraction"] = round(min(max(s.params["fraction"] + self.rng.choice((-0.1, 0.1)), 0.05), 0.95), 2)
        elif len(steps) > 1 and self.rng.random() < 0.4:
            steps.pop(self.rng.randrange(len(steps)))
        else:
            op = self.rng.choice([o for o in operator_space(sampled=True) if o in FRACTION_OPERATORS])
            steps = [s for s in steps if s.operator != op] + [Step(op, {"fraction": round(self.rng.uniform(0.15, 0.85), 2)}, op)]
        return Recipe(name, steps, parent.input_split)


class BestBound:
    """Picks the candidate of the highest upper confidence bound, the first of equals."""

    def select(self, candidates: list[Recipe], facts: list[dict[str, Any]]) -> int:
        return max(range(len(candidates)), key=lambda i: (facts[i]["ucb"], -i))


def json_in(text: str) -> Any:
    """The first JSON value in prose: in a code fence, or from the first bracket that parses; None without one."""
    if "```" in text:
        for part in text.split("```")[1::2]:
            try:
                return json.loads(part.removeprefix("json").strip())
            except ValueError:
                pass
    decoder = json.JSONDecoder()
    for i, c in enumerate(text):
        if c in "[{":
            try:
                return decoder.raw_decode(text[i:])[0]
            except ValueError:
                pass
    return None


def recipes_in(text: str, catalog: dict[str, Any], known: tuple[str, ...], prefix: str) -> list[Recipe]:
    """Recipes of a model's reply: unknown operators go, numbers are held to the catalog's ranges."""
    got = json_in(text)
    items = got if isinstance(got, list) else (got.get("recipes") or [got]) if isinstance(got, dict) else []
    out = []
    for i, item in enumerate(items):
        steps = [Step.of(s) for s in (item.get("steps") or []) if isinstance(s, dict) and s.get("operator") in known] if isinstance(item, dict) else []
        for s in steps:
            s.params = clamp(catalog, s.operator, s.params)
        if steps:
            out.append(Recipe(item.get("name") or f"{prefix}_{i}", steps))
    return out
