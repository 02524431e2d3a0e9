"""Evaluators: what a recipe's subset is worth; the costs that come off."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import Any, Protocol

from sluice.plans.recipe import Result
from sluice.plans.state import State


@dataclass
class Evaluation:
    score: float
    per_task: dict[str, float] = field(default_factory=dict)
    train_cost: float = 0.0
    eval_cost: float = 0.0
    extra: dict[str, Any] = field(default_factory=dict)


class Evaluator(Protocol):
    def evaluate(self, name: str, state: State, result: Result | None = None) -> Evaluation: ...


class MockEvaluator:
    """A closed form of the state, with noise that the recipe's name fixes; makes the search testable."""

    def __init__(self, tasks: tuple[str, ...] = ("task_0",)):
        self.tasks = tasks

    def evaluate(self, name: str, state: State | dict[str, Any], result: Result | None = None) -> Evaluation:
        s = state if isinstance(state, dict) else state.as_dict()
        retain, drift, ve = s.get("retain_ratio", 1.0), s.get("distribution_drift", 0.0), s.get("mean_varentropy", 0.5)
        noise = ((int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % 1000) / 1000 - 0.5) * 5
        dev = 50 + 20 * retain + 10 * s.get("score_mean", 0.5) - 15 * drift - 10 * abs(ve - 0.5) + 5 * s.get("score_mean", 0.0) + noise
        return Evaluation(dev, {t: dev + 0.1 * i for i, t in enumerate(self.tasks)}, max(0.05, 0.5 * retain), 0.001)


def utility(score: float, search_cost: float, train_cost: float, search_weight: float = 0.1, train_weight: float = 0.05) -> float:
    return score - search_weight * search_cost - train_weight * train_cost
