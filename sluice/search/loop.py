"""Budgeted search: warm up, propose from the best, run candidates, rank by the surrogate, evaluate one, again."""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluice.operators.registry import OFFICIAL
from sluice.plans.recipe import Executor, Recipe, Result, Step
from sluice.search.credit import operator_credit, pair_credit
from sluice.search.evaluators import Evaluator, utility
from sluice.search.proposers import BestBound, LocalProposer, Proposer, Selector
from sluice.search.space import FRACTION_OPERATORS, encode, warmup
from sluice.search.surrogate import Surrogate


@dataclass
class Entry:
    """A line of the search log."""

    recipe_name: str
    steps: list[dict[str, Any]]
    score: float
    predicted_score: float | None
    cost: float
    utility: float
    iteration: int
    parent_name: str | None
    output_samples: int
    per_benchmark: dict[str, float] = field(default_factory=dict)
    origin_type: str = "proposal"
    evaluation_index: int = 0
    trajectory_id: int = 0
    state: dict[str, Any] = field(default_factory=dict)

    def recipe(self) -> Recipe:
        return Recipe(self.recipe_name, [Step.of(s) for s in self.steps])


#: Operators that are no part of a motif: one needs an earlier recipe, the other leads every restart.
APART = ("union", "truncate_samples")
#: Best recipes, operators and pairs that a restart draws from.
DRAWN = 5


def credits(spark: SparkSession, history: list[Entry]) -> tuple[list[tuple[str, float]], list[tuple[tuple[str, str], float]]]:
    """Operators and pairs of them that brought most so far, with what they brought; a search log is small."""
    if not any(e.parent_name for e in history):
        return [], []
    rows = [(e.recipe_name, e.parent_name, float(e.score), [s["operator"] for s in e.steps], {s["operator"]: json.dumps(s["params"], sort_keys=True) for s in e.steps}) for e in history]
    log = spark.createDataFrame(rows, "recipe_name string, parent_name string, score double, ops array<string>, settings map<string,string>")
    best = lambda df, *by: df.where("credit > 0").orderBy(F.desc("credit"), *by).limit(DRAWN).collect()
    single = [(r["operator"], r["credit"]) for r in best(operator_credit(log), "operator")]
    pairs = [((r["first"], r["second"]), r["credit"]) for r in best(pair_credit(log, APART), "first", "second")]
    return single, pairs


class Search:
    """Counts completed evaluations, not time.  Candidates of an iteration run at the same time; those that fail or
    come out empty are dropped, and so many iterations without any are an error."""

    def __init__(
        self, executor: Executor, evaluator: Evaluator, *, max_evaluations: int = 15, warmups: int = 3, candidates: int = 5, threads: int = 3, patience: int = 4, kappa: float = 1.5, seed: int = 42,
        proposer: Proposer | None = None, selector: Selector | None = None, log: str | None = None, max_idle: int = 5,
    ):
        self.executor, self.evaluator = executor, evaluator
        self.max_evaluations, self.warmups, self.n, self.threads = max_evaluations, warmups, candidates, threads
        self.patience, self.kappa, self.seed, self.max_idle = patience, kappa, seed, max_idle
        self.proposer, self.selector = proposer or LocalProposer(seed=seed), selector or BestBound()
        self.log, self.history, self.trajectory = log, [], 0
        if log and Path(log).exists():
            fields = Entry.__dataclass_fields__
            self.history = [Entry(**{k: v for k, v in json.loads(x).items() if k in fields}) for x in Path(log).read_text().splitlines() if x.strip()]
            self.trajectory = max((e.trajectory_id for e in self.history), default=0)

    def run(self) -> list[Entry]:
        pool = self.executor.states.base["n"]
        done = {e.recipe_name for e in self.history}
        for r in warmup(self.warmups, pool, seed=self.seed):
            if len(self.history) < self.max_evaluations and r.name not in done and (result := self._execute(r)):
                self._evaluate(r, result, None, None, "warmup")
        idle = 0
        while len(self.history) < self.max_evaluations:
            parent = self.parent()
            if parent is not None and self.stagnation() >= self.patience:
                recipes, origin = self.restart(), "restart"
            else:
                base = parent.recipe() if parent else warmup(1, pool, seed=self.seed)[0]
                recipes, origin = self.proposer.propose(base, [asdict(e) for e in self.history], self.n), "proposal"
            tried = {json.dumps([[s["operator"], s["params"]] for s in e.steps], sort_keys=True) for e in self.history}
            recipes = [r for r in recipes if r.signature() not in tried] or self.restart()
            with ThreadPoolExecutor(self.threads) as threads:
                results = list(threads.map(self._execute, recipes))
            good = [(r, x) for r, x in zip(recipes, results, strict=True) if x is not None and x.rows > 0]
            if not good:
                idle += 1
                if idle >= self.max_idle:
                    raise RuntimeError(f"{idle} iterations without a valid candidate")
                continue
            idle = 0
            mean, sigma = self.surrogate().predict(np.stack([self._vector(r) for r, _ in good]))
            facts = [{"mean": float(m), "sigma": float(s), "ucb": float(m + self.kappa * s), "rows": x.rows} for m, s, (_, x) in zip(mean, sigma, good, strict=True)]
            at = self.selector.select([r for r, _ in good], facts)
            if origin == "restart":
                self.trajectory += 1
            self._evaluate(*good[at], parent.recipe_name if parent and origin == "proposal" else None, facts[at]["mean"], origin)
        return self.history

    def _execute(self, recipe: Recipe) -> Result | None:
        try:
            result = self.executor.run(recipe)
        except Exception:  # a candidate that can't run is no candidate
            return None
        result.final.cumulative_cost_ratio = round(len(self.history) / self.max_evaluations, 6) if self.max_evaluations > 0 else 0.0
        if result.steps:
            result.steps[-1]["state_after"]["cumulative_cost_ratio"] = result.final.cumulative_cost_ratio
        return result

    def _evaluate(self, recipe: Recipe, result: Result, parent: str | None, predicted: float | None, origin: str) -> None:
        got = self.evaluator.evaluate(recipe.name, result.final, result)
        cost = got.train_cost + got.eval_cost
        steps = [{"operator": s.operator, "params": s.params} for s in recipe.steps if s.enabled]
        entry = Entry(
            recipe.name, steps, got.score, predicted, cost, utility(got.score, cost, got.train_cost) if origin == "warmup" else got.score, len(self.history), parent, result.rows,
            got.per_task, origin, len(self.history) + 1, self.trajectory, result.final.as_dict(),
        )
        self.history.append(entry)
        if self.log:
            with open(self.log, "a", encoding="utf-8") as f:
                f.write(json.dumps(asdict(entry)) + "\n")

    def _vector(self, recipe: Recipe) -> np.ndarray:
        return encode(recipe, OFFICIAL, {e.recipe_name: e.recipe() for e in self.history})

    def surrogate(self) -> Surrogate:
        s = Surrogate(seed=self.seed)
        return s.fit(np.stack([self._vector(e.recipe()) for e in self.history]), np.array([e.score for e in self.history])) if len(self.history) > 1 else s

    def parent(self) -> Entry | None:
        return max(self.history, key=lambda e: (e.score, e.iteration), default=None)

    def stagnation(self) -> int:
        """Evaluations of this trajectory since one that beat all before it."""
        best, since = float("-inf"), 0
        for e in (e for e in self.history if e.trajectory_id == self.trajectory):
            best, since = (e.score, 0) if e.score > best else (best, since + 1)
        return since

    def restart(self) -> list[Recipe]:
        """New recipes: a cut to a drawn number of rows, then a motif.

        The motif is a pair of operators that brought something, else such an operator, else the operators of one of the
        best recipes, else a filter, drawn by credit or score.  Parameters are those of one of the best recipes, drawn
        by score, or a drawn fraction."""
        rng = random.Random(f"{self.seed}:{len(self.history)}")
        best = sorted((e for e in self.history if e.score > 0), key=lambda e: -e.score)[:DRAWN]
        single, pairs = credits(self.executor.pool.sparkSession, self.history)
        known = self.executor.registry
        choices = [(p, c) for p, c in pairs if all(o in known for o in p)] or [((o,), c) for o, c in single if o in known and o not in APART]
        if not choices:
            own = [(tuple(s["operator"] for s in e.steps if s["operator"] in known and s["operator"] not in APART), e.score) for e in best]
            choices = [(m, score) for m, score in own if m] or [((o,), 1.0) for o in FRACTION_OPERATORS if o in known]
        pool, out = self.executor.states.base["n"], []
        for i in range(self.n):
            steps = [Step("truncate_samples", {"total_samples": rng.randint(max(1, pool // 10), pool)}, "restart_truncate")] if pool else []
            for o in rng.choices([m for m, _ in choices], [c for _, c in choices])[0] if choices else ():
                seen = [(s["params"], e.score) for e in best for s in e.steps if s["operator"] == o]
                drawn = {"fraction": round(rng.uniform(0.15, 0.85), 2)} if o in FRACTION_OPERATORS else {}
                steps.append(Step(o, dict(rng.choices([p for p, _ in seen], [x for _, x in seen])[0]) if seen else drawn, f"restart_{o}"))
            out.append(Recipe(f"restart_{len(self.history)}_{i}", steps))
        return out
