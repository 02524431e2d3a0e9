"""Rule-based local search: a few baselines, a diagnosis of each candidate, small edits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from sluice.plans.recipe import Executor, Recipe, Result, Step, source_entropy

FILTERS = ("ifd_filter", "ngram_entropy", "varentropy_filter", "quality_filter", "mona_filter", "path_filter", "action_object_branching")
DEDUPS = ("semantic_dedup", "semdedup")


@dataclass
class Metrics:
    mean_score: float
    entropy: float
    coverage: float
    seconds: float = 0.0

    def objective(self) -> float:
        """Mean score, a little for mixed sources, less for coverage under 0.7 and for time (which a caller may fix)."""
        return round(self.mean_score + 0.05 * self.entropy - 0.12 * max(0.0, 0.7 - self.coverage) - 0.01 * self.seconds, 6)


def diagnose(now: Metrics, then: Metrics, recipe: Recipe, min_gain: float = 0.01, max_cost_ratio: float = 0.5) -> list[str]:
    gain, lost = now.mean_score - then.mean_score, then.coverage - now.coverage
    ops = {s.operator for s in recipe.steps if s.enabled}
    ratio = (now.seconds - then.seconds) / then.seconds if then.seconds else float(now.seconds > 0)
    out = []
    if gain < -min_gain:
        out.append("LOW_TASK_FIT")
    if ops & set(FILTERS) and lost > 0.2 and gain < min_gain:
        out.append("OVER_FILTER")
    if ops & set(DEDUPS) and (lost > 0.15 or then.entropy - now.entropy > 0.1):
        out.append("OVER_DEDUP")
    if ratio > max_cost_ratio and gain < min_gain:
        out.append("HIGH_COST_LOW_GAIN")
    return out


def edits(recipe: Recipe, issues: list[str], name: str) -> list[Recipe]:
    """Fractions a tenth up and down within [.5, .95]; without dedup where that did harm, without a filter where it fits ill."""
    copy = lambda: [Step(s.operator, dict(s.params), s.name, s.enabled) for s in recipe.steps]
    out = []
    for i, s in enumerate(recipe.steps):
        if "fraction" in s.params:
            for by in (-0.1, 0.1) if "OVER_FILTER" not in issues else (0.1,):
                steps = copy()
                steps[i].params["fraction"] = round(min(max(s.params["fraction"] + by, 0.5), 0.95), 6)
                if steps[i].params["fraction"] != s.params["fraction"]:
                    out.append(steps)
        if ("OVER_DEDUP" in issues and s.operator in DEDUPS) or ("LOW_TASK_FIT" in issues and s.operator in FILTERS):
            out.append(copy()[:i] + copy()[i + 1 :])
    return [Recipe(f"{name}_{i}", steps) for i, steps in enumerate(out) if steps]


def baselines(score_path: str = "quality") -> list[Recipe]:
    f = lambda op, **p: Step(op, p, op)
    return [
        Recipe("exact_dedup", [f("semantic_dedup", strategy="exact")]),
        Recipe("half_by_entropy", [f("ngram_entropy", fraction=0.5)]),
        Recipe("most_by_entropy", [f("ngram_entropy", fraction=0.8)]),
        Recipe("by_score", [f("path_filter", score_path=score_path, fraction=0.7, keep_missing_scores=True)]),
        Recipe("even_sources", [f("source_mix")]),
        Recipe("dedup_then_entropy", [f("semantic_dedup", strategy="exact"), f("ngram_entropy", fraction=0.8)]),
    ]


@dataclass
class Record:
    recipe: Recipe
    metrics: Metrics
    objective: float
    issues: list[str] = field(default_factory=list)
    round: int = 0


class Experiment:
    def __init__(self, executor: Executor, score: Callable[[Result], float], *, rounds: int = 3, candidates: int = 6, stagnation: int = 1, min_gain: float = 0.01, seconds: Callable[[Result], float] = lambda r: 0.0):
        self.executor, self.score, self.rounds, self.candidates = executor, score, rounds, candidates
        self.stagnation, self.min_gain, self.seconds = stagnation, min_gain, seconds

    def measure(self, recipe: Recipe) -> Metrics:
        r = self.executor.run(recipe)
        return Metrics(self.score(r), float(source_entropy(r.dataset).first()["entropy"]), r.rows / max(1, self.executor.states.base["n"]), self.seconds(r))

    def run(self, recipes: list[Recipe] | None = None) -> list[Record]:
        """All records, the best first."""
        out: list[Record] = []
        seen: set[str] = set()

        def add(recipe: Recipe, then: Metrics | None, turn: int) -> Record | None:
            if recipe.signature() in seen:
                return None
            seen.add(recipe.signature())
            m = self.measure(recipe)
            out.append(Record(recipe, m, m.objective(), diagnose(m, then, recipe, self.min_gain) if then else [], turn))
            return out[-1]

        for r in (recipes or baselines())[: self.candidates]:
            add(r, out[0].metrics if out else None, 0)
        still = 0
        for turn in range(1, self.rounds + 1):
            best = max(out, key=lambda x: x.objective)
            new = [x for r in edits(best.recipe, best.issues, f"round{turn}")[: self.candidates] if (x := add(r, best.metrics, turn))]
            if any("HIGH_COST_LOW_GAIN" in x.issues for x in new) or not new:
                break
            still = 0 if max(x.objective for x in new) - best.objective >= self.min_gain else still + 1
            if still > self.stagnation:
                break
        return sorted(out, key=lambda x: -x.objective)
