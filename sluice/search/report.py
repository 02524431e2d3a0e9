"""Plain words on how a search goes: trends of scores, what states did, what operators brought."""

from __future__ import annotations

from sluice.plans.state import KEYS
from sluice.search.loop import Entry


def trend(scores: list[float], down: float = -2.0, up: float = 1.0) -> str:
    """Of the last score against the one before, in points."""
    if len(scores) < 2:
        return "too few evaluations"
    d = scores[-1] - scores[-2]
    return "declining" if d <= down else "improving" if d >= up else "flat"


def report(history: list[Entry], last: int = 5) -> str:
    if not history:
        return "no evaluations yet"
    best = max(history, key=lambda e: (e.score, e.iteration))
    out = [f"{len(history)} evaluations, best {best.recipe_name} with {best.score:.3f} on {best.output_samples} rows; {trend([e.score for e in history])}."]
    by_name = {e.recipe_name: e for e in history}
    for e in history[-last:]:
        p = by_name.get(e.parent_name or "")
        line = f"- {e.recipe_name}: {' > '.join(s['operator'] for s in e.steps)}: {e.score:.3f}"
        if p:
            moved = [f"{k.name} {e.state[k.name] - p.state[k.name]:+.3f}" for k in KEYS if k.name in e.state and k.name in p.state and abs(e.state[k.name] - p.state[k.name]) > 0.01]
            line += f" ({e.score - p.score:+.3f} on {p.recipe_name}{'; ' + ', '.join(moved) if moved else ''})"
        out.append(line)
    tasks = {t for e in history for t in e.per_benchmark}
    for t in sorted(tasks):
        s = [e.per_benchmark[t] for e in history if t in e.per_benchmark]
        out.append(f"- task {t}: best {max(s):.3f}, last {s[-1]:.3f}, {trend(s)}")
    return "\n".join(out)
