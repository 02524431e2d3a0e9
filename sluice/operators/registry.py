"""Operators by name."""

from __future__ import annotations

from sluice.operators import dedup, mix, score_filter, union
from sluice.operators.base import Operator

#: The vocabulary of recipes, in order.
OFFICIAL = (
    "truncate_samples",
    "mona_filter",
    "ifd_filter",
    "ngram_entropy",
    "action_object_branching",
    "varentropy_filter",
    "semantic_dedup",
    "semdedup",
    "union",
)


class Registry:
    def __init__(self):
        self._known: dict[str, type[Operator]] = {}

    def register(self, name: str, operator: type[Operator]) -> None:
        if name in self._known:
            raise ValueError(f"operator {name} is registered already")
        self._known[name] = operator

    def create(self, name: str, **params) -> Operator:
        if name not in self._known:
            raise KeyError(f"unknown operator {name}")
        return self._known[name](**params)

    def names(self) -> list[str]:
        return list(self._known)

    def __contains__(self, name: str) -> bool:
        return name in self._known


def default_registry() -> Registry:
    r = Registry()
    for op in (
        mix.SourceMix, mix.TruncateSamples, mix.VarentropyMix, score_filter.MonaFilter, score_filter.SparseMonaFilter, score_filter.QualityFilter, score_filter.IfdFilter,
        score_filter.NgramEntropyFilter, score_filter.ActionObjectBranching, score_filter.VarentropyFilter, score_filter.RewardModelFilter, score_filter.ScoreFilter,
        dedup.SemanticDedup, dedup.SemDedup, union.Union,
    ):
        r.register(op.name, op)
    return r
