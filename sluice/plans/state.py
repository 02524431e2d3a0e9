"""State vectors: what a subset looks like against its reference."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import token_count
from sluice.functions.vectors import activation_rates, drift


@dataclass
class State:
    retain_ratio: float = 1.0
    token_ratio: float = 1.0
    distribution_drift: float = 0.0
    score_mean: float = 0.0
    score_std: float = 0.0
    mean_varentropy: float = 0.5
    mean_ifd: float = 0.5
    cumulative_cost_ratio: float = 0.0
    score_per_task: dict[str, float] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Key:
    name: str
    low: float
    high: float
    better: str
    about: str


KEYS = (
    Key("retain_ratio", 0.0, 1.0, "context", "share of the reference's rows"),
    Key("token_ratio", 0.0, 1.0, "context", "share of the reference's tokens"),
    Key("distribution_drift", 0.0, 1.0, "lower", "distance of feature activation rates from the reference"),
    Key("score_mean", 0.0, 1.0, "higher", "mean relevance score"),
    Key("score_std", 0.0, 1.0, "context", "spread of relevance scores"),
    Key("mean_varentropy", 0.0, 1.0, "context", "mean varentropy, half of its ratio to the reference"),
    Key("mean_ifd", 0.0, 1.0, "higher", "mean instruction difficulty, half of its ratio to the reference"),
    Key("cumulative_cost_ratio", 0.0, 1.0, "lower", "evaluations spent of the budget"),
)


def describe() -> str:
    return "\n".join(f"- {k.name} [{k.low}, {k.high}] ({k.better}): {k.about}" for k in KEYS)


def delta(now: State, then: State) -> dict[str, float]:
    """Differences of the scalars; scores by task aren't compared."""
    a, b = now.as_dict(), then.as_dict()
    return {k: round(v - b[k], 6) for k, v in a.items() if not isinstance(v, dict)}


def relevance(df: DataFrame):
    """A row's score: the single one, else the greatest by benchmark."""
    parts = []
    if "mona_score" in df.columns:
        parts.append(F.col("mona_score").cast("double"))
    if "mona_scores" in df.columns:
        parts.append(F.array_max(F.map_values("mona_scores")))
    if "score" in df.columns:
        parts.append(F.col("score").cast("double"))
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


def totals(df: DataFrame) -> DataFrame:
    """One row of everything a state needs but features and tasks, in one job."""
    number = lambda c: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
    tokens = F.col("n_tokens") if "n_tokens" in df.columns else token_count(F.col("text")) if "text" in df.columns else F.lit(0)
    r = relevance(df)
    return df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"),
        F.avg(r).alias("score_mean"),
        F.stddev_pop(r).alias("score_std"),
        F.avg(number("varentropy")).alias("varentropy"),
        F.avg(number("ifd")).alias("ifd"),
    )


class StateComputer:
    """States against a fixed reference, whose own totals and rates are computed once."""

    def __init__(self, reference: DataFrame, width: int = 0):
        self.reference, self.width = reference, width
        self.base = totals(reference).first()
        self.rates = activation_rates(reference, width=width).cache() if width and "sparse" in reference.columns else None

    def compute(self, df: DataFrame, same: bool = False, cost: float = 0.0) -> State:
        t = totals(df).first()

        def ratio(now: float | None, then: float | None) -> float:
            if not t["n"] or not then or then <= 0:
                return 0.5
            return 0.0 if now is None else min(max(now / then, 0.0), 2.0) / 2

        gap = 0.0
        if self.rates is not None and not same:
            gap = drift(activation_rates(df, width=self.width), self.rates, self.width).first()["drift"] if t["n"] else 0.0
        tasks = {}
        if "mona_scores" in df.columns:
            per = df.select(F.explode("mona_scores").alias("task", "score")).groupBy("task").agg(F.avg("score").alias("m"))
            tasks = {r["task"]: round(r["m"], 6) for r in per.collect() if r["m"] is not None}  # a row per benchmark
        return State(
            round(t["n"] / max(1, self.base["n"]), 6),
            round(t["tokens"] / max(1, self.base["tokens"]), 6),
            round(gap or 0.0, 6),
            round(t["score_mean"] or 0.0, 6),
            round(t["score_std"] or 0.0, 6),
            round(ratio(t["varentropy"], self.base["varentropy"]), 6),
            round(ratio(t["ifd"], self.base["ifd"]), 6),
            round(cost, 6),
            tasks,
        )
