"""Batch entry: a task's configuration, and the run that reads its sources, scores them, and executes or searches recipes.

All that a run keeps lies under the task's folder, which driver and executors share:
``canonical/<split>/<source>`` and ``scored/<split>/<source>`` (Parquet), ``recipes/<name>`` (ids, dataset, trace,
manifest) and ``searches/<name>`` (manifest, trace, diagnoses, final recipe).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import sample_text, unigram_entropy
from sluice.operators.base import cut, ranked
from sluice.operators.registry import Registry, default_registry
from sluice.plans import extensions
from sluice.plans.recipe import MIN_VIABLE, Executor, Recipe, Result, load_structured, safe_name, save
from sluice.search.experiment import Experiment, Record, baselines
from sluice.sources import records

SPLITS = ("train", "eval")
STAGES = ("canonical", "scored")
EVENTS = tuple(f"{when}_{what}" for what in ("ingest", "source", "score", "recipe") for when in ("before", "after"))
#: What a canonical table holds; missing columns are null.
COLUMNS = {
    "sample_id": "string", "source_name": "string", "messages": None, "target_text": "string", "language": "string", "task_type": "string", "extra": "string",
    "has_multiturn": "boolean", "has_system_prompt": "boolean",
}


@dataclass
class Source:
    path: str
    source_name: str
    format: str = "auto"  # canonical, a converter's name, or auto: by a supplied mapping
    mapping: str | None = None  # the mapping's name where it isn't the source's


@dataclass
class Task:
    task_name: str
    output_dir: str
    train_sources: list[Source] = field(default_factory=list)
    eval_sources: list[Source] = field(default_factory=list)
    recipe: Recipe | None = None
    input_stage: str = "canonical"
    search: dict[str, Any] = field(default_factory=dict)
    scoring: dict[str, Any] = field(default_factory=dict)
    catalog: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str, modules: str | list[str] | None = None) -> Task:
        return cls.of(load_structured(path), str(Path(path).parent), modules)

    @classmethod
    def of(cls, raw: dict[str, Any], base: str = ".", modules: str | list[str] | None = None) -> Task:
        """A task of a mapping.  Paths of a recipe and a catalog are relative to ``base``; what the task says of its recipe
        goes before the file; a catalog (with the patches of the modules) turns operators into steps.  A recipe runs only
        where it is enabled; an unknown stage or a key that a source doesn't have is an error."""
        if missing := [k for k in ("task_name", "output_dir") if not raw.get(k)]:
            raise ValueError(f"a task without {', '.join(missing)}")
        read = lambda key: load_structured(str(Path(base) / raw[key])) if raw.get(key) else {}
        catalog = extensions.load(modules, default_registry()).catalog(read("recipe_catalog_path"))
        said = read("recipe_path") | (raw.get("recipe") or {})
        stage, search = said.get("input_stage") or "canonical", dict(raw.get("search") or {})
        if bad := [s for s in (stage, search.get("input_stage") or "scored") if s not in STAGES]:
            raise ValueError(f"unknown stage: {bad[0]}")
        recipe = None
        if said.get("enabled") and (said.get("steps") or said.get("operators")):
            recipe = Recipe.of({**said, "name": said.get("recipe_name") or said.get("name") or "default_recipe"}, catalog or None)
        sources = [[Source(**s) for s in raw.get(f"{split}_sources") or []] for split in SPLITS]
        return cls(raw["task_name"], raw["output_dir"].rstrip("/"), *sources, recipe, stage, search, dict(raw.get("scoring") or {}), catalog, dict(raw.get("extra") or {}))


def _canonical(df: DataFrame) -> DataFrame:
    """Converted and canonical records in the same columns."""
    if "metadata" in df.columns:
        md = F.col("metadata")
        df = df.withColumn("target_text", F.col("target")["text"]).withColumns({k: md[k] for k in ("language", "task_type", "extra", "has_multiturn", "has_system_prompt")})

    def get(name: str, kind: str | None) -> Column:
        return (F.col(name) if kind is None else F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)

    # neighbours of the scan: the place of a record is that of its line
    place = [F.input_file_name().alias("_file"), F.input_file_block_start().alias("_block"), F.monotonically_increasing_id().alias("_line")]
    return df.select(*(get(n, k) for n, k in COLUMNS.items()), *place)


def entropy_scores(df: DataFrame) -> DataFrame:
    """The scorer that needs no model: entropy of a record's words."""
    return df.withColumn("ngram_entropy", unigram_entropy(F.col("text")))


class Run:
    """Runs a task's parts, or all of them in order.

    ``scorer`` adds score columns to records with their text (a model's outputs come in here); ``mappings`` gives the
    columns of sources of format auto, by the source's name.  ``modules`` are extensions.
    """

    def __init__(
        self, spark: SparkSession, task: Task, *, scorer: Callable[[DataFrame], DataFrame] = entropy_scores, mappings: dict[str, Callable[[DataFrame], dict[str, Column]]] | None = None,
        registry: Registry | None = None, modules: str | list[str] | None = None,
    ):
        self.spark, self.task, self.scorer, self.mappings = spark, task, scorer, mappings or {}
        self.registry = registry or default_registry()
        self.extensions = extensions.load(modules, self.registry)
        self._calls: dict[str, list[Callable[..., None]]] = {}

    def on(self, event: str, call: Callable[..., None]) -> None:
        if event not in EVENTS:
            raise ValueError(f"unknown event {event}")
        self._calls.setdefault(event, []).append(call)

    def _fire(self, event: str, **facts: Any) -> None:
        for call in self._calls.get(event, []):
            call(**facts)

    def run(self) -> Result | list[Record] | None:
        """Ingest, then the search if it is on, else the recipe if it is, else the scores alone."""
        self.ingest()
        if self.task.search.get("enabled"):
            if self._search_stage() == "scored":
                self.score()
            return self.search()
        if self.task.recipe:
            if self.task.input_stage == "scored":
                self.score()
            return self.recipe()
        self.score()
        return None

    def ingest(self) -> None:
        self._fire("before_ingest")
        for split in SPLITS:
            for source in self._sources(split):
                self._fire("before_source", split=split, source=source)
                found = cut(_canonical(self._read(source)))
                n = found.count()
                out = ranked(found, [F.col(c) for c in ("_file", "_block", "_line")], "ord", n).drop("_file", "_block", "_line")
                out.write.mode("overwrite").parquet(self._path("canonical", split, source))
                self._fire("after_source", split=split, source=source, count=n)
        self._fire("after_ingest")

    def score(self) -> None:
        """Scores of the train split, and of the eval split where the task asks for them."""
        self._fire("before_score")
        for split in SPLITS if self.task.scoring.get("score_eval") else SPLITS[:1]:
            for source in self._sources(split):
                df = self.spark.read.parquet(self._path("canonical", split, source))
                self.scorer(self._text(df)).write.mode("overwrite").parquet(self._path("scored", split, source))
        self._fire("after_score")

    def pool(self, stage: str = "canonical", split: str = "train") -> DataFrame:
        """The records of a split, source after source, each in the order of its lines."""
        out, first = None, 0
        for source in self._sources(split):
            df = self._text(self.spark.read.parquet(self._path(stage, split, source)))
            n = df.count()
            df = df.withColumn("ord", F.col("ord") + F.lit(first))
            out, first = df if out is None else out.unionByName(df, allowMissingColumns=True), first + n
        if out is None:
            raise ValueError(f"no {split} sources")
        return self.extensions.features(out, {"pool_size": first, "task_name": self.task.task_name})

    def recipe(self) -> Result:
        if self.task.recipe is None:
            raise ValueError("a task without an enabled recipe")
        self._fire("before_recipe")
        split = self.task.recipe.input_split if self.task.recipe.input_split in SPLITS else "train"
        result = self._executor(self.task.input_stage, split).run(self.task.recipe)
        folder = f"{self.task.output_dir}/recipes"
        save(result, folder, self.task.task_name)
        records.write_records(result.dataset.orderBy("ord"), f"{folder}/{safe_name(result.recipe.name)}/dataset")
        self._fire("after_recipe", result=result)
        return result

    def search(self) -> list[Record]:
        """The rule-based search from the baselines; a recipe's score is the mean of ``score_path`` over its rows."""
        self._fire("before_recipe")
        s = self.task.search
        executor, path = self._executor(self._search_stage(), s.get("input_split") or "train"), s.get("score_path") or "ngram_entropy"
        if path not in executor.pool.columns:
            raise ValueError(f"no column {path} to search by")
        mean = lambda r: float(r.dataset.agg(F.avg(path)).first()[0] or 0.0)
        found = Experiment(
            executor, mean, rounds=int(s.get("max_rounds", 3)), candidates=int(s.get("max_candidates_per_round", 6)), stagnation=int(s.get("stagnation_rounds", 1)), min_gain=float(s.get("min_gain", 0.01))
        ).run(baselines(path))
        name = s.get("search_name") or "default_search"
        best = found[0]
        steps = lambda r: [{"operator": x.operator, "params": x.params, "name": x.name, "enabled": x.enabled} for x in r.steps]
        for what, value in (
            ("manifest", {"task_name": self.task.task_name, "search_name": name, "best_recipe": best.recipe.name, "objective": best.objective, "evaluations": len(found)}),
            ("trace", [{"recipe": x.recipe.name, "round": x.round, "objective": x.objective, "mean_score": x.metrics.mean_score, "coverage": x.metrics.coverage, "steps": steps(x.recipe)} for x in found]),
            ("diagnoses", {x.recipe.name: x.issues for x in found}),
            ("final_recipe", {"recipe_name": best.recipe.name, "steps": steps(best.recipe)}),
        ):
            self._note(f"{self.task.output_dir}/searches/{safe_name(name)}/{what}", value)
        self._fire("after_recipe", result=found)
        return found

    def _sources(self, split: str) -> list[Source]:
        return self.task.train_sources if split == "train" else self.task.eval_sources

    def _search_stage(self) -> str:
        return self.task.search.get("input_stage") or "scored"

    def _path(self, stage: str, split: str, source: Source) -> str:
        return f"{self.task.output_dir}/{stage}/{split}/{safe_name(source.source_name)}"

    def _read(self, source: Source) -> DataFrame:
        if source.format == "canonical":
            return records.read_canonical(self.spark, source.path)
        if source.format == "normalized":
            return records.normalized(records.read_canonical(self.spark, source.path), source.source_name)
        raw = self.spark.read.json(source.path)
        if source.format == "auto":
            mapping = self.mappings.get(source.mapping or source.source_name)
            if mapping is None:
                raise ValueError(f"source {source.source_name} needs a mapping")
            return records.from_mapping(raw, source.source_name, mapping)
        if source.format not in records.CONVERTERS:
            raise ValueError(f"unknown format {source.format}")
        return records.CONVERTERS[source.format](raw, source.source_name)

    def _text(self, df: DataFrame) -> DataFrame:
        return df if "text" in df.columns else df.withColumn("text", sample_text(F.col("messages"), F.col("target_text")))

    def _executor(self, stage: str, split: str) -> Executor:
        return Executor(cut(self.pool(stage, split)), self.registry, min_viable=int(self.task.extra.get("min_viable", MIN_VIABLE)), hooks=self.extensions.hooks)

    def _note(self, path: str, value: Any) -> None:
        self.spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
