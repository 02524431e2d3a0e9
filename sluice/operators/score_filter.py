"""Score filters: rank by a score, keep a threshold, a number or a fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import unigram_entropy
from sluice.operators.base import Context, Operator, cut, ranked, ranked_within


def fraction_size(n: Column, fraction: float) -> Column:
    """ceil(n * fraction) in doubles, as IEEE has it: ceil(100 * 0.07) is 8."""
    return F.ceil(n.cast("double") * F.lit(float(fraction))).cast("long")


class ScoreFilter(Operator):
    """Rows by score, ties in their present order.

    threshold goes before top_k, that before fraction; without any, all scored rows stay.  If nothing is selected of
    a set that has scores, the best row is.  Rows without a score go, or come last with keep_missing_scores.
    """

    name = "path_filter"
    defaults = {"score_path": None, "threshold": None, "top_k": None, "fraction": None, "descending": True, "keep_missing_scores": False}

    def score(self, df: DataFrame, ctx: Context) -> DataFrame:
        """``df`` with the column ``_score``; null and NaN are missing."""
        path = self.params["score_path"]
        if not path:
            raise ValueError(f"{self.name}: no score_path")
        return df.withColumn("_score", column_of(df, path))

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        p = self.params
        if p["top_k"] is not None and int(p["top_k"]) < 0:
            raise ValueError(f"{self.name}: top_k is negative")
        # scores are written once, with the places they belong to; what else a row holds is neither ranked nor moved twice
        scores = cut(self.score(df, ctx or Context()).select("ord", F.when(~F.isnan("_score"), F.col("_score").cast("double")).alias("_score")))
        known = scores.where(F.col("_score").isNotNull())
        key = F.desc("_score") if p["descending"] else F.asc("_score")
        n = known.count()
        out = ranked(known, [key, F.asc("ord")], "_rank", n)
        if p["threshold"] is not None:
            keep = F.col("_score") >= float(p["threshold"]) if p["descending"] else F.col("_score") <= float(p["threshold"])
        elif p["top_k"] is not None:
            keep = F.col("_rank") <= int(p["top_k"])
        elif p["fraction"] is not None:
            keep = F.col("_rank") <= fraction_size(F.lit(n), p["fraction"])
        else:
            keep = F.lit(True)
        # the best row is there however little is selected: it stands first in the ranks
        picked = out.where(keep | (F.col("_rank") == 1)).select("ord", "_rank")
        out = df.join(picked, "ord").withColumn("ord", F.col("_rank")).select(*df.columns)
        self.trace.notes["scored"] = n
        if p["keep_missing_scores"]:
            missing = df.join(scores.where(F.col("_score").isNull()).select("ord"), "ord", "left_semi").select(*df.columns).withColumn("ord", F.col("ord") + n + 1)
            low = scores.agg(F.min("ord")).first()[0] or 0
            out = out.unionByName(missing.withColumn("ord", F.col("ord") - min(0, low)))
        return out


def column_of(df: DataFrame, path: str) -> Column:
    """A dotted path as a column: a struct field, a typed feature column, a map key, or a key of the extra JSON."""
    path = path.removeprefix("metadata.extra.")
    flat = path.replace(".", "_")
    for name in (path, flat, path.split(".")[0] if path.endswith(".score") else path):
        if name in df.columns and "." not in name:
            return F.col(name).cast("double")
    root = path.split(".")[0]
    if root in df.columns:
        return F.col(path).cast("double")
    if "extra" in df.columns:
        return F.get_json_object("extra", f"$.{path}").cast("double")
    return F.lit(None).cast("double")


def _named(op: str, path: str, **defaults) -> type[ScoreFilter]:
    return type(op.title().replace("_", ""), (ScoreFilter,), {"name": op, "defaults": {**ScoreFilter.defaults, "score_path": path, **defaults}, "__doc__": f"Score filter on {path}."})


IfdFilter = _named("ifd_filter", "metadata.extra.ifd.score")
ActionObjectBranching = _named("action_object_branching", "metadata.extra.action_object.score")
VarentropyFilter = _named("varentropy_filter", "metadata.extra.varentropy.score")
RewardModelFilter = _named("reward_model_filter", "metadata.extra.reward_model.score")


class NgramEntropyFilter(ScoreFilter):
    """Score filter on the stored unigram entropy, or on the text's own where none is stored."""

    name = "ngram_entropy"
    defaults = {**ScoreFilter.defaults, "score_path": "metadata.extra.ngram_entropy.score"}

    def score(self, df: DataFrame, ctx: Context) -> DataFrame:
        if "ngram_entropy" in df.columns or "ngram_entropy_score" in df.columns or "text" not in df.columns:
            return super().score(df, ctx)
        return df.withColumn("_score", unigram_entropy(F.col("text")))


def rule_quality(chars: Column) -> Column:
    return F.least(F.lit(1.0), chars.cast("double") / 2000.0)


class QualityFilter(ScoreFilter):
    """Score filter on the stored quality; if no row has one, on the rule min(1, characters / 2000)."""

    name = "quality_filter"
    defaults = {**ScoreFilter.defaults, "score_path": "metadata.extra.quality.score", "quality_method": "rule"}

    def score(self, df: DataFrame, ctx: Context) -> DataFrame:
        out = super().score(df, ctx)
        if self.params["quality_method"] != "rule" or out.where(F.col("_score").isNotNull()).limit(1).count():
            return out
        return out.withColumn("_score", rule_quality(characters(df)))


def characters(df: DataFrame) -> Column:
    """Characters of all messages, or of the target where they have none; of the text where there are no messages."""
    if "messages" not in df.columns:
        return F.length(F.coalesce("text", F.lit("")))
    n = F.aggregate("messages", F.lit(0), lambda s, m: s + F.length(F.coalesce(m["content"], F.lit(""))))
    target = F.length(F.coalesce("target_text", F.lit(""))) if "target_text" in df.columns else F.lit(0)
    return F.when(n > 0, n).otherwise(target)


class MonaFilter(ScoreFilter):
    """Per benchmark the best rows by its score; the union of them in the present order.

    If any of the first ten rows has scores by benchmark (``mona_scores``), each benchmark's rows are ranked apart
    and threshold and missing rows don't count; an empty union is the first row.  Otherwise a plain score filter on
    ``mona_score``.
    """

    name = "mona_filter"
    defaults = {**ScoreFilter.defaults, "score_path": "metadata.extra.mona_score", "fraction": 1.0}

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        if "mona_scores" not in df.columns or not any(r["m"] for r in df.orderBy("ord").limit(10).select(F.col("mona_scores").alias("m")).collect()):
            return super().apply(df, ctx)
        p = self.params
        rows = df.select("ord", "sample_id", F.explode("mona_scores").alias("benchmark", "score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
        key = F.desc("score") if p["descending"] else F.asc("score")
        rows = cut(rows)
        sizes = rows.groupBy("benchmark").count()
        ranks = ranked_within(rows, "benchmark", [key, F.col("ord")], {r["benchmark"]: r["count"] for r in sizes.collect()}, "_rank")  # a row per benchmark
        if p["top_k"] is not None:
            picked = ranks.where(F.col("_rank") <= int(p["top_k"]))
        else:
            sizes = sizes.select("benchmark", fraction_size(F.col("count"), p["fraction"] if p["fraction"] is not None else 1.0).alias("_k"))
            picked = ranks.join(F.broadcast(sizes), "benchmark").where(F.col("_rank") <= F.col("_k"))
        out = df.join(picked.select("sample_id").distinct(), "sample_id", "left_semi").select(*df.columns)
        if out.limit(1).count():
            return out
        return df.orderBy("ord").limit(1)


class SparseMonaFilter(ScoreFilter):
    """Score filter on the generalized Jaccard similarity of a sample's sparse vector with a target vector.

    Without a target or features the score is that of the task in ``mona_scores``, else the greatest there.
    """

    name = "sparse_mona_filter"
    defaults = {**ScoreFilter.defaults, "fraction": 1.0, "benchmark": None}

    def score(self, df: DataFrame, ctx: Context) -> DataFrame:
        from sluice.functions.vectors import jaccard_to_targets

        if ctx.targets is not None and "sparse" in df.columns:
            benchmark = self.params["benchmark"] or ctx.task_name
            targets = ctx.targets if benchmark is None else ctx.targets.where(F.col("benchmark") == benchmark)
            best = jaccard_to_targets(df, targets).groupBy("sample_id").agg(F.round(F.max("score"), 9).alias("_score"))
            return df.join(best, "sample_id", "left")
        if "mona_scores" not in df.columns:
            return df.withColumn("_score", F.lit(None).cast("double"))
        most = F.array_max(F.map_values("mona_scores"))
        named = F.try_element_at(F.col("mona_scores"), F.lit(ctx.task_name)) if ctx.task_name else F.lit(None).cast("double")
        return df.withColumn("_score", F.coalesce(named, most))


class ExampleLengthFilter(Operator):
    """Rows of at most max_chars characters; rows without a stored length are measured, or go without keep_missing."""

    name = "example_length_filter"
    defaults = {"max_chars": 4096, "keep_missing": True}

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        stored = F.col("example_length") if "example_length" in df.columns else F.lit(None).cast("int")
        own = F.length(F.coalesce("text", F.lit(""))) if "text" in df.columns else characters(df)
        size = F.coalesce(stored, own) if self.params["keep_missing"] else stored
        return df.where(size <= int(self.params["max_chars"]))
