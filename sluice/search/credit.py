"""What a search log says: credit of operators, the front of score and cost, how long nothing has got better."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _edges(log: DataFrame) -> DataFrame:
    """Children with their gain, what they added and what they left out.  With a column ``settings`` (map of operators to
    their parameters) an operator that has other parameters than in the parent counts as added."""
    if "settings" not in log.columns:
        log = log.withColumn("settings", F.create_map().cast("map<string,string>"))
    parent = log.select(F.col("recipe_name").alias("_p"), F.col("score").alias("_ps"), F.col("ops").alias("_pops"), F.col("settings").alias("_pset"))
    e = log.join(parent, log["parent_name"] == parent["_p"])
    changed = F.filter(F.array_intersect("ops", "_pops"), lambda o: ~F.col("settings")[o].eqNullSafe(F.col("_pset")[o]))
    return e.select("recipe_name", (F.col("score") - F.col("_ps")).alias("d"), F.concat(F.array_except("ops", "_pops"), changed).alias("added"), F.array_except("_pops", "ops").alias("gone"))


def operator_credit(log: DataFrame) -> DataFrame:
    """(operator, credit, n): a child's gain over its parent, shared by what it added, and negated by what it left out."""
    e = _edges(log)
    plus = e.where(F.size("added") > 0).select(F.explode("added").alias("operator"), (F.col("d") / F.size("added")).alias("v"))
    minus = e.where(F.size("gone") > 0).select(F.explode("gone").alias("operator"), (-F.col("d") / F.size("gone")).alias("v"))
    return plus.union(minus).groupBy("operator").agg(F.sum("v").alias("credit"), F.count("*").alias("n"))


def pair_credit(log: DataFrame, without: tuple[str, ...] = ("truncate_samples", "union")) -> DataFrame:
    """(first, second, credit, n): the gain shared by the pairs of what a child added."""
    e = _edges(log).withColumn("ops", F.array_sort(F.filter("added", lambda o: ~o.isin(*without))))
    pairs = F.flatten(F.transform("ops", lambda a, i: F.transform(F.filter("ops", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    rows = e.withColumn("pairs", pairs).where(F.size("pairs") > 0).select(F.explode("pairs").alias("p"), (F.col("d") / F.size("pairs")).alias("v"))
    return rows.groupBy(F.col("p.first").alias("first"), F.col("p.second").alias("second")).agg(F.sum("v").alias("credit"), F.count("*").alias("n"))


def pareto_front(log: DataFrame) -> DataFrame:
    """Entries that no other beats in both score and cost.  A log has a row per evaluation, so one window holds it."""
    w = Window.orderBy(F.desc("score"), "cost", "iteration").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_least", F.min("cost").over(w)).where(F.col("_least").isNull() | (F.col("cost") < F.col("_least"))).select("recipe_name", "score", "cost")


def stagnation(log: DataFrame) -> DataFrame:
    """One row ``stagnation``: evaluations since the last one that beat all before it."""
    w = Window.orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    r = log.withColumn("_best", F.max("score").over(w))
    last = r.where(F.col("_best").isNull() | (F.col("score") > F.col("_best"))).agg(F.max("iteration").alias("_last"))
    return r.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("iteration") > F.col("_last")).alias("stagnation"))
