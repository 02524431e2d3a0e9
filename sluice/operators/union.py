"""Union with the rows of an earlier recipe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.base import Context, Operator


class Union(Operator):
    """The dataset, then the pool's rows that the named recipe kept and the dataset lacks, in the pool's order.

    Without a name, an earlier output or a pool the dataset stays as it is and the trace says why.
    """

    name = "union"
    kind = "mix"
    defaults = {"source_recipe": ""}

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        ctx = ctx or Context()
        name = self.params["source_recipe"]
        for missing, why in ((not name, "no source_recipe"), (name not in ctx.outputs, "no such output"), (ctx.pool is None, "no pool")):
            if missing:
                self.trace.notes["reason"] = why
                return df
        more = ctx.pool.join(ctx.outputs[name].select("sample_id").distinct(), "sample_id", "left_semi").join(df.select("sample_id").distinct(), "sample_id", "left_anti")
        last, low = df.agg(F.max("ord")).first()[0], more.agg(F.min("ord")).first()[0]
        if low is None:
            return df
        shift = (last if last is not None else -1) + 1 - low
        return df.unionByName(more.withColumn("ord", F.col("ord") + F.lit(shift)).select(*df.columns))
