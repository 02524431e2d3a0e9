"""What all operators share: ordered subsets of a pool, ranks, traces.

A dataset is a DataFrame with ``ord`` (strictly increasing in the dataset's order, gaps allowed), ``sample_id``,
``source_name`` and feature columns.  An operator returns some of its rows with ``ord`` rewritten.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a single window task may rank; more are ranked by ranges.
WINDOW_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder for an intermediate table, under spark.checkpoint.dir.

    Where that is unset: a temporary folder if everything runs in one process, else the warehouse, which all machines
    of a cluster see.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (base or _own_base(sc.master, spark.conf.get("spark.sql.warehouse.dir"))).rstrip("/") + f"/sluice-tables/{uuid.uuid4().hex}"


@functools.cache
def _own_base(master: str, warehouse: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        return warehouse
    folder = tempfile.mkdtemp(prefix="sluice-tables-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def cut(df: DataFrame) -> DataFrame:
    """Write and read back: what follows does not depend on what came before, nor on the executors that ran it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: list[Column], name: str = "rn", n: int | None = None, window_rows: int | None = None) -> DataFrame:
    """``df`` with the 1-based rank of each row in ``order``, which has to be total.

    Up to ``window_rows`` rows one window does it.  Beyond, rows are ranged over all tasks and sorted there; the
    sizes of the ranges, a row each, give the first rank of each.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    if (df.count() if n is None else n) <= limit:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["p"], r["count"]) for r in placed.groupBy(part.alias("p")).count().collect())
    first, starts = 0, []
    for p, c in sizes:
        starts += [F.lit(int(p)), F.lit(first)]
        first += c
    base = F.create_map(*starts)[part] if starts else F.lit(0)
    return placed.withColumn(name, (base + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")).drop("_at")


def ranked_within(df: DataFrame, key: str, order: list[Column], sizes: dict[Any, int], name: str = "rn") -> DataFrame:
    """``df`` with the 1-based rank of each row among those of its key, in an order that is total there.

    ``sizes`` are the rows of each key.  Rows are ranked over all keys and the rows of the keys before come off, so a key
    that holds most rows is spread like any other.
    """
    before, first = [], 0
    for k in sorted(sizes, key=lambda k: (k is not None, k)):
        before.append((k, first))
        first += sizes[k]
    kind = df.schema[key].dataType.simpleString()
    table = df.sparkSession.createDataFrame(before, f"_key {kind}, _before long")
    out = ranked(df, [F.col(key).asc_nulls_first(), *order], name, first)
    return out.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col(name) - F.col("_before")).drop("_key", "_before")


@dataclass
class Trace:
    """What an operator did."""

    operator: str
    config: dict[str, Any]
    notes: dict[str, Any] = field(default_factory=dict)
    stats: dict[str, Any] = field(default_factory=dict)
    cost: dict[str, Any] = field(default_factory=dict)

    def as_dict(self) -> dict[str, Any]:
        return {"operator_name": self.operator, "config": shortened(self.config), "notes": shortened(self.notes), "stats": self.stats, "cost": self.cost}


def shortened(value: Any) -> Any:
    """For logs: lists of more than 8 become their length and first items."""
    if isinstance(value, dict):
        return {k: shortened(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [shortened(v) for v in value] if len(value) <= 8 else {"count": len(value), "preview": [shortened(v) for v in value[:8]]}
    return value


@dataclass
class Context:
    """What a recipe gives its operators besides the dataset."""

    pool: DataFrame | None = None
    outputs: dict[str, DataFrame] = field(default_factory=dict)  # recipe name -> its rows' ids, in order
    targets: DataFrame | None = None  # (benchmark, idx, val)
    task_name: str | None = None


class Operator:
    """Base of operators: parameters from code defaults and the recipe's step, a trace, ``apply``."""

    name = ""
    kind = "filter"
    defaults: dict[str, Any] = {}

    def __init__(self, **params: Any):
        self.params = {**self.defaults, **params}
        self.trace = Trace(self.name, self.params)

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        raise NotImplementedError
