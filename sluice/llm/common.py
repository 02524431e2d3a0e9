"""What the operators of this subpackage share: shared storage, Arrow batches of texts, range shards."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python operator holds at a time.
STEP_BYTES = 4 << 20
#: Stands for a null id where ids are plain longs; it comes before all others.
NULL_ID = -(1 << 63)


#: What this process keeps at hand between tasks.
_AT_HAND: list = []


def at_hand(cached: Callable) -> Callable:
    """A cached function whose results ``forget`` drops."""
    _AT_HAND.append(cached)
    return cached


def forget() -> None:
    """Drop the tables that other operators keep at hand in this worker, and give free memory back: a worker serves all
    operators of a session, and what they leave would add up."""
    full = [c for c in _AT_HAND if c.cache_info().currsize]
    for c in full:
        c.cache_clear()
    if full:
        gc.collect()
    trim()


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(spark: SparkSession) -> None:
    """Arrow batches of some megabytes: a batch of ten thousand long texts costs both sides of the pipe dearly."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, one of our own: a temporary folder if everything runs in one process, as in tests, else one
    in the warehouse, which all machines see.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (base or _own_base(sc.master, spark.conf.get("spark.sql.warehouse.dir"))).rstrip("/")


@functools.cache
def _own_base(master: str, warehouse: str) -> str:
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        return f"{warehouse.rstrip('/')}/sluice-shared"
    folder = tempfile.mkdtemp(prefix="sluice-shared-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/sluice/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    lean(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing will read again."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes; a longer single value is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        at, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += int(n)
        yield batch.slice(at)


def fresh(names: list[str], like: str) -> str:
    """A column name that none of ``names`` equals, in any case."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like += "_"
    return like


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


class Shards:
    """Ranges of (key, tie): a shard begins at each cut."""

    def __init__(self, cuts: list[tuple[int, int]]):
        self.keys, self.ties = (np.array(c, np.int64) for c in (zip(*cuts, strict=True) if cuts else ((), ())))
        self.n = len(cuts) + 1

    def of(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out = low.copy()
        at = np.flatnonzero(high > low)  # the key has cuts of its own
        for k in np.unique(key[at]):
            mine = at[key[at] == k]
            i, j = low[mine[0]], high[mine[0]]
            out[mine] = i + np.searchsorted(self.ties[i:j], tie[mine], "right")
        return out.astype(np.int32)


_LEAST = -(1 << 63)


def range_shards(df: DataFrame, key: str, weight, target: int, tie) -> Shards:
    """Ranges of an integer key (null: the least) that weigh about ``target`` each, wherever the keys are.

    Keys are counted in cells of their range; a cell heavier than the target is counted again in cells of its own, and
    so on, until a cell is light or a single key.  Rows of a key that is heavier are parted by ``tie``, a hash.  The cuts
    depend on the rows alone, not on how they are partitioned; the driver gets some cells for each shard.
    """
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("k"), tie.cast("long").alias("t"), weight.cast("long").alias("w"))
    rows = materialize(rows, "shard-keys")
    lo, hi, total = rows.agg(F.min("k"), F.max("k"), F.sum("w")).first()
    light: list[tuple[int, int, int]] = []  # key, tie, weight
    heavy = [(lo, hi - lo + 1, total)] if lo is not None and total > target else []
    single: list[tuple[int, int]] = []
    while heavy:
        starts, spans = [h[0] for h in heavy], [h[1] for h in heavy]
        widths = [max(1, -(-n // min(CELLS, 16 * -(-w // target)))) for _, n, w in heavy]
        heavy = []
        for i, c, w in _cells(rows, starts, spans, widths):
            first, width = starts[i] + c * widths[i], widths[i]
            if w <= target:
                light.append((first, _LEAST, w))
            elif width == 1:
                single.append((first, w))
            else:
                heavy.append((first, min(width, starts[i] + spans[i] - first), w))
        heavy.sort()
    if single:
        single.sort()
        keys, parts = [k for k, _ in single], [16 * -(-w // target) for _, w in single]
        widths = [-(-(1 << 64) // n) for n in parts]
        light += [(keys[i], _LEAST + c * widths[i], w) for i, c, w in _cells(rows, keys, [1] * len(keys), widths, by_tie=True)]
    cuts, size = [], 0
    for k, t, w in sorted(light):
        if size and size + w > target:
            cuts.append((k, t))
            size = 0
        size += w
    drop_table(rows)
    return Shards(cuts)


#: Most cells that a range of keys is counted in at once.
CELLS = 4096


def _cells(rows: DataFrame, starts: list[int], spans: list[int], widths: list[int], by_tie: bool = False) -> list[tuple[int, int, int]]:
    """(range, cell, weight) of the cells that hold rows, of ranges given in ascending order."""
    start = np.array(starts, np.int64)
    span, width = (np.array([min(x, (1 << 64) - 1) for x in xs], np.uint64) for xs in (spans, widths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, t, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t", "w"))
            i = np.searchsorted(start, k, "right") - 1
            off = k.view(np.uint64) - start.view(np.uint64)[i]
            inside = (i >= 0) & (off < span[i])
            i, off, t, w = i[inside], off[inside], t[inside], w[inside]
            cell = ((t.view(np.uint64) ^ np.uint64(1 << 63)) if by_tie else off) // width[i]
            pair, where = np.unique(np.stack([i, cell.astype(np.int64)]), axis=1, return_inverse=True)
            weight = np.zeros(pair.shape[1], np.int64)
            np.add.at(weight, where.ravel(), w)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(weight)], ["i", "c", "w"])

    got = rows.mapInArrow(count, "i long, c long, w long").groupBy("i", "c").agg(F.sum("w").alias("w")).collect()
    return [tuple(r) for r in got]
