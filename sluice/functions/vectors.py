"""Vectors and sparse features as columns and small aggregations."""

from __future__ import annotations

import functools
import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import let
from sluice.operators.base import cut


def dot(a: Column, b: Column) -> Column:
    """Sum of products; vectors of unlike length are an error."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of unlike length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length or without length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), total / size).otherwise(0.0)


def l2_normalized(a: Column) -> Column:
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def generalized_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of dense vectors; 0 where that sum isn't positive."""
    both = F.zip_with(a, b, lambda x, y: F.struct(F.least(x, y).cast("double").alias("lo"), F.greatest(x, y).cast("double").alias("hi")))
    lo = F.aggregate(both, F.lit(0.0), lambda s, p: s + p["lo"])
    hi = F.aggregate(both, F.lit(0.0), lambda s, p: s + p["hi"])
    return F.when(hi > 0, lo / hi).otherwise(0.0)


def mean_vector(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """(by..., idx, val): mean of dense vectors, place by place."""
    out = df.select(*by, F.posexplode(vector).alias("idx", "x")).groupBy(*by, "idx")
    return out.agg(F.avg(F.col("x").cast("double")).alias("val"))


def score_summary(df: DataFrame, score: str) -> DataFrame:
    """count, min, max and mean; zeros without scores."""
    c = F.col(score)
    return df.agg(
        F.count(c).alias("count"), F.coalesce(F.min(c), F.lit(0.0)).alias("min"), F.coalesce(F.max(c), F.lit(0.0)).alias("max"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean")
    )


def top_k_sparse(vector: Column, k: int) -> Column:
    """array<struct<idx, val>>: the k entries of greatest size, by place, zeros left out."""
    places = F.filter(F.transform(vector, lambda x, i: F.struct((-F.abs(x)).alias("key"), i.alias("idx"), x.alias("val"))), lambda p: p["val"] != 0)
    best = F.slice(F.array_sort(places), 1, k)
    return F.array_sort(F.transform(best, lambda p: F.struct(p["idx"].alias("idx"), p["val"].alias("val"))))


def hashed_words(df: DataFrame, key: str, words: Column, width: int) -> DataFrame:
    """(key, sparse): share of a text's words in each of ``width`` hashed places, by place; texts without words have none.

    Stands in for learned sparse activations where there is no model; md5 keeps it equal across engines.  Words are
    counted by place before they are shuffled.
    """
    rows = df.select(key, F.explode(words).alias("w"))
    place = F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("int") % width
    counts = rows.groupBy(key, place.alias("idx")).agg(F.count("*").cast("double").alias("c"))
    per = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "c"))).alias("e"), F.sum("c").alias("n"))
    return per.select(key, F.transform("e", lambda x: F.struct(x["idx"].alias("idx"), (x["c"] / F.col("n")).alias("val"))).alias("sparse"))


def feature_rows(df: DataFrame, *keys: str, sparse: str = "sparse") -> DataFrame:
    """(keys..., idx, val), a row per entry of a sparse vector."""
    return df.select(*keys, F.explode(sparse).alias("e")).select(*keys, F.col("e.idx").alias("idx"), F.col("e.val").alias("val"))


def activation_rates(df: DataFrame, sparse: str = "sparse", width: int | None = None) -> DataFrame:
    """(idx, rate): share of samples with a vector in which a feature is active; places out of range don't count."""
    rows = feature_rows(df, sparse=sparse)
    if width is not None:
        rows = rows.where((F.col("idx") >= 0) & (F.col("idx") < width))
    n = df.agg(F.count(sparse).cast("double").alias("n"))
    return rows.groupBy("idx").count().crossJoin(F.broadcast(n)).select("idx", (F.col("count") / F.col("n")).alias("rate"))


def mean_activations(df: DataFrame, sparse: str = "sparse") -> DataFrame:
    n = df.agg(F.count(sparse).cast("double").alias("n"))
    return feature_rows(df, sparse=sparse).groupBy("idx").agg(F.sum("val").alias("s")).crossJoin(F.broadcast(n)).select("idx", (F.col("s") / F.col("n")).alias("mean"))


def drift(now: DataFrame, then: DataFrame, width: int) -> DataFrame:
    """One row ``drift``: distance of two tables of rates over the square root of the number of places."""
    both = now.select("idx", F.col("rate").alias("a")).join(then.select("idx", F.col("rate").alias("b")), "idx", "full")
    gap = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    root = F.sqrt(F.coalesce(F.sum(gap * gap), F.lit(0.0)))
    return both.agg((root / F.sqrt(F.lit(float(width))) if width > 0 else F.lit(0.0)).alias("drift"))


def activation_entropy(rates: DataFrame) -> DataFrame:
    """One row ``entropy``: Shannon entropy in nats of the normalised rates, 0 without any."""
    r = rates.where("rate > 0")
    total = r.agg(F.sum("rate").alias("t"))
    p = F.col("rate") / F.col("t")
    return r.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log(p)), F.lit(0.0)).alias("entropy"))


def jaccard_to_targets(df: DataFrame, targets: DataFrame, key: str = "sample_id", sparse: str = "sparse") -> DataFrame:
    """(key, benchmark, score): generalized Jaccard of sparse samples with every target vector.

    targets(benchmark, idx, val) has at most places x benchmarks rows whatever the data, so it is broadcast.  Only a
    sample's own entries are joined; the rest of each target comes in through its sum.
    """
    total = targets.groupBy("benchmark").agg(F.sum("val").alias("total"))
    t = targets.select("benchmark", "idx", F.col("val").alias("t"))
    names = F.broadcast(total)
    rows = feature_rows(df, key, sparse=sparse).crossJoin(names).join(F.broadcast(t), ["benchmark", "idx"], "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    g = rows.groupBy(key, "benchmark", "total").agg(F.sum(F.least("val", "t")).alias("lo"), F.sum(F.greatest("val", "t")).alias("hi"), F.sum("t").alias("own"))
    whole = F.col("hi") + F.col("total") - F.col("own")
    return g.select(key, "benchmark", F.when(whole > 0, F.col("lo") / whole).otherwise(0.0).alias("score"))


def sampled_positions(n: int, label: str, seed: int = 42, most: int = 128) -> list[int]:
    """Ascending places of a reproducible sample of ``most`` of ``n``; everything where there are no more."""
    if n <= most:
        return list(range(n))
    rng = random.Random(int(hashlib.md5(f"{seed}:{label}".encode()).hexdigest(), 16) % 2**32)
    return sorted(rng.sample(range(n), most))


def token_average(df: DataFrame, length: str, *keys: str) -> DataFrame:
    """(keys..., idx, val): activations of tokens added up by feature over the sequence length; positive ones stay."""
    return df.groupBy(*keys, "idx").agg((F.sum("val") / F.first(length)).alias("val")).where("val > 0")


def without_zeros(sparse: Column) -> Column:
    """A sparse vector without entries of 0."""
    return F.filter(sparse, lambda e: e["val"] != 0)


def positive_summary(df: DataFrame, score: str) -> DataFrame:
    """count, mean and population deviation of the scores above 0; zeros without any."""
    c = F.when(F.col(score) > 0, F.col(score).cast("double"))
    return df.agg(F.count(c).alias("count"), F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("std"))


def random_projection(df: DataFrame, key: str, vector: str, width: int, size: int, seed: int = 0) -> DataFrame:
    """(key, v): vectors of ``width`` times a seeded matrix of 1 and -1, which every task makes for itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signs = np.random.default_rng(seed).integers(0, 2, (width, size)).astype(np.float64) * 2 - 1
        for pdf in frames:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "v": list(np.stack(pdf[vector].to_numpy()).astype(np.float64) @ signs)})

    return df.select(key, vector).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, v array<double>")


def ifd(full_loss: Column, response_loss: Column) -> Column:
    return F.when(response_loss > 1e-8, full_loss / response_loss).otherwise(1.0)


def varentropy(logprobs: Column) -> Column:
    """Mean over tokens of the variance of surprisal; ``logprobs`` is array<array<double>>, a distribution a token."""
    entropy = lambda lp: -F.aggregate(lp, F.lit(0.0), lambda s, x: s + F.exp(x) * x)
    one = lambda lp: let(entropy(lp), lambda h: F.aggregate(lp, F.lit(0.0), lambda s, x: s + F.exp(x) * F.pow(x + h, F.lit(2.0))))
    each = F.transform(logprobs, one)
    return F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(each)).otherwise(F.lit(None).cast("double"))


#: Bytes of validation vectors that are broadcast at once.
BROADCAST_BYTES = 64 << 20
#: Products of train and validation rows that a task holds at once.
PRODUCTS = 1 << 21


def influence(train: DataFrame, valid: DataFrame, weights: dict[str, float] | None = None, subtasks: int = 0, within: str = "mean", across: str = "max") -> DataFrame:
    """(train_id, influence): dot products of train and validation vectors, reduced over the validation set.

    train(train_id, checkpoint, v), valid(pos, checkpoint, v); validation vectors are broadcast as matrices, in blocks of about
    BROADCAST_BYTES, each of which is one more pass over the train vectors.  For a maximum all pairs are multiplied, by matrix
    products; a mean or sum of products is one product with the sum of the validation vectors.  What leaves a task is a row for each
    train row, run and block.  Checkpoints are added up with normalised weights.  With ``subtasks``, equal contiguous runs of
    validation rows are reduced by ``within`` and the runs by ``across``; otherwise all rows by ``across``.
    """
    if weights is not None and sum(weights.values()) == 0:
        raise ValueError("weights add up to zero")
    n, rows, width = valid.agg(F.countDistinct("pos"), F.count("*"), F.max(F.size("v"))).first()
    if subtasks and n % subtasks:
        raise ValueError(f"{n} validation rows can't be parted into {subtasks} equal subtasks")
    total = sum(weights.values()) if weights is not None else 1.0
    weigh = {k: x / total for k, x in weights.items()} if weights is not None else None
    part = F.floor(F.col("pos") / max(n // subtasks, 1)) if subtasks else F.lit(0)
    v = valid.select("pos", "checkpoint", F.col("v").cast("array<double>").alias("v"), part.cast("long").alias("part"), F.lit(1).cast("long").alias("n"))
    summed = (within if subtasks else across) != "max"
    if summed:
        v = cut(_added_up(v))
        rows = v.count()
    blocks = max(1, -(-rows * (8 * (width or 0) + 64) // BROADCAST_BYTES))
    if blocks > 1:  # all checkpoints of a validation row are in one block, and so are most rows of a run
        ranged = subtasks and not summed
        blocks *= 1 if ranged else 2  # hashed blocks are of unlike sizes
        v = cut(v.withColumn("_block", F.floor(F.col("pos") * blocks / n) if ranged else F.pmod(F.xxhash64("pos"), F.lit(blocks))))
    items = train.groupBy("train_id").agg(F.collect_list(F.struct("checkpoint", F.col("v").cast("array<double>").alias("v"))).alias("items"))
    kind = train.schema["train_id"].dataType.simpleString()
    out = f"train_id {kind}, part long, n long, total double, most double"
    met = []
    for i in range(blocks):
        shared = train.sparkSession.sparkContext.broadcast(_validation_block((v.where(F.col("_block") == i) if blocks > 1 else v).toArrow()))
        met.append(items.mapInArrow(functools.partial(_meet, shared, weigh), out))
    got = functools.reduce(DataFrame.union, met).groupBy("train_id", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    x = {"mean": F.when(F.col("n") > 0, F.col("total") / F.col("n")), "max": F.col("most"), "sum": F.when(F.col("n") > 0, F.col("total"))}
    if not subtasks:
        return got.select("train_id", x[across].alias("influence"))
    reduce = {"mean": F.avg, "max": F.max, "sum": F.sum}
    return got.select("train_id", x[within].alias("x")).groupBy("train_id").agg(reduce[across]("x").alias("influence"))


def _added_up(v: DataFrame) -> DataFrame:
    """Sums of the vectors of v(pos, checkpoint, v, part, n), by run and checkpoint, of positions that have the same checkpoints
    with and without a value: each train row has products with all of them or with none.  n is their number, pos the
    least of them; a checkpoint without a value stays as a vector of nulls."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # (run, names, with a value) -> [least position, positions, {checkpoint: sum}]
        size = 0

        def told() -> pa.RecordBatch:
            rows = [(pos, c, total.tolist() if valued else [None] * len(total), part, n, "|".join(f"{len(x)}:{x}{int(y)}" for x, y in kind)) for (part, kind), (pos, n, by) in held.items() for (c, valued), total in zip(kind, by, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (f.type for f in _SUMS), strict=True)], schema=_SUMS)

        for batch in batches:
            items = batch.column("items")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64))
            names, vectors = (pc.struct_field(items.flatten(), k) for k in ("checkpoint", "v"))
            m, torn = _matrix(vectors)
            coded = names.dictionary_encode()
            words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            width = max(len(words), 1)
            # a position's checkpoints: 1 known, 3 known with a value
            marks = np.zeros((batch.num_rows, width), np.int8)
            marks[owner, code] = 1
            marks[owner[~torn], code[~torn]] = 3
            pos, part = (batch.column(c).to_numpy().astype(np.int64) for c in ("pos", "part"))
            kinds, which = np.unique(np.column_stack([part, marks]), axis=0, return_inverse=True)
            which = which.reshape(-1)
            order = np.argsort(which[owner] * width + code, kind="stable")
            order = order[~torn[order]]
            slot = (which[owner] * width + code)[order]
            starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else slot
            totals = dict(zip(slot[starts].tolist(), np.add.reduceat(m[order], starts, axis=0), strict=True)) if len(slot) else {}
            number, least = np.bincount(which, minlength=len(kinds)), np.full(len(kinds), np.iinfo(np.int64).max)
            np.minimum.at(least, which, pos)
            for k, row in enumerate(kinds.tolist()):
                has = sorted((words[i], row[1 + i] == 3, i) for i in range(len(words)) if row[1 + i])
                key = row[0], tuple((c, valued) for c, valued, _ in has)
                by = [totals.get(k * width + i, np.zeros(m.shape[1])) for _, _, i in has]
                if key in held:
                    old = held[key]
                    if any(len(a) != len(b) for a, b in zip(old[2], by, strict=True)):
                        raise ValueError("vectors of unlike length")
                    held[key] = [min(old[0], int(least[k])), old[1] + int(number[k]), [a + b for a, b in zip(old[2], by, strict=True)]]
                else:
                    held[key] = [int(least[k]), int(number[k]), by]
                    size += sum(map(len, by))
            if size > PRODUCTS:
                yield told()
                held, size = {}, 0
        if held:
            yield told()

    def joined(table: pa.Table) -> pa.Table:
        out = []
        for c in table.column("checkpoint").unique().to_pylist():
            mine = table.filter(pc.equal(table.column("checkpoint"), c)).combine_chunks()
            m, torn = _matrix(mine.column("v").combine_chunks())
            total = [None] * m.shape[1] if torn.any() else m.sum(axis=0).tolist()
            out.append((pc.min(mine.column("pos")).as_py(), c, total, mine.column("part")[0].as_py(), pc.sum(mine.column("n")).as_py()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), list(_SUMS)[:5], strict=True)], schema=pa.schema(list(_SUMS)[:5]))

    by = v.where("checkpoint IS NOT NULL").groupBy("part", "pos").agg(F.collect_list(F.struct("checkpoint", "v")).alias("items"))
    kind = "pos long, checkpoint string, v array<double>, part long, n long"
    return by.mapInArrow(sums, kind + ", kind string").groupBy("part", "kind").applyInArrow(joined, kind)


_SUMS = pa.schema([("pos", pa.int64()), ("checkpoint", pa.string()), ("v", pa.list_(pa.float64())), ("part", pa.int64()), ("n", pa.int64()), ("kind", pa.string())])


def _matrix(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of them have a null inside."""
    size = pc.list_value_length(v)
    if size.null_count or len(size.unique()) > 1:
        raise ValueError("vectors of unlike length")
    flat, width = v.flatten(), size[0].as_py() if len(size) else 0
    holed = np.zeros(len(v), bool)
    if flat.null_count:
        holed[np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) // width] = True
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(v), width), holed


def _validation_block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(part of each run, first column of each run, positions of each column, {checkpoint: (columns, vectors as columns, which have
    a null inside)}); a column is a validation row or the sum of some, and those of a run stand together."""
    table = table.combine_chunks()
    part, pos = (table.column(c).to_numpy().astype(np.int64) for c in ("part", "pos"))
    keys, at, column = np.unique(np.stack([part, pos]), axis=1, return_index=True, return_inverse=True)
    runs, first = np.unique(keys[0], return_index=True)
    each = table.column("n").to_numpy().astype(np.int64)[at]
    names, out = table.column("checkpoint"), {}
    for c in names.unique().to_pylist():
        if c is not None:
            at = np.flatnonzero(pc.fill_null(pc.equal(names, c), False).to_numpy())
            at = at[np.argsort(column.reshape(-1)[at], kind="stable")]
            m, holed = _matrix(table.column("v").combine_chunks().take(pa.array(at)))
            out[c] = column.reshape(-1)[at], np.ascontiguousarray(m.T), holed
    return runs, first, each, out


def _meet(shared: Broadcast, weigh: dict | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each train row and run of a block: how many products there are, their sum and the largest."""
    runs, first, each, by = shared.value
    m = 1 + max((int(columns.max()) for columns, _, _ in by.values()), default=-1)
    step = max(1, PRODUCTS // max(m, 1))
    for whole in batches:
        for at in range(0, whole.num_rows if m else 0, step):
            batch = whole.slice(at, step)
            items = batch.column("items")
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64))
            names, vectors = (pc.struct_field(items.flatten(), k) for k in ("checkpoint", "v"))
            x = np.zeros((batch.num_rows, m))
            known, valued = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
            for c, (columns, u, holed) in by.items():
                here = np.flatnonzero(pc.fill_null(pc.equal(names, c), False).to_numpy(zero_copy_only=False))
                if not len(here):
                    continue
                t, torn = _matrix(vectors.take(pa.array(here)))
                if t.shape[1] != u.shape[0]:
                    raise ValueError("vectors of unlike length")
                w = 1.0 if weigh is None else weigh.get(c)
                if w is not None and len(here) == len(x) and len(columns) == m and not (torn.any() or holed.any()) and (owner[here] == np.arange(len(x))).all() and (columns == np.arange(m)).all():
                    x += t @ u * w
                    known[:] = valued[:] = True
                    continue
                known[np.ix_(owner[here], columns)] = True
                if w is None:
                    continue
                to = np.ix_(owner[here][~torn], columns[~holed])
                product = t[~torn] @ u[:, ~holed] * w
                if len(np.unique(to[0])) == to[0].size and len(np.unique(to[1])) == to[1].size:
                    x[to] += product
                else:
                    np.add.at(x, to, product)
                valued[to] = True
            some = np.logical_or.reduceat(known, first, axis=1)
            n = np.add.reduceat(valued * each, first, axis=1, dtype=np.int64)
            total = np.add.reduceat(x, first, axis=1)
            most = np.maximum.reduceat(x if valued.all() else np.where(valued, x, -np.inf), first, axis=1)
            row, run = np.nonzero(some)
            none = n[row, run] == 0
            columns = [batch.column("train_id").take(pa.array(row)), pa.array(runs[run]), pa.array(n[row, run]), pa.array(total[row, run]), pa.array(most[row, run], mask=none)]
            yield pa.RecordBatch.from_arrays(columns, ["train_id", "part", "n", "total", "most"])
