"""SimHash near-duplicates: vantage-point trees find every pair of fingerprints at a small Hamming distance.

A tree over a bounded sample of fingerprints deals all distinct fingerprints into shards: at each vantage point the
inner ones go in, the outer ones out, and inner ones within the radius of the border go both ways, which by the
triangle inequality keeps every near pair together in some shard.  Each shard goes on in the same way with its own
points down to small leaves, which are compared bit by bit.  A shard that a dense cluster keeps large is dealt as
tiles of block pairs.  Only links that join two trees of a union-find leave a shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NULL_ID, columns, fresh, materialize, read, steps, texts_of
from sluice.llm.components import Forest, components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Points a shard is cut for, points of a tile, points of a leaf, and the sample that the shards' tree is made of: so many
#: points at least, and so many for each shard (8 bytes each on the driver).
SHARD_POINTS, TILE_POINTS, LEAF_POINTS, SAMPLE, SHARD_SAMPLE = 32_768, 131_072, 384, 8_192, 32


def shingle_hashes(text: str) -> np.ndarray:
    ws = _WORD.findall(text.encode("utf-8", "replace").lower())
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    if len(ws) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str) -> int:
    """Bit i is set if over half of the shingle hashes have it; no words: zero."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 17):
        ones += np.unpackbits(h[i : i + (1 << 17)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp as a signed long) of whole texts; null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            fp = np.array([fingerprint(t) for t in texts_of(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def plant(points: np.ndarray, levels: int, radius: int = RADIUS) -> dict | None:
    """A tree of vantage points over a sample; None is a leaf.  Leaves that a border can't part stay whole."""
    if levels == 0 or len(points) < 8:
        return None
    vantage = points[0]
    d = np.bitwise_count(points ^ vantage)
    border = int(np.median(d))
    inside, outside = points[d <= border], points[d > border - radius]
    if max(len(inside), len(outside)) > 0.9 * len(points):
        return None
    return {"vantage": vantage, "border": border, "in": plant(inside, levels - 1, radius), "out": plant(outside, levels - 1, radius)}


def number(tree: dict | None, n: int = 0) -> tuple[object, int]:
    """The tree with its leaves numbered, and their number."""
    if tree is None:
        return n, n + 1
    inner, n = number(tree["in"], n)
    outer, n = number(tree["out"], n)
    return {**tree, "in": inner, "out": outer}, n


def deal(tree: object, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index) of every leaf that a fingerprint belongs to."""
    leaves, index, todo = [], [], [(tree, np.arange(len(fp)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, dict):
            leaves.append(np.full(len(at), node, np.int32))
            index.append(at)
            continue
        d = np.bitwise_count(fp[at] ^ node["vantage"])
        todo += [(node["in"], at[d <= node["border"]]), (node["out"], at[d > node["border"] - radius])]
    return np.concatenate(leaves), np.concatenate(index)


def near_links(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of distinct points: the least index that each is linked to through pairs within the radius."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        p = points[at]
        if len(at) <= LEAF_POINTS:
            near = np.bitwise_count(p[:, None] ^ p[None, :]) <= radius
            for i in np.flatnonzero(near.sum(axis=1) > 1):
                forest.join(at[near[i]])
            continue
        # a far point parts better than a central one
        vantage = p[int(np.argmax(np.bitwise_count(p ^ p[0])))]
        d = np.bitwise_count(p ^ vantage)
        border = int(np.median(d))
        inside, outside = at[d <= border], at[d > border - radius]
        if max(len(inside), len(outside)) > 0.95 * len(at):
            for i in at:  # a dense cluster: row by row, links are joined as they are found
                near = at[np.bitwise_count(p ^ points[i]) <= radius]
                if len(near) > 1:
                    forest.join(near)
            continue
        todo += [inside, outside]
    return forest.all()


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct(fp) -> edges (a, b) between fingerprints that connect all within the radius."""
    spark = distinct.sparkSession
    n = distinct.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / SHARD_POINTS))))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, SHARD_SAMPLE * n // SHARD_POINTS)).select("fp").collect()
    tree, leaves = number(plant(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), levels, radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, at = deal(tree, b.column("fp").to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("fp").take(pa.array(at))], ["leaf", "fp"])

    routed = materialize(distinct.select("fp").mapInArrow(route, "leaf int, fp long"), "simhash-shards")
    sizes = {r["leaf"]: r["count"] for r in routed.groupBy("leaf").count().collect()}  # a row per shard
    blocks = np.array([max(1, -(-sizes.get(i, 0) // TILE_POINTS)) for i in range(leaves)], np.int64)
    first = np.cumsum(blocks * (blocks + 1) // 2) - blocks * (blocks + 1) // 2
    tasks = int((blocks * (blocks + 1) // 2).sum())

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, fp = b.column("leaf").to_numpy(), b.column("fp").to_numpy()
            t = blocks[leaf]
            own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % t
            at = np.repeat(np.arange(len(leaf)), t)
            other = np.arange(len(at)) - np.repeat(np.cumsum(t) - t, t)
            i, j = np.minimum(own[at], other), np.maximum(own[at], other)
            task = first[leaf[at]] + j * (j + 1) // 2 + i
            yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int32)), b.column("fp").take(pa.array(at))], ["task", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b.column("fp").to_numpy() for b in batches]
        if not got:
            return
        fp = np.sort(np.concatenate(got))
        root = near_links(fp.view(np.uint64), radius)
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[root[linked]])], ["a", "b"])

    return routed.mapInArrow(tile, "task int, fp long").repartitionById(tasks, F.col("task")).mapInArrow(search, "a long, b long")


def groups(fps: DataFrame, least, radius: int = RADIUS) -> DataFrame:
    """(fp, least) of fps(fp, ...): the least ``least`` of all rows whose fingerprints are reachable from fp."""
    distinct = materialize(fps.groupBy("fp").agg(F.min(least).alias("least")), "simhash-distinct")
    parts = components(links(distinct, radius))
    parts = materialize(distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"), "least"), "simhash-parts")
    return materialize(parts.select("fp", "part").join(parts.groupBy("part").agg(F.min("least").alias("least")), "part").select("fp", "least"), "simhash-components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row: the least doc_id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint zero and link like others; texts of equal fingerprint are one point, so
    copies are never paired with each other; a null doc_id stands for no document and keeps a null component;
    repeated rows stay, and rows that share an id but not a text have groups of their own; an empty table gives an
    empty result.
    """
    fps = materialize(fingerprints(docs), "simhash")
    least = groups(fps.where("doc_id IS NOT NULL"), F.col("doc_id"), radius)
    return fps.join(least, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def op10_simhash_vptree(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents``; cases as in ``near_duplicates``."""
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that of the least doc_id, of equal ids that of the least hash of its text.

    A null doc_id is the least; of rows that are equal in id and text one stays; rows that share the id only are
    documents of their own; null and empty texts are one group; columns whose names clash with its own pass through; an empty table gives none.
    """
    names = docs.columns
    doc, tie = fresh(names, "near_doc"), fresh(names, "near_tie")
    own = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(doc), F.xxhash64("text").alias(tie)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            fp = np.array([fingerprint(t) for t in texts_of(b)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("tie"), pa.array(fp.view(np.int64))], ["doc", "tie", "fp"])

    fps = materialize(docs.select(own[0].alias("doc"), own[1].alias("tie"), "text").mapInArrow(run, "doc long, tie long, fp long"), "simhash")
    ref = F.struct("doc", "tie")
    first = fps.join(groups(fps, ref), "fp").where(ref == F.col("least")).groupBy("doc", "tie").agg(F.count("*").alias("n"))
    first = materialize(first, "simhash-first")
    kept = docs.select(*columns(docs), *own).join(first.select(F.col("doc").alias(doc), F.col("tie").alias(tie)), [doc, tie], "left_semi")
    if first.where("n > 1").limit(1).count():  # texts are shuffled only where rows are repeated
        kept = kept.dropDuplicates([doc, tie])
    return kept.select(*columns(docs))
