"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and overlap of question and answer.

Passages of every document are queries against the index.  Items are indexed in units of at most UNIT words, any of
which fits into a passage; a unit's score is taken as a share of the score that its own words give, so one threshold
serves all.  Document frequencies, the number of units and their mean length are those of all items, however many
parts the index has.  For each unit the words of least impact, which together hold a small share of the threshold, are
left to the second step.  Block-max bounds of the others are added up for all passages at once, then, in the blocks
that could lift a unit over the threshold, those of the units; passages with such a unit go through block-max WAND,
which gives all units above it.
Their items are verified: by the 5-word shingles near the passage, a share of the question's and one of the answer's.
"""

from __future__ import annotations

import functools
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import store
from sluice.llm.common import at_hand, materialize, read, shared_path, steps, texts_of

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B, BLOCK = 1.2, 0.75, 16
#: Words of a unit and of a passage; passages overlap by half, so every unit is within some passage.
UNIT, PASSAGE = 48, 96
#: Share of a unit's own score that a passage must reach, and shares of the item's 5-word shingles that must be there: of
#: those of question words alone, and of those with an answer's word.
SCORE, QUESTION, ANSWER, SHINGLE = 0.4, 0.5, 0.5, 5
#: Bytes of items of one index; more are indexed in parts, to all of which a run of that many bytes of text is put at a time.
INDEX_BYTES, RUN_BYTES = 8 << 20, 64 << 20
#: Share of the threshold that a unit's words of least impact may hold and be left to the second step, and block bounds
#: that are added up at a time.
INESSENTIAL, BOUNDS = 0.25, 1 << 22


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence is all question."""
    parts = [w for s in _SENTENCE.split(text.strip()) if (w := words_of(s))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str]) -> list[tuple[str, ...]]:
    """5-word shingles; fewer words are one shingle."""
    return [tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)] or ([tuple(words)] if words else [])


def units_of(words: list[str]) -> list[list[str]]:
    """Windows of UNIT words that cover an item, the last one flush with its end."""
    last = len(words) - UNIT
    return [words[i : i + UNIT] for i in [*range(0, last, UNIT // 2), last]] if last > 0 else [words]


def parsed(items: list[tuple[int, str]]) -> list[tuple[int, list[str], list[str]]]:
    """(id, question, answer) of the items that have words, by id and text."""
    return [(i, q, a) for i, t in sorted(items) for q, a in [question_and_answer(t)] if q]


class Index:
    """Postings with impacts relative to each unit's own score, in blocks that know their greatest impact."""

    def __init__(self, items: list[tuple[int, str]], stats: tuple[int, float, dict[str, int]] | None = None):
        parts = parsed(items)
        self.ids = [i for i, _, _ in parts]
        whole = [q + a for _, q, a in parts]
        self.sizes = [len(ws) for ws in whole]
        self.grams = []
        for (_, q, _), ws in zip(parts, whole, strict=True):
            first_answer = len(q) - min(SHINGLE, len(ws)) + 1  # shingles from here on hold an answer's word
            gs = grams(ws)
            self.grams.append((set(gs[: max(0, first_answer)]), set(gs[max(0, first_answer) :])))
        units = [(k, u) for k, ws in enumerate(whole) for u in units_of(ws)]
        self.item = [k for k, _ in units]
        tf = [Counter(u) for _, u in units]
        n, mean, df = stats or (len(units), sum(len(u) for _, u in units) / max(1, len(units)), Counter(t for c in tf for t in c))
        self.terms: dict[str, int] = {}
        posts: list[list[tuple[int, float]]] = []
        essential: list[dict[int, list[tuple[int, float]]]] = []
        self.blocks = -(-len(units) // BLOCK)
        self.rest, self.block_rest = np.zeros(len(units)), np.zeros(self.blocks)  # what the inessential words add up to, at most
        for i, (c, (_, u)) in enumerate(zip(tf, units, strict=True)):
            norm = K1 * (1 - B + B * len(u) / mean)
            impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            own, rest, block = sum(impact.values()), 0.0, i // BLOCK
            for t, x in sorted(impact.items(), key=lambda p: (p[1], p[0])):
                k = self.terms.setdefault(t, len(self.terms))
                if k == len(posts):
                    posts.append([])
                    essential.append({})
                x = float(x / own)
                posts[k].append((i, x))
                if rest + x < SCORE * INESSENTIAL:
                    rest += x
                else:
                    essential[k].setdefault(block, []).append((i, x))
            self.rest[i], self.block_rest[block] = rest, max(self.block_rest[block], rest)
        self.items = [np.array([i for i, _ in p], np.int64) for p in posts]
        self.impacts = [np.array([x for _, x in p]) for p in posts]
        self.most = [float(x.max()) for x in self.impacts]
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)).tolist() for x in self.impacts]
        self.starts = np.cumsum([0, *map(len, essential)])
        self.e_blocks = np.array([b for e in essential for b in e], np.int64)
        self.e_most = np.array([max(x for _, x in us) for e in essential for us in e.values()])
        self.e_starts = np.cumsum([0, *(len(us) for e in essential for us in e.values())])
        self.e_units = np.array([i for e in essential for us in e.values() for i, _ in us], np.int64)
        self.e_impacts = np.array([x for e in essential for us in e.values() for _, x in us])

    def plausible(self, term: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """Of words (term, passage): the passages with a unit whose bound reaches the threshold, which is looked for in the
        blocks whose bound does."""
        at = np.flatnonzero(self.starts[term + 1] > self.starts[term])
        if not len(at) or not self.ids:
            return np.zeros(0, np.int64)
        once = np.unique(passage[at] * len(self.terms) + term[at])  # a word counts once a passage
        passage, term = once // len(self.terms), once % len(self.terms)
        n = self.starts[term + 1] - self.starts[term]
        # whole passages at a time, about BOUNDS bounds
        ends = np.append(np.flatnonzero(passage[1:] != passage[:-1]) + 1, len(n))
        chunk = (np.cumsum(n)[ends - 1] - 1) // BOUNDS
        out, s = [], 0
        for upto in ends[np.append(chunk[1:] != chunk[:-1], True)].tolist():
            m = n[s:upto]
            post = np.repeat(self.starts[term[s:upto]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pair, where = np.unique(np.repeat(passage[s:upto], m) * self.blocks + self.e_blocks[post], return_inverse=True)
            open_ = np.bincount(where, self.e_most[post]) + self.block_rest[pair % self.blocks] >= SCORE - 1e-9
            entry, own = post[open_[where]], np.repeat(passage[s:upto], m)[open_[where]]
            m = self.e_starts[entry + 1] - self.e_starts[entry]
            post = np.repeat(self.e_starts[entry] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pair, where = np.unique(np.repeat(own, m) * len(self.rest) + self.e_units[post], return_inverse=True)
            bound = np.bincount(where, self.e_impacts[post]) + self.rest[pair % len(self.rest)]
            out.append(np.unique(pair[bound >= SCORE - 1e-9] // len(self.rest)))
            s = upto
        return np.concatenate(out)

    def above(self, terms: list[int], threshold: float = SCORE) -> list[tuple[int, float]]:
        """(unit, score) of all units whose impacts over the distinct ``terms`` add up to the threshold: block-max WAND."""
        lists = {t: self.items[t] for t in sorted(set(terms))}
        place = dict.fromkeys(lists, 0)
        at = lambda t: int(lists[t][place[t]]) if place[t] < len(lists[t]) else 1 << 62
        skip = lambda t, to: bisect_left(lists[t], to, place[t])
        out, floor = [], threshold - 1e-9
        while True:
            live = sorted((x, t) for t in lists if (x := at(t)) < 1 << 62)
            bound, pivot = 0.0, None
            for k, (x, t) in enumerate(live):
                bound += self.most[t]
                if bound >= floor:
                    pivot = x
                    while k + 1 < len(live) and live[k + 1][0] == x:
                        k += 1
                    break
            if pivot is None:
                return out
            ahead = [t for _, t in live[: k + 1]]
            block_bound, block_end = 0.0, 1 << 62
            for t in ahead:
                p = skip(t, pivot)
                if p < len(lists[t]):
                    block_bound += self.block_most[t][p // BLOCK]
                    block_end = min(block_end, int(lists[t][min(len(lists[t]), (p // BLOCK + 1) * BLOCK) - 1]))
            if block_bound < floor:
                target = min(block_end + 1, live[k + 1][0] if k + 1 < len(live) else 1 << 62)
                target = max(target, pivot + 1)
                for t in ahead:
                    place[t] = skip(t, target)
            elif live[0][0] == pivot:
                score = sum(float(self.impacts[t][place[t]]) for t in ahead if at(t) == pivot)
                if score >= floor:
                    out.append((pivot, score))
                for t in ahead:
                    place[t] += at(t) == pivot
            else:
                for t in ahead:
                    place[t] = skip(t, pivot)


def overlap(gs: set[tuple[str, ...]], near: dict[int, set[tuple[str, ...]]]) -> float:
    """Share of the shingles that are near; of none, all."""
    return sum(g in near[len(g)] for g in gs) / len(gs) if gs else 1.0


def hits(index: Index, texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item, score, question overlap, answer overlap, overlap) of verified pairs; the best of a pair's passages."""
    stride = PASSAGE // 2
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    get, none = index.terms.get, -1
    term = np.fromiter((get(w, none) for ws in split for w in ws), np.int64, int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passages = np.maximum(1, -(-(sizes - PASSAGE) // stride) + 1)
    first = np.cumsum(passages) - passages
    known = np.flatnonzero(term >= 0)
    k = within[known] // stride
    second = k < passages[text[known]]
    owner = np.concatenate([first[text[known][second]] + k[second], first[text[known][k > 0]] + k[k > 0] - 1])
    best: dict[tuple[int, int], tuple] = {}
    for p in index.plausible(np.concatenate([term[known][second], term[known][k > 0]]), owner).tolist():
        d = int(np.searchsorted(first, p, side="right")) - 1
        ws, start = split[d], (p - int(first[d])) * stride
        score: dict[int, float] = {}
        for unit, x in index.above([t for w in ws[start : start + PASSAGE] if (t := get(w)) is not None]):
            score[index.item[unit]] = max(x, score.get(index.item[unit], 0.0))
        near: dict[int, dict[int, set]] = {}
        for i, x in score.items():
            reach = -(-index.sizes[i] // PASSAGE) * PASSAGE
            if reach not in near:
                span = ws[max(0, start - reach) : start + PASSAGE + reach]
                near[reach] = {n: set(zip(*(span[j:] for j in range(n)), strict=False)) for n in range(1, SHINGLE + 1)}
            q, a = index.grams[i]
            nq, na = overlap(q, near[reach]), overlap(a, near[reach])
            if nq >= QUESTION and na >= ANSWER:
                row = (x, nq, na, (nq * len(q) + na * len(a)) / (len(q) + len(a)))
                best[d, i] = max(row, best.get((d, i), row))
    return [(d, index.ids[i], *row) for (d, i), row in sorted(best.items())]


def statistics(items: DataFrame) -> tuple[int, float, DataFrame]:
    """Number of units of all items, their mean length, and (word, df)."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us = [u for _, q, a in parsed([(0, t) for t in b.column("text").to_pylist()]) for u in units_of(q + a)]
            yield pa.RecordBatch.from_pydict({"size": pa.array(map(len, us), pa.int64()), "words": pa.array([sorted(set(u)) for u in us], pa.list_(pa.string()))})

    held = materialize(items.mapInArrow(units, "size long, words array<string>"), "benchmark-units")
    n, mean = held.agg(F.count("*"), F.avg("size")).first()
    return n, mean or 1.0, held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def build(spark: SparkSession, items: DataFrame, most: int = INDEX_BYTES) -> Callable[[], Iterator[Index]]:
    """What gives a worker the parts of the index, one after the other.

    The driver holds the items of one part, about ``most`` bytes; a single part is handed out whole, several go to
    files in the shared folder.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= most:
        shared = spark.sparkContext.broadcast(Index([tuple(r) for r in items.collect()]))
        return lambda: iter([shared.value])
    items = materialize(items, "benchmark-items")
    n, mean, df = statistics(items)
    df = materialize(df, "benchmark-words")
    parts, out = -(-size // most), shared_path(spark, "benchmark-index")
    fs, root = store.place(out)
    fs.create_dir(root, recursive=True)
    for p in range(parts):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()]
        words = spark.createDataFrame(sorted({(w,) for _, q, a in parsed(own) for w in q + a}) or [("",)], "word string")
        index = Index(own, (n, mean, {r["word"]: r["df"] for r in df.join(words, "word").collect()}))
        with fs.open_output_stream(f"{root}/{p}") as f:
            f.write(pickle.dumps(index))
    return lambda: (_part(out, p) for p in range(parts))


@at_hand
@functools.lru_cache(maxsize=1)
def _part(out: str, p: int) -> Index:
    return pickle.loads(store.load(out, str(p)))


def searched(parts: Callable[[], Iterator[Index]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Steps of documents with their hits; a run of steps is put to one part of the index after the other."""

    def run(held: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
        found: list[list[tuple]] = [[] for _ in held]
        for index in parts():
            for b, got in zip(held, found, strict=True):
                got += hits(index, texts_of(b))
        yield from zip(held, found, strict=True)

    held, size = [], 0
    for b in steps(batches, "text"):
        held.append(b)
        size += b.nbytes
        if size >= RUN_BYTES:
            yield from run(held)
            held, size = [], 0
    yield from run(held)


def contaminated(docs: DataFrame, items: DataFrame, most: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, overlap of each document that holds an item.

    Null texts hold nothing; items without id, text or words are left out, equal ones count once, and an item without
    an answer (a single sentence) is asked for its question alone; whole texts of any length are searched, in one scan;
    repeated documents give repeated rows, a null doc_id is passed on; other columns are ignored; with no document or
    no item the result is empty.
    """
    parts = build(docs.sparkSession, items, most)
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in searched(parts, batches):
            if got:
                at, *cols = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), *(pa.array(c) for c in cols)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op9_bm25_decontamination(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents`` and ``benchmark``, shares rounded to 6 places; cases as in ``contaminated``."""
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", *(F.round(c, 6).alias(c) for c in ("score", "question_overlap", "answer_overlap", "overlap")))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item, with all their columns; the search takes place in the scan, so nothing is
    joined.  Null and empty texts, null ids and repeated rows stay; with no item all stay."""
    parts = build(spark, read(spark, sf_dir, "benchmark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, got in searched(parts, batches):
            keep = np.ones(b.num_rows, bool)
            keep[[h[0] for h in got]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
