"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

Words get log-odds between toxic and clean labelled texts under an informative Dirichlet prior.  A linear scan finds
every maximal-scoring segment of a text; how likely a clean text of that length holds so good a segment follows an
extreme-value law whose decay solves the score equation and whose size is fitted to clean texts.  A logistic curve
over that significance gives the text's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import drop_table, materialize, read, steps, texts_of

_WORD = re.compile(r"\w+")
#: Labelled rows that the classifier is fitted on at most (those of least hash of doc_id), and words it remembers.
TRAIN_ROWS, MODEL_WORDS = 20_000, 20_000
#: Weight of the prior in words, its least share of a word, least z-score of a word that counts, bounds of a word's
#: score, and the cost of any other word.
PRIOR, LEAST_PRIOR, LEAST_Z, MOST, OTHER = 500.0, 0.5, 3.5, 6.0, -0.12
#: Lengths of the beginnings of words that stand for words too rare to be judged, and words a worker remembers.
BEGINNINGS, MEMO_WORDS = (8, 7, 6, 5, 4), 300_000
HELD_OUT, THRESHOLD = 2, 0.3


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """A word and its beginnings, the longest first."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, start, end) of all maximal-scoring segments (Ruzzo and Tompa), in linear time.

    Runs of positive scores are candidates; one is merged with the nearest earlier one of lower start sum whose end
    sum is lower as well, found by links between candidates rather than by going through all of them.
    """
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    edge = np.diff(np.concatenate([[0], positive.astype(np.int8), [0]]))
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, start, end, place of the lower one
    for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        low, high, start = float(total[i]), float(total[j]), i
        while True:
            m = len(held) - 1
            while m >= 0 and held[m][0] >= low:
                m = held[m][4]
            if m < 0 or held[m][1] >= high:
                held.append((low, high, start, j, m))
                break
            low, start = held[m][0], held[m][2]
            del held[m:]
    return [(high - low, start, end) for low, high, start, end, _ in held]


@dataclass
class Model:
    weights: dict[str, float]
    decay: float = 1.0  # lambda
    size: float = 1.0  # K
    curve: tuple[float, float, float] = field(default=(0.0, 1.0, 0.0))

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def scores(self, words: list[str]) -> np.ndarray:
        memo, weights = self.memo, self.weights
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = next((weights[f] for f in features(w) if f in weights), OTHER)
        return np.fromiter((memo[w] for w in words), float, len(words))

    def evidence(self, text: str) -> tuple[float, float, int, list[tuple[float, int, int]]]:
        """Log significance of the best segment, sum of it over all significant segments, words, and segments."""
        ws = words_of(text)
        found = segments(self.scores(ws)) if ws else []
        # -log of the number of such segments that a clean text of that length is expected to have
        expected = np.log(self.size * max(1, len(ws)))
        worth = [self.decay * s - expected for s, _, _ in found]
        best = max(worth, default=-expected)
        return best, float(sum(x for x in worth if x > 0)), len(ws), found

    def score(self, best: float, more: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-(a + b * best + c * np.log1p(more)))))

    def passages(self, text: str, most_expected: float = 0.01) -> list[tuple[int, int, float]]:
        """(first word, word after, expected number in clean texts) of the significant segments."""
        n = max(1, len(words_of(text)))
        found = self.evidence(text)[3]
        return [(i, j, e) for s, i, j in found if (e := float(self.size * n * np.exp(-self.decay * s))) <= most_expected]


def decay_of(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * score)) = 1 for scores of negative mean."""
    if not (score > 0).any():
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((share * np.exp(x * score)).sum()) - 1
    while f(high) < 0 and high < 64:
        high *= 2
    low = high / 2**30
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients by Newton's method with a slight ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), x.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled rows that aren't held out: texts with a word count, not its repetitions.

    Of several labels of a document the greatest counts; null labels and ids are left out.  Without a toxic or
    without a clean row nothing can be told apart and every score is the share of toxic rows.
    """
    picked = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    picked = picked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = {r["doc_id"]: int(r["toxic"] > 0) for r in picked.collect()}  # bounded by rows
    n_toxic = sum(known.values())
    if not 0 < n_toxic < len(known):
        p = min(max(n_toxic / len(known) if known else 0.0, 1e-6), 1 - 1e-6)
        return Model({}, curve=(float(np.log(p / (1 - p))), 0.0, 0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for b in steps(batches, "text"):
            for y, t in zip(b.column("label").to_pylist(), texts_of(b), strict=True):
                seen[y].update({f for w in set(words_of(t)) for f in features(w)})  # once a text: a word repeated is no more proof
        ws = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"word": pa.array(ws, pa.string()), "clean": pa.array([seen[0][w] for w in ws], pa.int64()), "toxic": pa.array([seen[1][w] for w in ws], pa.int64())})

    # the picked rows, at most ``rows`` of them, are handed to the scan; their texts are read once
    label = F.broadcast(spark.createDataFrame(sorted(known.items()), "doc_id long, label int"))
    own = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(label, "doc_id").select("label", "text"), "toxicity-rows")
    counted = own.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = materialize(counted, "toxicity-words")
    total = counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    nc, nt = total["clean"] or 0, total["toxic"] or 0
    prior = F.lit(PRIOR) * (F.col("clean") + F.col("toxic")) / F.lit(float(max(1, nc + nt))) + LEAST_PRIOR
    odds = lambda n, of: F.log((F.col(n) + prior) / (F.lit(of + PRIOR) - F.col(n) - prior))
    delta = odds("toxic", nt) - odds("clean", nc)
    z = delta / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    top = counted.select("word", "clean", "toxic", delta.alias("delta"), z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(MODEL_WORDS).collect()
    drop_table(counted)
    weights = {r["word"]: float(np.clip(r["delta"], -MOST, MOST)) + OTHER for r in top}
    # scores of a clean text's words, those without a weight together
    points = np.array([*weights.values(), OTHER])
    seen = np.array([*(r["clean"] + LEAST_PRIOR for r in top), 0.0])
    seen[-1] = max(1.0, nc - seen.sum())
    model = Model(weights, decay=decay_of(points, seen / seen.sum()))
    first = spark.sparkContext.broadcast(model)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            rows = [(y, e[2], max((s for s, _, _ in e[3]), default=0.0), [s for s, _, _ in e[3]]) for y, t in zip(b.column("label").to_pylist(), texts_of(b), strict=True) for e in [first.value.evidence(t)]]
            yield pa.RecordBatch.from_pydict({"y": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()), "s": pa.array([r[2] for r in rows], pa.float64()), "all": pa.array([r[3] for r in rows], pa.list_(pa.float64()))})

    got = own.mapInArrow(best, "y int, n long, s double, all array<double>").collect()  # a row per training row
    drop_table(own)
    got.sort(key=lambda r: (r["y"], r["n"], r["s"], r["all"]))
    clean = [(max(1, r["n"]), r["s"]) for r in got if r["y"] == 0]
    model.size = max(1e-9, len(clean) / sum(n * np.exp(-model.decay * s) for n, s in clean))  # most likely under the law
    x = []
    for r in got:
        e = np.log(model.size * max(1, r["n"]))
        worth = [model.decay * s - e for s in r["all"]]
        x.append((max(worth, default=-e), np.log1p(sum(v for v in worth if v > 0))))
    model.curve = tuple(float(v) for v in logistic(np.array(x), np.array([r["y"] for r in got], float)))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages (significant segments) of every whole text; null and empty texts have no segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in steps(batches, "text"):
            points, passages = [], []
            for t in texts_of(b):
                best, more, n, found = m.evidence(t)
                points.append(m.score(best, more))
                passages.append(sum(m.size * max(1, n) * np.exp(-m.decay * s) <= 0.01 for s, _, _ in found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(points, pa.float64()), pa.array(passages, pa.int64())], ["doc_id", "score", "n_passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_passages long")


def op5_toxic_segments(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(spark, docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
