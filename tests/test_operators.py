"""Operators against list models, with ties, missing scores and empty sets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import base, dedup, mix, score_filter
from sluice.operators.base import Context
from sluice.operators.registry import OFFICIAL, Registry, default_registry
from sluice.operators.union import Union

SCHEMA = "ord long, sample_id string, source_name string, text string, quality double"


def pool(spark, n=40, seed=0):
    r = random.Random(seed)
    rows = [(i * 3, str(i), r.choice("abc"), " ".join(r.choice("uvwxyz") for _ in range(r.randint(0, 9))), r.choice([None, 0.1, 0.5, 0.5, 0.9])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def ids(df):
    return [r.sample_id for r in df.orderBy("ord").collect()]


def model(rows, *, threshold=None, top_k=None, fraction=None, descending=True, keep=False):
    known = [r for r in rows if r[4] is not None]
    known.sort(key=lambda r: -r[4] if descending else r[4])
    if threshold is not None:
        out = [r for r in known if (r[4] >= threshold if descending else r[4] <= threshold)]
    elif top_k is not None:
        out = known[:top_k]
    elif fraction is not None:
        out = known[: math.ceil(len(known) * fraction)]
    else:
        out = known
    out = out or known[:1]
    return [r[1] for r in out] + ([r[1] for r in rows if r[4] is None] if keep else [])


@pytest.mark.parametrize(
    "p",
    [
        {"fraction": 0.07}, {"fraction": 0.5, "top_k": 3}, {"top_k": 3, "threshold": 0.5}, {"threshold": 0.5, "descending": False}, {"threshold": 7.0}, {"top_k": 0}, {}, {"fraction": 1.0, "keep_missing_scores": True},
    ],
)
@pytest.mark.parametrize("window", [1_000_000, 1])
def test_score_filter(spark, monkeypatch, p, window):
    monkeypatch.setattr(base, "WINDOW_ROWS", window)
    df, rows = pool(spark)
    want = model(rows, **{("keep" if k == "keep_missing_scores" else k): v for k, v in p.items()})
    got = score_filter.ScoreFilter(score_path="metadata.extra.quality.score", **p).apply(df)
    assert ids(got) == want and got.columns == df.columns


def test_score_filter_of_nothing(spark):
    df, _ = pool(spark)
    f = score_filter.ScoreFilter(score_path="quality", top_k=2)
    assert ids(f.apply(df.limit(0))) == [] and ids(f.apply(df.where("quality IS NULL"))) == []
    with pytest.raises(ValueError):
        score_filter.ScoreFilter(score_path="quality", top_k=-1).apply(df)
    one = df.withColumn("quality", F.lit(float("nan")))
    assert ids(score_filter.ScoreFilter(score_path="quality", keep_missing_scores=True).apply(one)) == ids(df)


def test_quality_by_rule_only_where_no_row_has_one(spark):
    df, rows = pool(spark)
    bare = df.drop("quality")
    want = sorted(rows, key=lambda r: -len(r[3]))[:5]
    assert ids(score_filter.QualityFilter(top_k=5).apply(bare)) == [r[1] for r in want]


def test_mona_union_keeps_order_and_never_is_empty(spark):
    rows = [(i, str(i), "s", {"a": float(i % 5), "b": float(-i)} if i % 3 else {"a": float(i % 5)}) for i in range(20)]
    df = spark.createDataFrame(rows, "ord long, sample_id string, source_name string, mona_scores map<string,double>")
    best = set()
    for b in "ab":
        have = sorted([r for r in rows if b in r[3]], key=lambda r: -r[3][b])
        best |= {r[1] for r in have[: math.ceil(len(have) * 0.2)]}
    assert ids(score_filter.MonaFilter(fraction=0.2, threshold=99.0).apply(df)) == [r[1] for r in rows if r[1] in best]
    assert ids(score_filter.MonaFilter(top_k=0).apply(df)) == ["0"]
    assert ids(score_filter.SparseMonaFilter(top_k=2).apply(df, Context(task_name="b"))) == ["9", "3"]  # rows without b count by their greatest score


@pytest.mark.parametrize(
    "available,weights,total,want",
    [
        ({"a": 5, "b": 1, "c": 4}, {"a": 1, "b": 1, "c": 1}, 9, {"a": 4, "b": 1, "c": 4}),
        ({"a": 2, "b": 2}, {"a": 1, "b": 1}, 99, {"a": 2, "b": 2}),
        ({"a": 9, "b": 9}, {"b": 3, "a": 1}, 6, {"b": 5, "a": 1}),
        ({"a": 9}, {"a": 2}, 0, {"a": 0}),
    ],
)
def test_quotas(available, weights, total, want):
    assert mix.quotas(available, weights, total) == want


def test_mixes(spark):
    df, rows = pool(spark, 30)
    by = {s: [r[1] for r in rows if r[2] == s] for s in "abc"}
    q = mix.quotas({s: len(v) for s, v in by.items()}, {"c": 2.0, "a": 1.0}, 12)
    assert ids(mix.SourceMix(source_weights={"c": 2, "zz": 9, "a": 1}, total_samples=12).apply(df)) == by["c"][: q["c"]] + by["a"][: q["a"]]
    assert ids(mix.SourceMix(source_weights={"zz": 1}).apply(df)) == []
    over = mix.SourceMix(source_weights={"a": 1}, total_samples=3 * len(by["a"]) + 1, allow_oversample=True).apply(df)
    assert ids(over) == by["a"] * 3 + by["a"][:1]
    one, two = (ids(mix.TruncateSamples(total_samples=10, seed=5).apply(df.repartition(k))) for k in (1, 7))
    assert one == two and len(one) == 10 and ids(mix.TruncateSamples(total_samples=10, seed=6).apply(df)) != one
    hot = df.withColumn("varentropy", F.when(F.col("source_name") == "a", 1.0).when(F.col("source_name") == "b", 900.0))
    m = mix.VarentropyMix(temperature=0.0)
    assert m.weights(hot, ["a", "b", "c"]) == {"a": math.exp(100), "b": 1e10} and m.weights(df, ["a"]) == {"a": 1.0}


def test_exact_dedup_and_union(spark):
    rows = [(1, "1", "s", "A  b"), (2, "2", "s", "a b"), (3, "3", "s", ""), (4, "4", "s", None), (5, "5", "s", "a c")]
    df = spark.createDataFrame(rows, "ord long, sample_id string, source_name string, text string")
    assert ids(dedup.SemanticDedup().apply(df)) == ["1", "3", "5"]
    ctx = Context(pool=df, outputs={"x": df.where("ord IN (2, 5)").select("ord", "sample_id")})
    assert ids(Union(source_recipe="x").apply(df.where("ord >= 4"), ctx)) == ["4", "5", "2"]
    assert ids(Union(source_recipe="x").apply(df.limit(0), ctx)) == ["2", "5"]
    u = Union()
    assert ids(u.apply(df, ctx)) == ids(df) and u.trace.notes["reason"] == "no source_recipe"


@pytest.mark.parametrize("solve", [10**6, 0])
def test_greedy(spark, solve):
    r = random.Random(4)
    edges = {tuple(sorted(r.sample(range(40), 2))) for _ in range(90)}
    kept = []
    for b in range(40):
        if not any((a, b) in edges for a in kept):
            kept.append(b)
    nodes = spark.range(40).select(F.col("id").alias("ord"))
    got = dedup.keep_greedily(nodes, spark.createDataFrame(sorted(edges), "a long, b long"), solve)
    assert sorted(x.ord for x in got.collect()) == kept
    assert dedup.keep_greedily(nodes, spark.createDataFrame([], "a long, b long"), solve).count() == 40


def test_cosine_edges_of_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(60, [0.0] * 6), (61, [1.0, 2.0]), (62, [2.0, 4.0])]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(u[i] @ u[j]), 9) >= 0.5} | {(61, 62)}
    for block in (2048, 9):
        monkeypatch.setattr(dedup, "BLOCK", block)
        got = dedup.cosine_edges(spark.createDataFrame(rows, "ord long, v array<double>"), 0.5)
        pairs = [(r.a, r.b) for r in got.collect()]
        assert set(pairs) == want and len(pairs) == len(want)


@pytest.mark.parametrize("solve", [10**6, 0])
def test_minhash(spark, solve):
    r = random.Random(2)
    words = [r.choice(["red", "green", "blue", "grey", "pink", "teal"]) + str(r.randint(0, 30)) for _ in range(400)]
    base_text = [" ".join(r.choices(words, k=60)) for _ in range(12)]
    texts = base_text + [t + " more" for t in base_text] + base_text[:3] + ["", ""]
    df = spark.createDataFrame([(i, str(i), "s", t) for i, t in enumerate(texts)], "ord long, sample_id string, source_name string, text string")
    got = ids(dedup.minhash_keep(df, 0.8, 128, 5, solve))
    assert got == [str(i) for i in range(12)] + ["27", "28"]  # texts without tokens have no band
    b, k = dedup.bands_for(0.8, 128)
    assert b * k <= 128


def test_ngram_jaccard_and_semdedup(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 30))) for _ in range(25)]
    texts += [t + " z" for t in texts[:12]]
    df = spark.createDataFrame([(i, str(i), "s", t) for i, t in enumerate(texts)], "ord long, sample_id string, source_name string, text string")

    def grams(t):
        ws = t.split()
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}

    kept = []
    for i, t in enumerate(texts):
        g = grams(t)
        if not any(len(g & grams(texts[k])) >= 0.8 * len(g | grams(texts[k])) for k in kept):
            kept.append(i)
    assert ids(dedup.ngram_jaccard_keep(df)) == [str(i) for i in kept]
    sp = "array<struct<idx:int,val:double>>"
    rows = [(0, "0", "s", [(0, 1.0)], 0), (1, "1", "s", [(0, 2.0)], 0), (2, "2", "s", [(0, 2.0)], 1), (3, "3", "s", None, None), (4, "4", "s", [(0, 1.0), (1, 1.0)], 0)]
    df = spark.createDataFrame(rows, f"ord long, sample_id string, source_name string, sparse {sp}, cluster int")
    assert ids(dedup.SemDedup(cosine_threshold=0.9, num_clusters=2).apply(df)) == ["0", "2", "3", "4"]
    assert ids(dedup.SemDedup(cosine_threshold=0.9, num_clusters=1).apply(df.drop("cluster"))) == ["0", "3", "4"]
    with pytest.raises(ValueError):
        dedup.SemDedup().apply(df)


def test_semdedup_in_rounds(spark, monkeypatch):
    """Rows are decided as by a pass in order, in one round or many, and no table of all near pairs is made."""
    r = random.Random(9)
    rows = [(i, str(i), "s", sorted({(r.randint(0, 5), float(r.randint(1, 4))) for _ in range(r.randint(1, 4))}), r.choice([0, 1, None])) for i in range(300)]

    def cos(a, b):
        size = lambda x: sum(v * v for _, v in x) ** 0.5
        return round(sum(v * w for i, v in a for j, w in b if i == j) / size(a) / size(b), 9)

    want: list = []
    for x in rows:
        if x[4] is None or not any(y[4] == x[4] and cos(x[3], y[3]) >= 0.9 for y in want):
            want.append(x)
    df = spark.createDataFrame(rows, "ord long, sample_id string, source_name string, sparse array<struct<idx:int,val:double>>, cluster int")
    listed = []
    monkeypatch.setattr(dedup, "keep_greedily", lambda *a, **k: listed.append(a))
    for most, cells in ((32_768, 4_000_000), (40, 20)):
        monkeypatch.setattr(dedup, "LEADER_ROWS", most)
        monkeypatch.setattr(dedup, "LEADER_CELLS", cells)
        got = dedup.SemDedup(cosine_threshold=0.9, num_clusters=2).apply(df)
        assert ids(got) == [x[1] for x in want] and got.columns == df.columns
    assert not listed


def test_registry():
    r = default_registry()
    assert set(OFFICIAL) <= set(r.names())
    with pytest.raises(ValueError):
        r.register("union", Union)
    with pytest.raises(KeyError):
        Registry().create("union")


@pytest.mark.parametrize("group_rows, pairs_a_row", [(64, 8), (2, 0)])
def test_ngram_jaccard_of_many_near_copies(spark, monkeypatch, group_rows, pairs_a_row):
    """Rows are decided as by a pass in order, and neither near copies nor a passage that most texts have make pairs of all texts."""
    r = random.Random(4)
    word = lambda: f"w{r.randint(0, 10**6)}"
    core, common = [word() for _ in range(60)], [word() for _ in range(7)]
    texts = ["", " \x0b ", "a b", "A  b\n", "a b c d e"] + [" ".join(common + [word() for _ in range(r.randint(1, 4))]) for _ in range(40)]
    for _ in range(80):
        t = list(core)
        for _ in range(r.randint(0, 3)):
            t[r.randrange(60)] = word()
        texts.append(" ".join(t))
    r.shuffle(texts)
    grams = [(lambda t: {tuple(t[i : i + 5]) for i in range(max(len(t) - 5, 0) + 1)} if t else set())(x.lower().split()) for x in texts]
    kept: list[int] = []
    for i, g in enumerate(grams):
        if not any(len(g & grams[k]) >= 0.8 * len(g | grams[k]) for k in kept if g and grams[k]):
            kept.append(i)
    monkeypatch.setattr(dedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(dedup, "PAIRS_A_ROW", pairs_a_row)
    tried, similar = [], dedup._similar

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return similar(pairs, *rest)

    monkeypatch.setattr(dedup, "_similar", counted)
    df = spark.createDataFrame([(i, str(i), "s", t) for i, t in enumerate(texts)], "ord long, sample_id string, source_name string, text string")
    assert ids(dedup.ngram_jaccard_keep(df)) == [str(i) for i in kept]
    assert sum(tried) < 2000 and (len(tried) > 1) == (group_rows == 2)
