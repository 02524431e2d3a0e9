import random
import zlib

import numpy as np
import pytest

from sluice.llm import decontaminate as dc
from sluice.llm import toxicity as tx
from sluice.llm.common import read

from .helpers import ODD_TEXTS, docs, save

R = random.Random(11)
VOCAB = ["".join(R.choice("aeioutrsnl") for _ in range(R.randint(2, 7))) for _ in range(400)]
ITEMS = [(i, " ".join(R.choice(VOCAB) for _ in range(R.randint(12, 40))) + "? " + " ".join(R.choice(VOCAB) for _ in range(R.randint(1, 9))) + ".") for i in range(30)]


def brute_scores(index, words):
    """Share of each item's own score that the words reach, item by item."""
    out = {}
    for t in {index.terms[w] for w in words if w in index.terms}:
        for i, x in zip(index.items[t].tolist(), index.impacts[t].tolist(), strict=True):
            out[i] = out.get(i, 0) + x
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.25, 0.4, 0.9])
def test_wand_gives_all_items_above(threshold, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 3)
    index = dc.Index(ITEMS)
    assert max(map(len, index.block_most)) > 1
    for _ in range(60):
        words = R.choices(VOCAB, k=40) + dc.words_of(R.choice(ITEMS)[1])[: R.randint(0, 40)]
        want = {i: s for i, s in brute_scores(index, words).items() if s >= threshold - 1e-9}
        got = dict(index.above([index.terms[w] for w in words if w in index.terms], threshold))
        assert got == pytest.approx(want)


@pytest.mark.parametrize("bounds", [1 << 22, 50])
def test_the_first_step_loses_nothing(bounds, monkeypatch):
    monkeypatch.setattr(dc, "BOUNDS", bounds)
    monkeypatch.setattr(dc, "BLOCK", 4)
    index = dc.Index(ITEMS)
    passages = [R.choices(VOCAB, k=40) + dc.words_of(R.choice(ITEMS)[1])[: R.randint(0, 40)] for _ in range(200)]
    at = [(index.terms[w], p) for p, ws in enumerate(passages) for w in ws if w in index.terms]
    left = set(index.plausible(*(np.array(x) for x in zip(*at, strict=True))).tolist())
    for p, ws in enumerate(passages):
        assert p in left or max(brute_scores(index, ws).values(), default=0) < dc.SCORE


def test_planted_items_are_found_and_nothing_else(spark, tmp_path):
    filler = [" ".join(R.choices(VOCAB, k=R.randint(5, 400))) for _ in range(60)]
    texts, want = [], set()
    for k, f in enumerate(filler):
        ws = f.split()
        if k % 3 == 0:
            i, t = R.choice(ITEMS)
            p = R.randint(0, len(ws))
            ws[p:p] = (t.upper() if k % 2 else t).split()
            want.add((k, i))
        texts.append(" ".join(ws))
    texts += ODD_TEXTS
    items = spark.createDataFrame([*ITEMS, ITEMS[0], (90, None), (91, ""), (None, "some text")], "item_id long, text string")
    sf = save(spark, tmp_path, documents=docs(spark, texts), benchmark=items)
    got = dc.op9_bm25_decontamination(spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.overlap == 1 for r in got)
    d = docs(spark, texts)
    kept = dc.decontamination_stage(spark, d, sf)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in want}
    assert dc.contaminated(docs(spark, []), items).count() == dc.contaminated(d, items.limit(0)).count() == 0


def brute_rows(items, texts):
    """(doc, item, score, question, answer, overlap) by definition: every passage against every unit."""
    import math
    from collections import Counter

    parts = [(i, *dc.question_and_answer(t)) for i, t in sorted({(i, t) for i, t in items if i is not None and t is not None})]
    parts = [p for p in parts if p[1]]
    units = [(k, u) for k, (_, q, a) in enumerate(parts) for u in dc.units_of(q + a)]
    df = Counter(w for _, u in units for w in set(u))
    n, mean = len(units), sum(len(u) for _, u in units) / max(1, len(units))
    impacts = []
    for _, u in units:
        tf = Counter(u)
        x = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(u) / mean)) for w, f in tf.items()}
        own = sum(x.values())
        impacts.append({w: v / own for w, v in x.items()})
    out = {}
    for d, t in enumerate(texts):
        ws = dc.words_of(t or "")
        for start in range(0, max(1, len(ws) - 48), 48):
            held = set(ws[start : start + 96])
            for (k, _), x in zip(units, impacts, strict=True):
                score = sum(v for w, v in x.items() if w in held)
                if score < 0.4 - 1e-9:
                    continue
                i, q, a = parts[k]
                reach = -(-len(q + a) // 96) * 96
                near = " " + " ".join(ws[max(0, start - reach) : start + 96 + reach]) + " "
                gs = dc.grams(q + a)
                is_answer = [j + len(g) > len(q) for j, g in enumerate(gs)]
                there = [f" {' '.join(g)} " in near for g in gs]
                sides = [{g: h for g, h, s in zip(gs, there, is_answer, strict=True) if s == side} for side in (False, True)]
                share = [sum(x.values()) / len(x) if x else 1.0 for x in sides]
                if min(share) >= 0.5:
                    both = sum(sum(x.values()) for x in sides) / sum(map(len, sides))
                    out[d, k] = max(out.get((d, k), (0,)), (score, *share, both))
    return sorted((d, parts[k][0], *(round(v, 6) for v in row)) for (d, k), row in out.items())


@pytest.mark.parametrize("most,block", [(1 << 20, 2), (1200, 16)])
def test_query_equals_all_scores(spark, tmp_path, monkeypatch, most, block):
    """Whole, halved and shuffled items in texts; items longer than a passage; one index or many parts, the same rows."""
    monkeypatch.setattr(dc, "BLOCK", block)
    r = random.Random(most)
    items = [*ITEMS, (50, " ".join(r.choices(VOCAB, k=230)) + ". " + " ".join(r.choices(VOCAB, k=20))), (51, "one two"), (52, ITEMS[3][1]), (53, None), (54, "")]
    texts = list(ODD_TEXTS)
    for _ in range(50):
        ws = r.choices(VOCAB, k=r.randint(0, 300))
        words = r.choice(items[:32])[1].split()
        cut = r.choice([words, words[: len(words) // 2], words[: -len(words) // 4], words[3:], r.sample(words, len(words))])
        p = r.randint(0, len(ws))
        texts.append(" ".join(ws[:p] + cut + ws[p:]))
    q, a = dc.question_and_answer(ITEMS[5][1])
    texts += [" ".join(q), " ".join(q + ["other"] * len(a)), "one two"]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(docs(spark, texts), table, most).collect()
    rows = sorted((x.doc_id, x.item_id, *(round(v, 6) for v in x[2:])) for x in got)
    want = brute_rows(items, texts)
    assert len(want) > 15 and [x[:2] for x in rows] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in rows], [x[2:] for x in want], atol=2e-6)


def test_question_and_answer():
    assert dc.question_and_answer("What is it?\nA thing. It is a pear.") == (["what", "is", "it", "a", "thing"], ["it", "is", "a", "pear"])
    assert dc.question_and_answer("only one") == (["only", "one"], []) and dc.question_and_answer(" .") == ([], [])


def brute_segments(scores):
    """All maximal segments by taking the best, then going on left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return [(s, a, b) for s, a, b in brute_segments(scores[:i])] + [(best, i, j)] + [(s, a + j, b + j) for s, a, b in brute_segments(scores[j:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments(seed):
    scores = np.random.default_rng(seed).normal(-0.2, 1, 40)
    got = tx.segments(scores)
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in brute_segments(scores.tolist())]
    assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in brute_segments(scores.tolist())])


def test_decay_solves_the_score_equation():
    score, share = np.array([3.0, -0.5, -1.0]), np.array([0.02, 0.5, 0.48])
    x = tx.decay_of(score, share)
    assert x > 0 and (share * np.exp(x * score)).sum() == pytest.approx(1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in tx.op5_toxic_segments(spark, sf).collect()}
    assert len(got) == read(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    rows = [(got[r.doc_id].score, r.toxic) for r in read(spark, sf, "labels").collect() if got[r.doc_id].held_out]
    up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in up for b in down]) > 0.95


def test_odd_texts_and_no_labels(spark, tmp_path):
    d = docs(spark, [*ODD_TEXTS, "you worthless idiot"])
    labels = spark.createDataFrame([(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    sf = save(spark, tmp_path, documents=d, labels=labels)
    assert all(r.score < 0.3 for r in tx.op5_toxic_segments(spark, sf).collect())
    model = tx.Model({"idiot": 4.0, "worthless": 4.0}, decay=1.0, size=0.1, curve=(-1.0, 1.0, 0.5))
    got = tx.score(d, model).collect()
    assert [r.n_passages for r in got] == [0] * len(ODD_TEXTS) + [1]
    assert model.passages("oh you worthless idiot there")[0][:2] == (2, 4)
