import random

import numpy as np
import pytest

from sluice.llm import lines
from sluice.llm.common import read

from .helpers import ODD_TEXTS, docs, save


def brute(texts, ids, threshold=0.8):
    """Removed (doc, line) by comparing all distinct lines."""
    where = {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        for no, s in lines.lines_of(t or ""):
            where.setdefault(s, []).append((i, no))
    distinct = list(where)
    sets = [lines.shingles(s) for s in distinct]
    group = list(range(len(distinct)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(distinct)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                group[root(a)] = root(b)
    first = {}
    for k, s in enumerate(distinct):
        first[root(k)] = min(first.get(root(k), (1 << 62, 0)), min(where[s]))
    return {w for k, s in enumerate(distinct) for w in where[s] if w != first[root(k)]}


def near_texts(n, seed=5):
    r = random.Random(seed)
    base = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 60))) for _ in range(25)]
    out = []
    for _ in range(n):
        ls = []
        for _ in range(r.randint(0, 6)):
            s = r.choice(base)
            if r.random() < 0.6:
                p = r.randrange(len(s))
                s = s[:p] + r.choice(["", "xyz", "é", "q"]) + s[p + r.randint(0, 3) :]
            ls.append(r.choice(["", "  ", "\t"]) + s)
        out.append("\n".join(ls))
    return out


@pytest.mark.parametrize("tile", [2048, 4])
def test_query_against_all_pairs(spark, tmp_path, monkeypatch, tile):
    monkeypatch.setattr(lines, "TILE_LINES", tile)
    texts = [*ODD_TEXTS, *near_texts(120), *(r.text for r in read(spark, "/root/testdata/sf0.001", "documents").limit(60).collect())]
    ids = [500 - i for i in range(len(texts))]
    want = brute(texts, ids)
    got = {r.doc_id: r for r in lines.op7_fuzzy_lines(spark, save(spark, tmp_path, documents=docs(spark, texts, ids))).collect()}
    assert {i: r.n_lines for i, r in got.items()} == {i: len(lines.lines_of(t or "")) for i, t in zip(ids, texts, strict=True)}
    removed = {(i, int(x)) for i, r in got.items() for x in r.removed_lines.split(",") if x}
    assert all(r.n_removed == len([x for x in removed if x[0] == i]) for i, r in got.items())
    missed, extra = want - removed, removed - want
    assert len(want) > 200 and len(missed) <= 0.01 * len(want) and not extra


def test_without_filter_the_join_finds_the_same(spark, monkeypatch):
    d = docs(spark, near_texts(40))
    a = {tuple(r) for r in lines.removed_lines(d).collect()}
    monkeypatch.setattr(lines, "FILTER_LINES", -1)
    assert {tuple(r) for r in lines.removed_lines(d).collect()} == a and a


def test_recall_of_keys_at_the_threshold():
    r = random.Random(1)
    hit = pairs = 0
    for n in (90, 150, 165, 400):
        for _ in range(60):
            a = "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
            b = list(a)
            for _ in range(max(1, n // 90)):
                b[r.randrange(n)] = "Z"
            b = "".join(b)
            if not lines.similar(lines.shingles(a), lines.shingles(b)):
                continue
            k, o = lines.band_keys([a, b])
            pairs += 1
            hit += bool(set(k[o == 0]) & set(k[o == 1]))
    assert pairs > 60 and hit >= 0.97 * pairs


@pytest.mark.parametrize("word, few, many", [("-", 60, 120), ("Sich ", 15, 30), ("| --- ", 10, 20), ("Sich ", 20, 4000), ("abcdefghij" * 8 + " ", 1, 3)])
def test_repeated_words_on_both_sides_of_the_kinds_share_keys(spark, word, few, many):
    a, b = ((word * n).strip() for n in (few, many))
    alike = lines.similar(lines.shingles(a), lines.shingles(b))
    k, o = lines.band_keys([a, "another line", b])
    assert not alike or set(k[o == 0]) & set(k[o == 2])
    assert {(r.doc_id, r.line) for r in lines.removed_lines(docs(spark, [a, "another line", b])).collect()} == ({(2, 0)} if alike else set())


def test_kinds_follow_distinct_shingles():
    r = random.Random(3)
    for n in (1, 79, 80, 81, 100, 101, 150):
        s = "".join(r.choice("abcdefghijklmnop") for _ in range(n + 7))
        for x in (s, s + s[: n // 2] + s):
            size = len(lines.shingles(x))
            assert len(lines.band_keys([x])[0]) == lines.BANDS * ((size < lines.FULL) + (size >= lines.DIVIDED))


def test_bins_do_not_depend_on_other_lines():
    ls = near_texts(20)[0:10]
    ls = [x for t in ls for _, x in lines.lines_of(t)]
    k, o = lines.band_keys(ls)
    for i, x in enumerate(ls):
        assert np.array_equal(np.sort(k[o == i]), np.sort(lines.band_keys([x])[0]))


def test_stage(spark):
    long = "a line that is long enough to be told from others by its shingles"
    d = docs(spark, [f"{long}\n\nsecond", f"{long}!\nthird é", long, "", None], [5, 6, 7, 8, None])
    out = {r.doc_id: (r.text, r.n_chars) for r in lines.lines_stage(spark, d, "").select(*d.columns).collect()}
    assert out == {5: (f"{long}\n\nsecond", len(long) + 8), 6: ("third é", 7), 8: ("", 0), None: (None, 0)}
    assert lines.removed_lines(docs(spark, [])).count() == 0
    assert lines.lines_stage(spark, docs(spark, []), "").count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark, tmp_path):
    one, two, three = ("a line of its own that no other text has, number " + w for w in ("one", "two and more of it", "three, which is not alike at all"))
    rows = [(1, one), (5, one), (5, f"{two}\nsecond line, unlike"), (5, f"{two}\nsecond line, unlike"), (None, three), (None, f"{two}?\n{three}")]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    out = sorted((r.doc_id or 0, r.text) for r in lines.lines_stage(spark, d.repartition(3), "").collect())
    text = sum((t.split("\n") for _, t in out), [])
    # nothing is lost but what stands elsewhere; equal rows are one document and keep the same
    assert (1, one) in out and not any(i == 5 and one in t for i, t in out)
    assert all(any(lines.similar(lines.shingles(x), lines.shingles(y)) for y in text) for _, t in rows for x in t.split("\n"))
    assert len([x for x in out if x[0] == 5]) == 2 and len({x for x in out if x[0] == 5}) == 1
    got = lines.op7_fuzzy_lines(spark, save(spark, tmp_path, documents=d)).collect()
    assert len(got) == 6 and sorted((r.doc_id or 0, r.n_lines) for r in got) == [(0, 1), (0, 2), (1, 1), (5, 1), (5, 2), (5, 2)]
    assert sum(r.n_removed for r in got if r.doc_id == 5) in (1, 3)


def test_columns_of_any_name_and_type(spark):
    from pyspark.sql import functions as F

    long = "a line that is long enough to be told from others by its shingles"
    d = docs(spark, [f"{long}\nsecond", f"{long}!\nthird"], [5, 6])
    for c in ("_gone", "line_gone", "Line_Doc", "line_tie", "gone", "doc", "tie"):
        d = d.withColumn(c, F.lit(c))
    d = d.withColumn("n_chars", F.lit("many"))
    out = {r.doc_id: r for r in lines.lines_stage(spark, d, "").collect()}
    assert out[6].text == "third" and out[6].n_chars == "many" and out[6].asDict().keys() == set(d.columns)


@pytest.mark.parametrize("apart,tile", [(2, 2048), (2, 5)])
def test_large_groups_are_split_over_tasks(spark, monkeypatch, apart, tile):
    d = docs(spark, near_texts(60))
    want = {tuple(r) for r in lines.removed_lines(d).collect()}
    monkeypatch.setattr(lines, "APART_LINES", apart)
    monkeypatch.setattr(lines, "TILE_LINES", tile)
    monkeypatch.setattr(lines, "BUCKET_BYTES", 50_000)
    assert {tuple(r) for r in lines.removed_lines(d).collect()} == want and want


def test_line_dedup_drops_what_other_stages_keep_at_hand(spark):
    """Workers serve all stages of the pipeline: vocabularies of one don't stay in memory during the next."""
    from sluice.llm import lines, wordbpe

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            return f

    wordbpe.load(wordbpe.default_path())
    assert wordbpe.load.cache_info().currsize
    assert list(lines.occurrences(Docs())(iter([]))) == []
    assert not wordbpe.load.cache_info().currsize
