import numpy as np
import pytest
import xxhash

from sluice.llm import simhash
from sluice.llm.common import read
from sluice.llm.components import components

from .helpers import ODD_TEXTS, docs, save


def brute_fingerprint(text):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x20\x09-\x0d]+", text)
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    left = {}
    for i in sorted(ids):
        if i in left:
            continue
        left[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in left and (fps[x] ^ fps[y]).bit_count() <= radius:
                    left[y] = i
                    todo.append(y)
    return left


def test_fingerprints():
    for t in [*ODD_TEXTS, "a b", "a b c", "A b C d"]:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    texts = [*ODD_TEXTS, *(r.text for r in read(spark, "/root/testdata/sf0.001", "documents").collect())]
    texts += [t + " end" for t in texts[20:60]]
    ids = [1000 - i for i in range(len(texts))]
    sf = save(spark, tmp_path, documents=docs(spark, texts, ids))
    fps = {i: brute_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    want = brute_components(ids, fps)
    for points in (10_000, 16):
        monkeypatch.setattr(simhash, "SHARD_POINTS", points)
        monkeypatch.setattr(simhash, "TILE_POINTS", points)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash_vptree(spark, sf).collect()}
        assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_near_links_equal_all_pairs(seed):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, k).astype(np.uint64), initial=np.uint64(0)) for k in r.integers(0, 6, 3000)]
    points = np.unique(np.concatenate([r.integers(0, 1 << 63, 1500, dtype=np.uint64), r.choice(centres, 3000) ^ np.array(flips, np.uint64)]))
    root = simhash.near_links(points)
    want = brute_components(range(len(points)), [int(x) for x in points])
    assert [want[i] for i in range(len(points))] == root.tolist()


def test_a_dense_cluster_of_points():
    base = np.uint64(0x123456789ABCDEF)
    points = np.unique([base ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(64) for j in range(64)])
    assert (simhash.near_links(points) == 0).all()


def test_stage_keeps_one_of_each_group_and_all_columns(spark):
    d = docs(spark, ["a b c d e f", "a b c d e f", "quite another text of words", None, ""], [4, 2, 9, 7, 5])
    out = simhash.simhash_stage(spark, d, "")
    assert out.columns == d.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 5, 9]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    from pyspark.sql import functions as F

    a, b, c = "a b c d e f", "quite another text of words", "and a third text that is like none of them"
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (None, c), (None, c), (3, c), (None, a)]
    d = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    for x in ("near_doc", "near_tie", "doc", "tie", "fp", "least", "part"):
        d = d.withColumn(x, F.lit(x))
    out = simhash.simhash_stage(spark, d.repartition(3), "")
    assert out.columns == d.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, a), (5, b), (0, c)])
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(d).collect()}
    assert got == {(1, 1), (5, 1), (5, 5), (7, 5), (3, 3), (None, None)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (6, 7), (7, 8), (8, 9), (9, 9), (2, 1), (100, 100), *((50 + i, 51 + i) for i in range(30))]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3), 1), **dict.fromkeys(range(4, 10), 4), **dict.fromkeys(range(50, 81), 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
