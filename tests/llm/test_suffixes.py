import hashlib
import random

import numpy as np
import pytest

from sluice.llm import suffixes as sx
from sluice.llm.common import read

from .helpers import ODD_TEXTS, docs, save


def brute(texts, ids, length=100):
    """(n_bytes, n_removed, n_spans, sha) of each document by going through all strings in order."""
    seen, out = set(), {}
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def near(n, seed=3):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdefgh \né") for _ in range(r.randint(50, 900))) for _ in range(12)]
    line = "This very common line of some forty bytes.\n"
    passage = "".join(r.choice("xyz ") for _ in range(260))
    out = []
    for _ in range(n):
        t = "".join(r.choice(base) for _ in range(r.randint(1, 3)))
        for _ in range(r.randint(0, 4)):
            p = r.randrange(len(t))
            t = t[:p] + r.choice(["", "Q", line, passage, passage[20:140]]) + t[p + r.randint(0, 5) :]
        out.append(t)
    return out


def check(spark, folder, texts, ids):
    sf = save(spark, folder, documents=docs(spark, texts, ids).repartition(3))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sx.op2_suffix_dedup(spark, sf).collect()}
    want = brute(texts, ids)
    assert {i: got[i] for i in ids if got[i] != want[i]} == {} and len(got) == len(ids)


@pytest.mark.parametrize("step,hot", [(3 << 20, 4096), (3000, 4096), (3000, 2)])
def test_query_equals_all_strings(spark, tmp_path, monkeypatch, step, hot):
    monkeypatch.setattr(sx, "STEP", step)
    monkeypatch.setattr(sx, "RUN", 4 * step)
    monkeypatch.setattr(sx, "HOT_STRETCHES", hot)
    texts = [*ODD_TEXTS, "a" * 400, "ab" * 150, "a" * 99, "b" * 100, "b" * 100, "c" * 101, *near(60)]
    check(spark, tmp_path, texts, [len(texts) - i for i in range(len(texts))])


def test_query_on_documents(spark, tmp_path):
    rows = read(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 500").collect()
    check(spark, tmp_path, [r.text for r in rows], [r.doc_id for r in rows])


def test_nothing_and_repeated_rows(spark):
    assert sx.dedup(docs(spark, [])).count() == 0
    t = near(1)[0] + "z" * 120
    rows = sx.dedup(docs(spark, [t, t, t, None], [4, 4, None, 9])).collect()
    own = brute([t], [0])[0]
    assert [(r.n_bytes, r.n_removed) for r in rows if r.doc_id is None] == [own[:2]]
    assert len(rows) == 4 and all(bytes(r.kept) == b"" for r in rows if r.doc_id is not None)


@pytest.mark.parametrize("other", [5, None])
def test_rows_that_share_an_id_are_documents_of_their_own(spark, other):
    """In the order of their hashes, equal rows together; no text is lost."""
    a, b, c = near(3, seed=8)
    b = "".join(x for x in b if x not in "abc") + "q" * 150
    ids = [1, other, other, other, other]
    texts = [a, a, b, b, c]
    rows = sx.dedup(docs(spark, texts, ids).repartition(3)).collect()
    rank = lambda i, t: (-1 if i is None else i, sx.xxhash.xxh3_64_intdigest(t.encode()))
    order = sorted({rank(i, t): t for i, t in zip(ids, texts, strict=True)}.items())
    want = brute([t for _, t in order], list(range(len(order))))
    want = sorted((i, *want[[k for k, _ in order].index(rank(i, t))]) for i, t in zip([-1 if i is None else i for i in ids], texts, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows) == want
    first = next(r for r in rows if r.doc_id == other and r.n_bytes == len(b.encode()))
    assert first.n_removed < len(b.encode())


def test_long_texts_are_cut_into_windows(monkeypatch):
    raw = [b"x" * 5, b"", bytes(range(256)) * 40, b"y" * 300]
    parts = list(sx.windows(raw, 1000))
    strings = {(i, at + s, w[s : s + 100]) for p in parts for i, at, w in p for s in range(len(w) - 99)}
    assert strings == {(i, s, x[s : s + 100]) for i, x in enumerate(raw) for s in range(len(x) - 99)}
    assert max(sum(len(w) for _, _, w in p) for p in parts) < 1100


def test_the_sort_tells_unlike_suffixes_apart(spark, monkeypatch):
    """Suffixes come to the sort unfiltered: most classes of texts that share a word group are single suffixes."""
    met = []
    own = sx.sorted_classes
    monkeypatch.setattr(sx, "sorted_classes", lambda text, at: met.append(own(text, at)) or met[-1])
    shared = b"twenty-four bytes, shared" * 2
    r = random.Random(5)
    texts = [bytes(r.randrange(97, 123) for _ in range(90)) + shared + bytes(r.randrange(97, 123) for _ in range(90)) for _ in range(9)]
    rows = list(sx.find(iter([sx.pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": [t.decode() for t in texts]})]), 1))
    settled = [x for b in sx.settle(iter(rows), 1) for x in b.to_pylist()]
    wanted = [x for x in settled if x["kind"] == sx.STRETCH]
    packed = [x for b in sx.text_rows(iter([sx.pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": [t.decode() for t in texts]})]), 1) for x in b.to_pylist()]
    contexts = list(sx.fetch(iter([sx.batch([(x["bucket"], x["kind"], x["payload"]) for x in wanted + packed])]), 1, np.zeros(0, np.uint64)))
    list(sx.repeats(iter(contexts), 1))
    order, new = met[-1]
    assert len(order) > 100 and new.sum() == len(order)


@pytest.mark.parametrize("seed", range(6))
def test_sorted_classes(seed):
    r = np.random.default_rng(seed)
    parts = [r.integers(97, 100, r.integers(100, 400), dtype=np.uint8).tobytes() for _ in range(6)]
    text = b"".join(parts[i] for i in r.integers(0, 6, 30))
    at = r.permutation(len(text) - sx.LENGTH)[:2000]
    order, new = sx.sorted_classes(text, at)
    flat = [text[p : p + sx.LENGTH] for p in at[order].tolist()]
    assert flat == sorted(flat) and sorted(order.tolist()) == list(range(len(at)))
    assert new.tolist() == [not i or flat[i] != flat[i - 1] for i in range(len(flat))]


def test_equal_strings_have_equal_anchors():
    r = random.Random(0)
    common = bytes(r.randrange(256) for _ in range(300))
    a, b = b"left side " * 3 + common + b"end", b"another left side" + common + b"other end, longer"
    sets = []
    for t in (a, b):
        text = np.frombuffer(t, np.uint8)
        gram, first, last = sx.anchors(text, np.zeros(len(t), np.int64))
        sets.append({(t[s : s + 100], int(g)) for g, f, e in zip(gram, first, last, strict=True) for s in range(f, e + 1)})
    strings = {common[i : i + 100] for i in range(201)}
    assert {x for x in sets[0] if x[0] in strings} == {x for x in sets[1] if x[0] in strings} and len(sets[0] & sets[1]) == 201
