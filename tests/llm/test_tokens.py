import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import bpe, lexicon, rans, wordbpe
from sluice.llm.common import read, shared_path

from .helpers import ODD_TEXTS, docs, save

PATH = wordbpe.default_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_and_merges_equal_the_library(text):
    t, own = Tokenizer.from_file(PATH), wordbpe.load(PATH)
    ids = [i for w in wordbpe.words(text) for i in own.encode_word(w)]
    assert ids == ids_of(t, text)
    assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=60), st.lists(st.binary(max_size=7), max_size=40))
def test_lexicon_holds_its_words_only(tmp_path_factory, held, asked):
    file = str(tmp_path_factory.mktemp("lex") / "lexicon")
    entries = {w: [len(w), *w] for w in held}
    lexicon.write(file, entries)
    lex = lexicon.Lexicon(file)
    words = [*held, *asked]
    for w, s in zip(words, lex.slots(words).tolist(), strict=True):
        assert (lex.ids(s) if s >= 0 else None) == entries.get(w)


def test_lexicon_shares_suffixes():
    states, _, _ = lexicon.automaton(sorted([b"walking", b"talking", b"stalking", b"walked", b"talked"]))
    assert len(states) == 14  # a trie of them has 28


def test_bpe_query_equals_the_library(spark, tmp_path, library):
    texts = [*ODD_TEXTS, *(r.text for r in read(spark, "/root/testdata/sf0.001", "documents").limit(60).collect())]
    sf = save(spark, tmp_path, documents=docs(spark, texts))
    got = {r.doc_id: r for r in bpe.op1_bpe_transducer(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        ids = ids_of(library, t)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_encode_then_decode(spark, library):
    d = docs(spark, ODD_TEXTS)
    for name in (None, bpe.build_lexicon(d, PATH, most=3)):
        coded = bpe.encode(d, PATH, name)
        assert {"extra", "lang", "n_tokens", "ids"} <= set(coded.columns) and "text" not in coded.columns
        back = {r.doc_id: r.text for r in bpe.decode(coded, PATH).collect()}
        assert back == {i: library.decode(ids_of(library, t), skip_special_tokens=False) for i, t in enumerate(ODD_TEXTS)}
    assert bpe.encode(docs(spark, []), PATH).count() == 0


@pytest.mark.parametrize("run", [300_000, 3])
def test_word_counts_do_not_depend_on_partitions(spark, monkeypatch, run):
    monkeypatch.setattr(bpe, "COUNT_RUN", run)
    texts = [f"common word{i} and word{i % 3}" for i in range(8)] + [None]
    want = Counter(w for t in texts for w in wordbpe.words(t or ""))
    for n in (1, 9):
        d = docs(spark, texts).repartition(n)
        assert {r.word: r.n for r in bpe.word_counts(d).collect()} == want
        for most in (1, 4, 100):
            assert [tuple(r) for r in bpe.most_frequent(bpe.word_counts(d), most)] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:most]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 3000), st.integers(0, 9))
def test_blocks_round_trip(n, kinds, seed):
    ids = np.random.default_rng(seed).integers(0, kinds, n).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids, minlength=kinds))
    assert (rans.decode_block(rans.encode_block(ids, table), table) == ids).all()


def test_a_block_is_decoded_from_its_checkpoints_and_damage_shows():
    ids = np.random.default_rng(3).integers(0, 500, 700_000).astype(np.uint32)
    table = rans.Table.scaled(np.bincount(ids))
    data = rans.encode_block(ids, table)
    step = rans.CHECK_STEPS * rans.LANES
    assert (rans.decode_block(data, table, 1, 2) == ids[step : 2 * step]).all()
    assert (rans.decode_block(data, table, 2) == ids[2 * step :]).all()
    broken = bytearray(data)
    broken[-9] ^= 1
    with pytest.raises(OSError):
        rans.decode_block(bytes(broken), table)


def test_ids_files_equal_the_library(spark, tmp_path, library, monkeypatch):
    texts = [*ODD_TEXTS, *(r.text for r in read(spark, "/root/testdata/sf0.001", "documents").limit(80).collect())]
    order = [*range(len(texts))][::-1]
    sf = save(spark, tmp_path, documents=docs(spark, [texts[i] for i in order], order).repartition(3))
    monkeypatch.setattr(rans, "SHARD_BYTES", 30_000)
    got = {r.doc_id: r for r in rans.op6_rans_ids(spark, sf).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*ids_of(library, t), 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_ids_files_of_ties_and_nothing(spark):
    out = shared_path(spark, "rans")
    rans.write_ids(spark, docs(spark, ["b", "a", "b", None], [5, 5, 5, None]), out, PATH)
    rows = sorted(rans.read_ids(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 5, 5, 5] and [r.n_tokens for r in rows] == [1, 2, 2, 2]
    assert rows[2].ids == rows[3].ids != rows[1].ids
    out = shared_path(spark, "rans")
    rans.write_ids(spark, docs(spark, []), out, PATH)
    assert rans.read_ids(spark, out).count() == 0


def test_shards_follow_weight_wherever_the_keys_are(spark):
    from pyspark.sql import functions as F

    from sluice.llm.common import range_shards

    def cut(keys, parts=3):
        df = spark.createDataFrame([(k, f"text {i}", 100) for i, k in enumerate(keys)], "k long, text string, w long").repartition(parts)
        tie = F.xxhash64("text")
        shards = range_shards(df, "k", F.col("w"), 5000, tie)
        rows = df.select(F.coalesce("k", F.lit(-(1 << 63))).alias("k"), tie.alias("t")).collect()
        of = shards.of(np.array([r.k for r in rows], np.int64), np.array([r.t for r in rows], np.int64))
        placed = sorted(zip([(r.k, r.t) for r in rows], of.tolist(), strict=True))
        assert [s for _, s in placed] == sorted(s for _, s in placed)  # shards are ranges of (key, tie)
        return shards, np.bincount(of, minlength=shards.n)

    plain, sizes = cut(range(1000))
    assert plain.n >= 20 and sizes.max() <= 50
    far, sizes = cut([*range(1000), 1 << 60, -(1 << 62)], 5)
    assert far.n >= plain.n and sizes.max() <= 50 and far.keys.tolist() == cut([-(1 << 62), *range(1000), 1 << 60], 1)[0].keys.tolist()
    hot, sizes = cut([None] * 500 + [7] * 400 + [*range(100)])
    assert hot.n >= 20 and sizes.max() <= 50
    assert cut([])[0].n == cut([3])[0].n == 1


@pytest.mark.parametrize("block", [1 << 20, 5000])
def test_spans_are_read_from_checkpoints(spark, monkeypatch, block):
    monkeypatch.setattr(rans, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(rans, "BLOCK", block)
    monkeypatch.setattr(rans, "CHECK_STEPS", 4)
    d = read(spark, "/root/testdata/sf0.001", "documents")
    out = shared_path(spark, "rans")
    rans.write_ids(spark, d, out, PATH)
    whole = [i for r in sorted(rans.read_ids(spark, out).collect(), key=lambda r: r.start) for i in r.ids]
    for start, n in ((0, 10), (1234, 20_000), (len(whole) - 5, 100), (7, 0)):
        got = sorted(rans.read_span(spark, out, start, n).collect(), key=lambda r: r.start)
        assert [i for r in got for i in r.ids] == whole[start : start + n]
    table = rans.Table.scaled(np.bincount([1, 2, 3]))
    ids = np.random.default_rng(1).integers(1, 4, 60_000)
    data = rans.encode_file(np.array([1]), np.array([60_000]), ids, table)
    for begin, end in ((0, 60_000), (4_999, 5_001), (33_000, 33_001), (59_000, 60_000), (5, 5)):
        assert (rans.decode_part(data, table, begin, end) == ids[begin:end]).all()
