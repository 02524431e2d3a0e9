import math
from collections import Counter

import duckdb
import pytest
import sentencepiece

from sluice.llm import chat, quality

from .helpers import ODD_TEXTS, docs, save

TURNS = "conv_id long, turn long, role string, text string, pair_id int"
ROWS = [
    (0, 1, "assistant", "hi"), (0, 0, "user", "hello"), (0, 2, "user", "more"),
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "other"), (1, 3, "assistant", "x" * 100_000),
    (2, 0, "user", None), (2, 1, None, "é漢"), (3, 0, "user", ""), (3, 1, None, "é漢"),
    (4, None, "user", "alone"), (4, None, "user", "alone"),
    (6, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "user", "nobody"),
]


def test_pairs(spark, tmp_path):
    sf = save(spark, tmp_path, conversations=spark.createDataFrame([(*r, 1) for r in ROWS], TURNS))
    got = {r.pair_id: r for r in chat.op4_preference_pairs(spark, sf).collect()}
    assert {k: r.n_common for k, r in got.items()} == {0: 2, 1: 2, 2: 0, 3: 1}
    assert got[0].prompt == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
    assert got[0].chosen == "<|im_start|>user\nmore<|im_end|>\n" and got[0].chosen_mask == "17:0,14:0,1:0"
    assert got[0].rejected_mask.endswith("100010:1,1:0")
    assert (got[2].rejected, got[2].chosen.count("alone")) == ("", 2)
    assert (got[3].chosen, got[3].rejected) == ("", "")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = duck.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    rows = sorted(cur.fetchall())
    assert rows == sorted(tuple(r[n] for n in names) for r in got.values())


def test_explicit_pairs_and_nothing(spark):
    turns = spark.createDataFrame([(*r, 1) for r in ROWS], TURNS)
    pairs = spark.createDataFrame([(1, 0, 1, 9), (1, 0, 1, 9), (2, 0, 99, 9), (3, None, 1, 9)], "pair_id int, chosen_id long, rejected_id long, extra int")
    got = chat.format_preferences(turns, pairs).collect()
    assert sorted((r.pair_id, r.n_common, len(r.rejected_segments)) for r in got) == [(1, 2, 6), (1, 2, 6), (2, 0, 0), (3, 0, 12)]
    assert chat.format_preferences(turns.limit(0), chat.adjacent_pairs(turns.limit(0))).count() == 0


def brute(text):
    ws = quality.WORD.findall(text)
    often = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    held = {j for i in range(len(ws) - 4) if often[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if quality.WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(held)


def test_counts_and_verdict(spark, tmp_path):
    texts = [*ODD_TEXTS, "a b c d e\nx\n\n x \nx\na b c d e f\n##$ |<>", "a b c d e a b c d e", "1 2 3 4 1 2 3 4 1 2 3 4 1", "a\r\nb \r c\r", "\n\ta\u3000 \xa0b  c\x85 \u2028d ﬁ\n", " lead  and trail \n ", "plain words of a rather ordinary kind that no rule has anything against"]
    sf = save(spark, tmp_path, documents=docs(spark, texts))
    got = {r.doc_id: r for r in quality.op3_fertility_rules(spark, sf).collect()}
    paths = quality.default_paths()
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    many, english = (quality.byte_level(p) for p in paths[1:])
    for i, t in enumerate(texts):
        n = brute(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)
        ids = sp.encode(t or "")
        entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values()) if ids else 0
        assert r.n_tokens == len(ids) and r.token_entropy == pytest.approx(entropy, abs=1e-9)
        n_bytes = sum(sp.IsByte(k) and sp.IdToPiece(k) not in ("<0x09>", "<0x0A>", "<0x0D>") for k in ids)
        m, e = many(t or ""), english(t or "")
        assert r.byte_share == pytest.approx(n_bytes / max(1, len(ids))) and r.chars_per_token == pytest.approx(len(t or "") / max(1, len(ids)))
        assert r.single_share == pytest.approx(sum(k < 256 for k in m) / max(1, len(m))) and r.english_ratio == pytest.approx(len(m) / max(1, len(e)))
        b = quality.BANDS[r.band]
        why = quality.outside(b, len(ids), len(t or ""), n_bytes, entropy, len(m), sum(k < 256 for k in m), len(e))
        assert r.rejected_by == ",".join(why) and r.kept == (not r.base_failed and not why)
    assert got[len(texts) - 1].kept


def test_windows_are_compared_word_by_word(monkeypatch):
    words = [["a", "b", "c", "d", "e"] * 3, ["a"] * 4, [], list("abcdefgabcdefh")]
    assert quality.repeat_words(words).tolist() == [15, 0, 0, 12]


def test_stage(spark):
    d = docs(spark, ["few words", "plain words of a rather ordinary kind that no rule has anything against", None])
    out = quality.quality_stage(spark, d, "")
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [1]
    assert quality.fertility(docs(spark, []).drop("lang"), quality.default_paths()).count() == 0


ENGLISH = "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. "
GERMAN = "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. "
RUSSIAN = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства."
GREEK = "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση."
JAPANESE = "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。"


def test_scripts_and_bands():
    import random

    r = random.Random(0)
    soup = lambda letters, n=300: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n))
    long_german = " ".join(GERMAN.split() + [w for i in range(6) for w in sorted(GERMAN.split(), key=lambda w: w[i % len(w) :])])
    cases = [
        (ENGLISH, "en", "en", ""), (GERMAN, "de", "de", ""), (RUSSIAN, None, "Cyrillic", ""), (GREEK, None, "Greek", ""), (JAPANESE, None, "Kana", ""),
        (RUSSIAN, "en", "Cyrillic", ""), (ENGLISH, "xx", "Latin", ""), ("12 34", None, "Other", ""),
        (soup("abcdefghijklmnopqrstuvwxyz"), "en", "en", "few_chars"), (soup("abcdefghijklmnopqrstuvwxyz"), None, "Latin", "singles"),
        (soup("абвгдежзийклмнопрстуфхцчшщъыьэюя"), None, "Cyrillic", "few_chars"), ("".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(200)), None, "Han", "bytes"),
        (long_german, "en", "en", "not_english"), (ENGLISH + " ".join(sorted(ENGLISH.split() * 3, key=lambda w: w[::-1])), "de", "de", "english"), ("word " * 300, "en", "en", "entropy"),
    ]
    got = quality.measure([c[0] for c in cases], [c[1] for c in cases], quality.default_paths())
    assert got["band"] == [c[2] for c in cases]
    for (text, _, _, why), have in zip(cases, got["rejected_by"], strict=True):
        assert (why in have.split(",")) if why else not have, (text[:40], have)


def test_bands_reject_junk_and_keep_prose(spark):
    """On labelled documents of the fixture that pass the base rule."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    got = quality.measure([r.text for r in rows], [r.lang for r in rows], quality.default_paths())
    kept = {q: [k for r, k, b in zip(rows, got["kept"], got["base_failed"], strict=True) if r.quality == q and not b] for q in (0, 1)}
    assert sum(kept[1]) >= 0.99 * len(kept[1]) and sum(kept[0]) <= 0.5 * len(kept[0]) and len(kept[0]) > 10
