"""Quality rules by tokeniser fertility.

Three public vocabularies measure each whole text: a sentencepiece vocabulary with byte fallback (characters per
token, byte-fallback share, token entropy), a byte-level one for many languages (share of tokens of a single byte),
and an English byte-level one: what it needs against the one for many languages tells English text from other.
Rejection bands are held per language, or per script where the language is unknown.  Counts of words, symbols,
repeated lines and repeated 5-word windows make the base rule.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import at_hand, read, steps, texts_of, trim

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


class Band(NamedTuple):
    """What a text of very many tokens may have; shorter texts get SLACK / sqrt(tokens) more room."""

    least_chars: float  # characters per piece
    most_chars: float
    most_bytes: float  # share of byte-fallback pieces
    most_singles: float  # share of single-byte tokens
    least_entropy: float  # bits per piece, as a share of those of all-different pieces, 9 at most
    least_english: float = 0.0  # tokens of the vocabulary for many languages to tokens of the English one
    most_english: float = 9.0


SLACK = Band(6.0, 10.0, 1.0, 1.5, 0.0, 0.3, 0.6)
#: Texts of fewer pieces aren't asked for their language.
LANGUAGE_TOKENS = 100
#: Clean prose of the fixtures (labelled good, base rule passed, 500 pieces or more; quantiles 0.005 and 0.995) has
#: characters per piece en 2.51-2.73, de 2.53-2.71, fr 2.24-2.45, es 2.19-2.40, byte share up to 0.02, single bytes up to
#: en 0.18, de 0.15, fr 0.15, es 0.14, entropy from en 0.71, de 0.70, fr 0.69, es 0.69 of the most, tokens against English
#: ones en 0.99-1.03, de 0.86-0.91, fr 0.89-0.95, es 0.84-0.88.  Natural prose takes up to 5 characters per piece.
#: For other scripts a sentence of clean prose has, in characters per piece: Cyrillic 2.6, Greek 1.0, Arabic 1.1, Hebrew
#: 1.0, Devanagari 0.9, Thai 1.0, Han 1.0, Kana 0.9, Hangul 1.0; single bytes up to 0.2; byte share up to 0.1.
BANDS = {
    "en": Band(2.25, 8.0, 0.05, 0.22, 0.66, 0.96),
    "de": Band(2.30, 8.0, 0.05, 0.20, 0.66, 0.0, 0.94),
    "fr": Band(2.05, 8.0, 0.05, 0.20, 0.66, 0.0, 0.96),
    "es": Band(2.00, 8.0, 0.05, 0.20, 0.66, 0.0, 0.92),
    "Latin": Band(1.95, 8.0, 0.10, 0.25, 0.66),
    "Cyrillic": Band(1.70, 6.0, 0.10, 0.20, 0.60),
    "Greek": Band(0.80, 4.0, 0.10, 0.20, 0.45),
    "Arabic": Band(0.80, 4.0, 0.10, 0.20, 0.45),
    "Hebrew": Band(0.80, 4.0, 0.10, 0.25, 0.45),
    "Devanagari": Band(0.60, 4.0, 0.25, 0.40, 0.45),
    "Thai": Band(0.60, 4.0, 0.25, 0.40, 0.45),
    "Han": Band(0.60, 3.0, 0.30, 0.40, 0.60),
    "Kana": Band(0.60, 3.0, 0.30, 0.30, 0.55),
    "Hangul": Band(0.60, 4.0, 0.30, 0.30, 0.55),
    "Other": Band(0.25, 8.0, 1.00, 1.00, 0.30),
}
#: Letters of each script (fixed ranges of Unicode blocks).
SCRIPTS = {
    "Latin": re.compile("[A-Za-z\u00c0-\u024f]"),
    "Cyrillic": re.compile("[\u0400-\u052f]"),
    "Greek": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"),
    "Arabic": re.compile("[\u0600-\u06ff]"),
    "Hebrew": re.compile("[\u0590-\u05ff]"),
    "Devanagari": re.compile("[\u0900-\u097f]"),
    "Thai": re.compile("[\u0e00-\u0e7f]"),
    "Han": re.compile("[\u3400-\u4dbf\u4e00-\u9fff]"),
    "Kana": re.compile("[\u3040-\u30ff]"),
    "Hangul": re.compile("[\uac00-\ud7af\u1100-\u11ff]"),
}
#: Script of the languages that have a band; a text in another script is of another language.
LATIN_LANGUAGES = ("en", "de", "fr", "es")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, band string, single_share double, english_ratio double, rejected_by string"
)

#: White space (fixed: Unicode's White_Space); texts are cut before it, where no token of the vocabularies goes across.
_BLANK = "\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
#: Segments that a worker remembers.
MEMO_SEGMENTS = 400_000


class Fertility:
    """Token counts of whole texts, put together from those of their segments.

    No token holds white space after other characters, but for pieces with a carriage return; texts with one, and texts
    with a segment whose first piece can't be told from the space that sentencepiece puts before it, are encoded whole.
    """

    def __init__(self, pieces: str, many: str, english: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        breaks = {"<0x09>", "<0x0A>", "<0x0D>"}  # line ends and tabs have byte pieces only, which says nothing of a text
        n = self.sp.GetPieceSize()
        self.is_byte = np.array([self.sp.IsByte(i) and self.sp.IdToPiece(i) not in breaks for i in range(n)])
        self.blank = self.sp.PieceToId("\u2581")
        self.many, self.english = byte_level(many), byte_level(english)
        self.forget()

    def forget(self) -> None:
        self.code: defaultdict[str, int] = defaultdict(count().__next__)
        self.pieces, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n = np.zeros((0, 4), np.int64)  # tokens for many languages, single bytes, English tokens, whether odd

    def segments(self, new: list[str]) -> Iterator[tuple[list[int], int]]:
        """Pieces of each segment, and whether they can't be told."""
        for s, ids in zip(new, self.sp.EncodeAsIds([s[1:] if s[0] == " " else s for s in new]), strict=True):
            if s == " ":
                yield [self.blank], 0
            elif s[0] == " ":
                yield ids, 0
            else:
                yield (ids[1:], 0) if ids[:1] == [self.blank] else ([], 1)

    def learn(self) -> None:
        new = list(self.code)[len(self.n) :]
        if not new:
            return
        ids, odd = zip(*self.segments(new), strict=True)
        self.pieces = np.concatenate([self.pieces, np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids])])
        many, english = map(self.many, new), map(self.english, new)
        rows = [(len(m), sum([i < SINGLES for i in m]), len(e), o) for m, e, o in zip(many, english, odd, strict=True)]
        self.n = np.concatenate([self.n, np.array(rows, np.int64)])

    def measure(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Per text: pieces, byte pieces, bits per piece, tokens for many languages, of them single bytes, English tokens."""
        if len(self.code) > MEMO_SEGMENTS:
            self.forget()
        code, split = self.code, [_SEGMENT.findall(t) for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        at = np.fromiter((code[s] for x in split for s in x), np.int64, int(sizes.sum()))
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        led = at.copy()  # sentencepiece puts a space before a text
        led[first] = [code[" " + x[0]] for x in split if x]
        self.learn()
        doc = np.repeat(np.arange(len(texts)), sizes)
        total = lambda v: np.bincount(doc, v, minlength=len(texts)).astype(np.int64)
        n_many, singles, n_english = (total(self.n[at, k]) for k in range(3))
        whole = total(self.n[led, 3]) > 0
        n, n_bytes, bits = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        starts = np.append(np.cumsum(sizes) - sizes, len(led))
        for i, t in enumerate(texts):
            if "\r" in t or whole[i]:
                ids = np.asarray(self.sp.EncodeAsIds(t), np.int64)
                many = self.many(t)
                n_many[i], singles[i], n_english[i] = len(many), sum(i < SINGLES for i in many), len(self.english(t))
            else:
                own = led[starts[i] : starts[i + 1]]
                size = self.ends[own + 1] - self.ends[own]
                ids = self.pieces[np.repeat(self.ends[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            n[i] = len(ids)
            if len(ids):
                often = np.bincount(ids)
                n_bytes[i] = int(often[self.is_byte[: len(often)]].sum())
                often = often[often > 0]
                bits[i] = np.log2(len(ids)) - (often * np.log2(often)).sum() / len(ids)
        return n, n_bytes, bits, n_many, singles, n_english


#: Rank files give single bytes the first ranks, in an order of their own.
SINGLES = 256


def byte_level(path: str) -> Callable[[str], list[int]]:
    """A rank file as an encoder of ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any((len(t) == 1) != (r < SINGLES) for t, r in ranks.items()):
        raise ValueError(f"{path}: single bytes don't come first")
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@at_hand
@functools.lru_cache(maxsize=1)
def _fertility(paths: tuple[str, str, str]) -> Fertility:
    return Fertility(*paths)


def script(text: str) -> str:
    """The script of most letters; Other for none.  Japanese mixes kana and Han: a tenth of kana makes it Kana."""
    n = {k: len(x.findall(text)) for k, x in SCRIPTS.items()} if not text.isascii() else {"Latin": len(SCRIPTS["Latin"].findall(text))}
    best = max(n, key=n.get)
    if best == "Han" and n["Kana"] * 10 >= n["Han"]:
        return "Kana"
    return best if n[best] else "Other"


def band_of(text: str, lang: str | None, bands: dict[str, Band]) -> str:
    """The declared language where it has a band and the text is in its script, else the script."""
    if lang in bands and (lang not in LATIN_LANGUAGES or text.isascii() or (s := script(text)) == "Latin"):
        return lang
    return script(text) if lang not in bands else s


def outside(band: Band, n: int, chars: int, n_bytes: int, bits: float, n_many: int, singles: int, n_english: int, slack: Band = SLACK) -> list[str]:
    """The measures of a text that its band doesn't allow."""
    if not n:
        return []
    z = n**-0.5
    per, ratio = chars / n, n_many / max(1, n_english)
    asked = n >= LANGUAGE_TOKENS
    limits = (
        ("few_chars", per < band.least_chars - slack.least_chars * z),
        ("many_chars", per > band.most_chars + slack.most_chars * z),
        ("bytes", n_bytes / n > band.most_bytes + slack.most_bytes * z),
        ("singles", singles / max(1, n_many) > band.most_singles + slack.most_singles * z),
        ("entropy", bits < band.least_entropy * min(np.log2(max(n, 2)), 9.0)),
        ("not_english", asked and ratio < band.least_english - slack.least_english * z),
        ("english", asked and ratio > band.most_english + slack.most_english * z),
    )
    return [name for name, hit in limits if hit]


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def repeat_words(words: list[list[str]]) -> np.ndarray:
    """Per text: words in a 5-word window that the text holds twice or more, the first one included.

    Windows are sorted by a 64-bit key; neighbours with equal keys are compared word by word, and a text with two
    unlike windows of one key is counted anew by the words themselves.
    """
    codes_of: defaultdict[str, int] = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    code = np.fromiter((codes_of[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(words)), sizes)
    out, n = np.zeros(len(words), np.int64), len(code) - WINDOW + 1
    if n <= 0:
        return out
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key = (key ^ (code[j : j + n] + np.uint64(j + 1))) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    key = (key ^ doc[:n].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    at = at[np.argsort(key[at], kind="stable")]
    same = key[at[1:]] == key[at[:-1]]
    left, right = at[:-1][same], at[1:][same]
    unlike = doc[left] != doc[right]
    for j in range(WINDOW):
        unlike |= code[left + j] != code[right + j]
    twice = np.zeros(n, bool)
    twice[left] = twice[right] = True
    covered = np.zeros(len(code), bool)
    for j in range(WINDOW):
        covered[j : j + n] |= twice
    out += np.bincount(doc[covered], minlength=len(words))
    for d in np.unique(np.concatenate([doc[left[unlike]], doc[right[unlike]]])):
        ws = words[d]
        windows = list(zip(*(ws[j:] for j in range(WINDOW)), strict=False))
        often, held = Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                held.update(range(i, i + WINDOW))
        out[d] = len(held)
    return out


def measure(texts: list[str], langs: list[str | None], paths: tuple[str, str, str], bands: dict[str, Band] = BANDS) -> dict[str, list]:
    words = [WORD.findall(t) for t in texts]
    repeats = repeat_words(words)
    counts = zip(*(c.tolist() for c in _fertility(paths).measure(texts)), strict=True)
    out: dict[str, list] = defaultdict(list)
    for text, ws, lang, rep, (n, n_bytes, bits, n_many, singles, n_english) in zip(texts, words, langs, repeats.tolist(), counts, strict=True):
        n_words = len(ws)
        band = band_of(text, lang, bands)
        base_failed = n_words < MIN_WORDS or 100 * rep > MAX_REPEAT_PERCENT * n_words
        why = outside(bands[band], n, len(text), n_bytes, bits, n_many, singles, n_english)
        for k, v in (
            ("n_words", n_words),
            ("word_chars", len(text) - sum(map(text.count, SPACES))),
            ("n_symbols", sum(map(text.count, SYMBOLS))),
            ("n_dup_lines", dup_lines(text)),
            ("n_repeat_words", rep),
            ("base_failed", base_failed),
            ("kept", not base_failed and not why),
            ("n_tokens", n),
            ("chars_per_token", len(text) / n if n else 0.0),
            ("byte_share", n_bytes / n if n else 0.0),
            ("token_entropy", bits),
            ("band", band),
            ("single_share", singles / n_many if n_many else 0.0),
            ("english_ratio", n_many / n_english if n_english else 0.0),
            ("rejected_by", ",".join(why)),
        ):
            out[k].append(v)
    return out


def fertility(docs: DataFrame, paths: tuple[str, str, str], bands: dict[str, Band] = BANDS) -> DataFrame:
    """One row per row of docs(doc_id, text, lang?): counts, fertility measures, the verdict and what it is for.

    ``paths`` are those of the sentencepiece model and of the two rank files.  A null text counts as empty (fails the
    base rule); a null or unknown lang, or one that isn't written in the script of most letters, falls back to that
    script; a null doc_id is passed on; repeated rows give repeated rows; other columns are ignored; an empty table
    gives none.  Whole texts are measured, in steps of bounded bytes; nothing is shuffled.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            got = measure(texts_of(b), b.column("lang").to_pylist(), paths, bands)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **got}, schema=_ARROW)

    return docs.select(*cols).mapInArrow(run, SCHEMA)


_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(f) for f in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"))


def op3_fertility_rules(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents``; cases as in ``fertility``."""
    return fertility(read(spark, sf_dir, "documents"), default_paths())


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their columns: the verdict rides along in the same scan, so nothing is joined.

    Null and empty texts fail the base rule and go; a missing or null lang falls back to the script; repeated rows, null
    ids and columns of any name are passed on; an empty table gives none.
    """
    paths, schema, names = default_paths(), docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            langs = b.column("lang").to_pylist() if "lang" in names else [None] * b.num_rows
            kept = measure(texts_of(b), langs, paths)["kept"]
            yield b.filter(pa.array(kept, pa.bool_()))
        trim()

    return docs.mapInArrow(run, schema)
