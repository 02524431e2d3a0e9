"""BPE encoding and decoding through a minimal acyclic transducer of the corpus's frequent words.

Words are counted over all documents; the most frequent are compiled with their ids into a lexicon that executors
fetch as a file and map into memory.  Words that the lexicon lacks are merged exactly, so its size changes speed and
never results.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import os
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm import lexicon, wordbpe
from sluice.llm.common import materialize, read, steps, texts_of

#: Most words in a lexicon (a bound on what the driver gathers, not on the input) and their longest UTF-8 form.
LEXICON_WORDS, WORD_BYTES = 1 << 17, 48
#: Distinct words that a task counts before it passes the counts on.
COUNT_RUN = 300_000
#: Merged words that a Python worker remembers.
MEMO_WORDS = 400_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the normalised words of all texts (null: none), but for words too long for a lexicon."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            fit = {w: n for w, n in seen.items() if len(w) <= WORD_BYTES}
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(fit), pa.string()), "n": pa.array(list(fit.values()), pa.int64())})

        for b in steps(batches, "text"):
            for t in texts_of(b):
                seen.update(wordbpe.words(t))
            if len(seen) > COUNT_RUN:
                yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list:
    """The first ``most`` rows by n, then word.  Words too rare to be among them are told by a histogram of n and stay
    with the tasks; otherwise each task would send the driver ``most`` words of its own."""
    counts = materialize(counts, "word-counts")
    room, least = most, 0
    for n, words in sorted((tuple(r) for r in counts.groupBy("n").count().collect()), reverse=True):
        least, room = n, room - words
        if room <= 0:
            break
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).collect()


def build_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compile the ``most`` frequent words and hand the file to the executors; returns its name there.

    Null texts have no words; words beyond WORD_BYTES are left to exact merges; of an empty table the lexicon is empty.
    """
    bpe = wordbpe.load(path)
    top = most_frequent(word_counts(docs), most)
    entries = {k: bpe.encode_word(r["word"]) for r in top if 0 < len(k := r["word"].encode("utf-8", "replace")) <= WORD_BYTES}
    folder = _served()
    lexicon.write(file := os.path.join(folder, "new"), entries)
    with open(file, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}"
    if name not in os.listdir(folder):
        os.rename(file, named := os.path.join(folder, name))
        docs.sparkSession.sparkContext.addFile(named)
    return name


@functools.cache
def _served() -> str:
    """The driver's folder of files that its file server hands out as long as it lives."""
    folder = tempfile.mkdtemp(prefix="sluice-lexicon-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Encoder:
    """Words of a step to what ``make`` makes of their ids, by the transducer or else by exact merges.

    A word that the transducer lacks is cut into pre-tokens; those that it has as words need no merges either.
    """

    def __init__(self, path: str, name: str | None, make: str):
        self.bpe = wordbpe.load(path)
        self.lexicon = lexicon.open_lexicon(SparkFiles.get(name)) if name else None
        self.make = self.digest if make == "digest" else self.plain
        self.known: list = [None] * (self.lexicon.size if self.lexicon else 0)
        self.memo: dict[str, object] = {}
        self.pre: dict[str, list[int]] = {}

    @staticmethod
    def plain(ids: list[int]) -> list[int]:
        return ids

    def digest(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), self.bpe.decode(ids), len(ids)

    def slots(self, words: list[str]) -> list[int]:
        return self.lexicon.slots([w.encode("utf-8", "replace") for w in words]).tolist() if self.lexicon else [-1] * len(words)

    def table(self, distinct: list[str]) -> dict[str, object]:
        known, memo, out, new = self.known, self.memo, {}, []
        if len(memo) > MEMO_WORDS:
            memo.clear()
            self.pre.clear()
        for w, s in zip(distinct, self.slots(distinct), strict=True):
            if s >= 0:
                e = known[s]
                if e is None:
                    e = known[s] = self.make(self.lexicon.ids(s))
                out[w] = e
            elif w in memo:
                out[w] = memo[w]
            else:
                new.append(w)
        special, pre = self.bpe.special, self.pre
        cut = [(w, self.bpe.pre_tokens(w)) for w in new if w not in special]
        unseen = list({p for _, ps in cut for p in ps} - pre.keys())
        for p, s in zip(unseen, self.slots(unseen), strict=True):
            pre[p] = self.lexicon.ids(s) if s >= 0 else self.bpe.merge(p)
        for w, ps in cut:
            out[w] = memo[w] = self.make(pre[ps[0]] if len(ps) == 1 else [i for p in ps for i in pre[p]])
        for w in new:
            if w in special:
                out[w] = self.make([special[w]])
        return out

    def documents(self, texts: list[str]) -> Iterator[list]:
        """What is made of each text's words."""
        split = [wordbpe.words(t) for t in texts]
        table = self.table(list({w for ws in split for w in ws}))
        for ws in split:
            yield [table[w] for w in ws]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, name: str | None, make: str) -> Encoder:
    """One encoder in a worker; another lexicon takes its place."""
    if (path, name, make) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, name, make] = Encoder(path, name, make)
    return _ENCODERS[path, name, make]


def encode(docs: DataFrame, path: str, name: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and ids (array<int>) in place of text.

    A null text has no ids; a text of any length is encoded whole; repeated rows stay; other columns pass through
    unless they are called n_tokens or ids.
    """
    keep = [c for c in docs.columns if c not in ("text", "n_tokens", "ids")]
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, name, "plain")
        for b in steps(batches, "text"):
            ids = [[i for e in es for i in e] for es in enc.documents(texts_of(b))]
            cols = [b.column(c) for c in keep] + [pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with its ids decoded into the column text (null ids: empty)."""
    keep = [c for c in encoded.columns if c not in ("text", "ids")]
    schema = encoded.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.load(path)
        for b in batches:
            text = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(text, pa.string())], [*keep, "text"])

    return encoded.select(*keep, "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, name: str | None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the decimal ids and of the decoded text.

    A null text counts as empty; null ids and repeated rows give rows of their own; other columns are ignored; texts of
    any length are encoded whole; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, name, "digest")
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for b in steps(batches, "text"):
            n, ids, text = [], [], []
            for es in enc.documents(texts_of(b)):
                n.append(sum([e[2] for e in es]))
                ids.append(sha(" ".join([e[0] for e in es])))
                text.append(sha(" ".join([e[1] for e in es])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_transducer(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents``; cases as in ``digests``."""
    docs = read(spark, sf_dir, "documents")
    path = wordbpe.default_path()
    return digests(docs, path, build_lexicon(docs, path))


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens and ids in place of text; cases as in ``encode``."""
    path = wordbpe.default_path()
    return encode(docs, path, build_lexicon(docs, path))
