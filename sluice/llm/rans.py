"""Token ids in files coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by every block.  A block stands alone: its ids are dealt
over interleaved lanes, each with a 64-bit state that gives up 32-bit words, so a step codes one id of every lane
at once.  Checkpoints hold the states and the place in the words every so many steps, where decoding may begin;
checksums cover the coded words and the ids.
"""

from __future__ import annotations

import functools
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.llm import store, wordbpe
from sluice.llm.common import NULL_ID, Shards, at_hand, materialize, range_shards, read, shared_path, steps, texts_of

LOW = 1 << 31
LANES, BLOCK, CHECK_STEPS = 1024, 1 << 20, 256
#: Bytes of text that a shard is cut for, and half the words a worker remembers.
SHARD_BYTES, MEMO_WORDS = 8 << 20, 190_000
END_ID = 1
_BLOCK = struct.Struct("<4sIIIIIII")  # magic, ids, lanes, words, steps between checkpoints, checkpoints, crc of words, crc of ids
_FILE = struct.Struct("<8sIIII")  # magic, blocks, documents, crc of the table, bytes of the directory


class Table:
    """Frequencies of ids scaled to a power of two, at least 1 for each id that occurs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = int(self.freq.sum()).bit_length() - 1
        if len(freq) and int(self.freq.sum()) != 1 << self.bits:
            raise ValueError("the frequencies don't add up to a power of two")
        self.start = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @functools.cached_property
    def symbol(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    @classmethod
    def scaled(cls, counts: np.ndarray) -> Table:
        used = counts > 0
        n = int(used.sum())
        bits = min(24, max(16, (max(n, 1) - 1).bit_length() + 4))
        freq, total = np.zeros(len(counts), np.int64), float(counts.sum())
        if not n:
            freq = np.zeros(max(1, len(counts)), np.int64)
            freq[0] = 1 << bits
            return cls(freq)
        freq[used] = np.maximum(1, np.floor(counts[used] / total * ((1 << bits) - n))).astype(np.int64)
        freq[int(np.argmax(counts))] += (1 << bits) - int(freq.sum())
        return cls(freq)


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = min(LANES, 1 << max(0, (n // 64).bit_length()))
    n_steps = -(-n // lanes)
    bits, f_of, s_of = np.uint64(table.bits), table.freq, table.start
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    ids64 = ids.astype(np.int64)
    top = np.uint64((LOW >> table.bits) << 32)
    for step in range(n_steps - 1, -1, -1):
        part = ids64[step * lanes : (step + 1) * lanes]
        m = len(part)
        f, x = f_of[part], state[:m]
        full = x >= top * f
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f)
        state[:m] = (q << bits) + r + s_of[part]
        if step % CHECK_STEPS == 0:
            marks.append((len(words), state.copy()))
    words.reverse()
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    ends = np.cumsum([0, *(len(w) for w in words)])
    marks.reverse()  # the mark before step k * CHECK_STEPS reads words from that step's first on
    body = b"".join(struct.pack("<I", int(ends[len(words) - k])) + s.astype("<u8").tobytes() for k, s in marks) + stream.tobytes()
    return _BLOCK.pack(b"RNS1", n, lanes, len(stream), CHECK_STEPS, len(marks), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(data: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the block from checkpoint ``first`` up to checkpoint ``last`` (None: the end)."""
    magic, n, lanes, n_words, every, n_marks, crc, ids_crc = _BLOCK.unpack_from(data)
    body = memoryview(data)[_BLOCK.size :]
    if magic != b"RNS1" or zlib.crc32(body) != crc:
        raise OSError("a block is damaged")
    if not n:
        return np.zeros(0, np.uint32)
    size = 4 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, n_marks * size).astype(np.uint64)
    at = struct.unpack_from("<I", body, first * size)[0]
    state = np.frombuffer(body, "<u8", lanes, first * size + 4).astype(np.uint64)
    begin, end = first * every, -(-n // lanes) if last is None else min(last * every, -(-n // lanes))
    out = np.empty(min(end * lanes, n) - begin * lanes, np.uint32)
    mask, bits, low = np.uint64((1 << table.bits) - 1), np.uint64(table.bits), np.uint64(LOW)
    f_of, s_of, symbol = table.freq, table.start, table.symbol
    for step in range(begin, end):
        m = min(lanes, n - step * lanes)
        x = state[:m]
        slot = x & mask
        sym = symbol[slot]
        out[(step - begin) * lanes : (step - begin) * lanes + m] = sym
        x = f_of[sym] * (x >> bits) + slot - s_of[sym]
        short = np.flatnonzero(x < low)
        if len(short):
            x[short] = x[short] << np.uint64(32) | words[at : at + len(short)]
            at += len(short)
        state[:m] = x
    if first == 0 and last is None and zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise OSError("a block's ids are not those that were written")
    return out


def encode_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, table: Table) -> bytes:
    directory = zlib.compress(doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes(), 1)
    blocks = [encode_block(ids[i : i + BLOCK], table) for i in range(0, len(ids), BLOCK)]
    index = b"".join(struct.pack("<I", len(b)) for b in blocks)
    return _FILE.pack(b"RANSIDS1", len(blocks), len(doc_ids), table.crc, len(directory)) + index + directory + b"".join(blocks)


def decode_file(data: bytes, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    magic, n_blocks, n_docs, crc, n_dir = _FILE.unpack_from(data)
    if magic != b"RANSIDS1" or crc != table.crc:
        raise OSError("not a file of ids, or of another table")
    sizes = np.frombuffer(data, "<u4", n_blocks, _FILE.size).astype(np.int64)
    at = _FILE.size + 4 * n_blocks
    directory = zlib.decompress(data[at : at + n_dir])
    doc_ids, lengths = np.frombuffer(directory, "<i8", n_docs), np.frombuffer(directory, "<u4", n_docs, 8 * n_docs)
    at += n_dir
    parts = []
    for n in sizes:
        parts.append(decode_block(data[at : at + n], table))
        at += n
    return doc_ids, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class _Words(dict):
    """Words, in bytes of their ids, as the tokenizers library gives them; a text's ids are those of its words, in
    order.  A pre-token is a word too, so both are remembered together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.bpe = wordbpe.load(path)
        self.model = Tokenizer.from_file(path).model
        self.tokenize = self.model.tokenize

    def __missing__(self, w: str) -> bytes:
        ids = self.older.pop(w, None)
        if ids is None:
            head = w[:-1]
            if w.isascii() and w.isalpha():  # the commonest cases first; letters stand for themselves
                ids = array("I", [t.id for t in self.tokenize(w)]).tobytes()
            elif w[-1] in ".,;:!?" and head.isascii() and head.isalpha():
                ids = self[head] + self[w[-1]]
            elif w in self.bpe.special:
                ids = array("I", [self.bpe.special[w]]).tobytes()
            elif (cut := self.bpe.pre_tokens(w)) == [w]:
                ids = array("I", [t.id for t in self.tokenize("".join([self.bpe.byte[b] for b in w.encode("utf-8", "replace")]))]).tobytes()
            else:
                ids = b"".join([self[p] for p in cut])
        self[w] = ids
        return ids

    def text(self, text: str) -> bytes:
        if len(self) > MEMO_WORDS:  # words in use come back from the older half
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, wordbpe.words(text)))


@at_hand
@functools.lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    return _Words(path)


def _pack(doc_ids: np.ndarray, ties: np.ndarray, texts: list[bytes]) -> bytes:
    """Documents with their ids, compressed; ids that fit are written in two bytes, low bytes first."""
    sizes = np.array([len(t) // 4 for t in texts], "<u4")
    ids = np.frombuffer(b"".join(texts), "<u4")
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    body = ids.tobytes() if wide else ids.astype("<u2").tobytes()
    raw = struct.pack("<I?", len(doc_ids), wide) + doc_ids.astype("<i8").tobytes() + ties.astype("<i8").tobytes() + sizes.tobytes() + body
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.Codec("zstd").decompress(data[8:], struct.unpack_from("<Q", data)[0], asbytes=True)
    n, wide = struct.unpack_from("<I?", raw)
    doc_ids, ties, sizes = np.frombuffer(raw, "<i8", n, 5), np.frombuffer(raw, "<i8", n, 5 + 8 * n), np.frombuffer(raw, "<u4", n, 5 + 16 * n)
    return doc_ids, ties, sizes, np.frombuffer(raw, "<u4" if wide else "<u2", offset=5 + 20 * n).astype("<u4")


def _tokenize(docs: DataFrame, path: str, end_id: int | None, shards: Shards) -> DataFrame:
    """(shard, payload): the documents of a step that belong to a shard, packed."""
    end = b"" if end_id is None else np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _words(path)
        for b in steps(batches, "text"):
            ids = [enc.text(t) + end for t in texts_of(b)]
            doc = np.array([NULL_ID if x is None else x for x in b.column("doc_id").to_pylist()], np.int64)
            tie = b.column("tie").to_numpy()
            shard = shards.of(doc, tie)
            of = {s: np.flatnonzero(shard == s) for s in np.unique(shard)}
            rows = [_pack(doc[i], tie[i], [ids[j] for j in i]) for i in of.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int32()), pa.array(rows, pa.binary())], ["shard", "payload"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).mapInArrow(run, "shard int, payload binary")


def write_ids(spark: SparkSession, docs: DataFrame, out: str, path: str, end_id: int | None = END_ID) -> Table:
    """Encode every whole text and write ids in ascending doc_id order to files under ``out``.

    A null text has no ids but the end id; a null doc_id sorts first; rows of equal doc_id are in the order of a hash of
    their text, then of their ids, and may be many.  Other columns are ignored.  An empty table gives a manifest without files.  Texts are encoded once: shards of ids wait in compressed files
    while their frequencies are summed, then each is coded with the shared table.
    """
    shards = range_shards(docs, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 8, SHARD_BYTES, F.xxhash64("text"))
    raw = f"{out}/raw"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, shard, payloads = store.Attempt(raw), None, []
        for b in batches:
            for r in b.to_pylist():
                shard = r["shard"]  # a partition is one shard
                payloads.append(r["payload"])
        if not payloads:
            return
        got = [_unpack(p) for p in payloads]
        payloads.clear()
        doc = np.concatenate([g[0] for g in got])
        tie = np.concatenate([g[1] for g in got])
        sizes = np.concatenate([g[2] for g in got]).astype(np.int64)
        ids = np.concatenate([g[3] for g in got])
        first = np.cumsum(sizes) - sizes
        piece = lambda i: ids[first[i] : first[i] + sizes[i]]
        order = np.lexsort((tie, doc))
        same = np.append(False, (doc[order][1:] == doc[order][:-1]) & (tie[order][1:] == tie[order][:-1]))
        if same.any():  # mostly equal texts
            ends = np.append(np.flatnonzero(~same), len(order))
            for s, e in zip(ends.tolist(), ends[1:].tolist(), strict=False):
                order[s:e] = sorted(order[s:e].tolist(), key=lambda i: piece(i).tobytes()) if e - s > 1 else order[s:e]
        data = _pack(doc[order], tie[order], [piece(i).tobytes() for i in order])
        row = parts.write(f"shard-{shard:06d}.ids", data, shard, 0, len(doc))
        often = np.bincount(ids)
        used = np.flatnonzero(often)
        yield pa.RecordBatch.from_pylist([{**row, "id": None, "n": len(ids)}], schema=_COUNTED_ARROW)
        none = [pa.nulls(len(used), f.type) for f in store.ARROW]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array(often[used], pa.int64())], schema=_COUNTED_ARROW)

    shuffled = _tokenize(docs, path, end_id, shards).repartitionById(shards.n, F.col("shard"))
    counted = materialize(shuffled.mapInArrow(gather, _COUNTED), "ids-counted")
    often = counted.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(max((r["id"] for r in often), default=0) + 1, np.int64)
    for r in often:
        counts[r["id"]] = r["n"]
    table = Table.scaled(counts)
    shared = spark.sparkContext.broadcast(table.freq.astype(np.uint32))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, t = store.Attempt(out), Table(shared.value)
        for b in batches:
            for r in b.to_pylist():
                doc, _, sizes, ids = _unpack(store.load(raw, r["temp"], r["sha256"]))
                data = encode_file(doc, sizes, ids, t)
                yield store.manifest_batch([coded.write(f"ids-{r['shard']:06d}.rans", data, r["shard"], 0, len(ids))])

    waiting = counted.where("id IS NULL").select("temp", "shard", "sha256")
    store.commit(store.spread(waiting).mapInArrow(code, store.MANIFEST), out)
    fs, root = store.place(out)
    fs.delete_dir(f"{root}/raw") if fs.get_file_info(f"{root}/raw").type == store.pafs.FileType.Directory else None
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/table.freq") as f:
        f.write(table.freq.astype("<u4").tobytes())
    return table


_COUNTED = store.MANIFEST + ", id int, n long"
_COUNTED_ARROW = pa.schema([*store.ARROW, ("id", pa.int32()), ("n", pa.int64())])


def read_table(out: str) -> Table:
    return Table(np.frombuffer(store.load(out, "table.freq"), "<u4"))


def read_ids(spark: SparkSession, out: str, digest_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (unless ``digest_only``) ids of every document in the files.

    A file is decoded in one task; how many ids stand before it comes from the manifest, a row per file.
    """
    shared = spark.sparkContext.broadcast(read_table(out).freq.astype(np.uint32))
    before = F.sum("records").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = store.read_manifest(spark, out).select("name", "sha256", F.coalesce(before, F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<int>")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared.value)
        for b in batches:
            for r in b.to_pylist():
                doc, sizes, ids = decode_file(store.load(out, r["name"], r["sha256"]), t)
                ends = np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [
                    pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(starts + r["base"], pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if not digest_only:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return store.spread(files).mapInArrow(decode, schema)


def decode_part(data: bytes, table: Table, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a file: of the blocks that hold some, from the last checkpoint before the first of
    them to the next after the last."""
    _, n_blocks, _, _, n_dir = _FILE.unpack_from(data)
    sizes = np.frombuffer(data, "<u4", n_blocks, _FILE.size).astype(np.int64)
    base = _FILE.size + 4 * n_blocks + n_dir
    starts = base + np.cumsum(sizes) - sizes
    out = []
    for k in range(begin // BLOCK, -(-end // BLOCK) if end > begin else 0):
        if k >= n_blocks:
            break
        block = data[starts[k] : starts[k] + sizes[k]]
        _, n, lanes, _, every, n_marks, _, _ = _BLOCK.unpack_from(block)
        span = every * lanes  # ids between checkpoints
        low, high = max(0, begin - k * BLOCK), min(n, end - k * BLOCK)
        first, last = low // span, -(-high // span)
        ids = decode_block(block, table, first, None if last >= n_marks else last)
        out.append(ids[low - first * span : high - first * span])
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_span(spark: SparkSession, out: str, start: int, n: int) -> DataFrame:
    """(start, ids) of ids ``start`` to ``start + n`` of all files, a row for each file that holds some; only the blocks
    and checkpoints between them are decoded."""
    shared = spark.sparkContext.broadcast(read_table(out).freq.astype(np.uint32))
    before = F.sum("records").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1))
    files = store.read_manifest(spark, out).select("name", "sha256", "records", F.coalesce(before, F.lit(0)).alias("base"))
    files = files.where((F.col("base") < start + n) & (F.col("base") + F.col("records") > start))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(shared.value)
        for b in batches:
            for r in b.to_pylist():
                begin, end = max(0, start - r["base"]), min(r["records"], start + n - r["base"])
                ids = decode_part(store.load(out, r["name"], r["sha256"]), t, begin, end)
                yield pa.RecordBatch.from_pydict({"start": [r["base"] + begin], "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})

    return store.spread(files).mapInArrow(decode, "start long, ids array<int>")


def op6_rans_ids(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents``, with files under the shared folder; cases as in ``write_ids``."""
    out = shared_path(spark, "rans")
    write_ids(spark, read(spark, sf_dir, "documents"), out, wordbpe.default_path())
    return read_ids(spark, out, digest_only=True)
