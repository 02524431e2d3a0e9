"""Exact substring dedup by sorted suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier.  Suffixes have to meet to be sorted: the
least hash of the GRAM-byte grams in a string is its anchor, equal strings have equal anchors at equal places, and the
strings of one anchor are a stretch of text.  Stretches whose gram occurs once can't repeat and stay where they are;
the text of all others goes to the bucket of its gram.  Hashes only bring text together: equal stretches are compared
byte by byte, first within a task, then in the bucket, and the suffixes of the unlike ones are ordered by deep-shallow
sorting, a multikey quicksort to a shallow depth and blind tries for the groups that still agree there.  Suffixes that
agree in LENGTH bytes are one class, of which all but the earliest are repeats.  Strings of grams with very many
stretches are dealt over ranges between sampled splitters and sorted there in the same way.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import NULL_ID, materialize, read, steps

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Bytes that multikey quicksort orders by, in words of 8.
SHALLOW = 32
#: Stretches of a gram (some 140 bytes each) from which its strings are dealt by ranges: strings take 30 times their space.
HOT_STRETCHES = 1 << 15
#: Bytes of text for a step (and a window of a longer text), for a run of steps that is packed at once, and for a bucket.
STEP, RUN, BUCKET_BYTES = 1 << 20, 12 << 20, 24 << 20

ANCHOR, SPANS, STRETCH, HOT, TEXT, CONTEXT, STRING = 0, 1, 2, 3, 9, 4, 5
_COLUMNS = {
    ANCHOR: ("<u8", "<i8", "<u8", "<u4", "u1", "<u4"),  # gram, doc, tie, first start, starts, stretches of the gram that are known elsewhere
    SPANS: ("<i8", "<u8", "<u4", "<u4"),  # doc, tie, start, end
    STRETCH: ("<i8", "<u8", "<u4", "u1", "<u8"),  # doc, tie, first start, starts, gram
    HOT: ("<u8",),  # gram
    TEXT: ("<i8", "<u8", "<u4", "<u4"),  # doc, tie, bytes, rows
    CONTEXT: ("<u8", "<i8", "<u8", "<u4", "u1"),  # gram, doc, tie, first start, starts
    STRING: ("<i8", "<u8", "<u4"),  # doc, tie, start
}
_ROWS = "bucket int, kind int, payload binary"


def pack(kind: int, columns: list[np.ndarray], tail: bytes = b"") -> bytes:
    raw = b"".join(c.astype(t).tobytes() for c, t in zip(columns, _COLUMNS[kind], strict=True)) + tail
    return struct.pack("<IQ", len(columns[0]), len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(kind: int, data: bytes) -> tuple[list[np.ndarray], bytes]:
    n, size = struct.unpack_from("<IQ", data)
    raw = pa.Codec("zstd").decompress(data[12:], size, asbytes=True) if size else b""
    out, at = [], 0
    for t in _COLUMNS[kind]:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, raw[at:]


def gather(kind: int, payloads: list[bytes]) -> list[np.ndarray]:
    got = [unpack(kind, p)[0] for p in payloads]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, t) for t in _COLUMNS[kind]]


def parts_of(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by bucket, and (bucket, from, to) of each in that order."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    at = np.flatnonzero(np.diff(own, prepend=-1))
    return order, list(zip(own[at].tolist(), at.tolist(), np.append(at, len(own))[1:].tolist(), strict=True))


def dealt(kind: int, bucket: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    if not len(bucket):
        return []
    order, parts = parts_of(bucket)
    columns = [c[order] for c in columns]
    return [(k, kind, pack(kind, [c[s:e] for c in columns])) for k, s, e in parts]


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, p = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["bucket", "kind", "payload"])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def of_doc(doc: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(doc.astype(np.int64).view(np.uint64) ^ mixed(tie.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def of_gram(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(gram) % np.uint64(buckets)).astype(np.int64)


def rolling(text: np.ndarray, powers: tuple[int, ...]) -> np.ndarray:
    """Hash of the bytes from each place on, over a length that is the sum of ``powers`` of two."""
    level, size, out, done = text.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = max(0, len(text) - sum(powers) + 1)
    while size <= max(powers):
        if size in powers:
            part = level[done : done + n]
            out = part.copy() if out is None else mixed(out * np.uint64(0xA0761D6478BD642F) + part)
            done += size
        level = mixed(level[:-size] * np.uint64(0x9E3779B97F4A7C15) + level[size:]) if len(level) > size else level[:0]
        size *= 2
    return out


def anchors(text: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts (bytes, and the number of their document): gram hash, first and last start of the strings
    of each anchor.  Of equal hashes in a string the leftmost is the anchor, which the string alone decides."""
    n = len(text) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none
    h = rolling(text, (16, 8))
    least, size = (h & ~np.uint64(0xFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    while size * 2 <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[SPAN - size : SPAN - size + n])
    start = np.flatnonzero(doc[:n] == doc[LENGTH - 1 :])
    if not len(start):
        return none.astype(np.uint64), none, none
    at = (least[start] & np.uint64(0xFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    return h[at[new]], start[new], start[np.append(new[1:], len(start)) - 1]


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows, those that differ from the one before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def merged_spans(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans in order of (doc, tie, start), with those that touch or overlap made one."""
    order = np.lexsort((end, start, tie, doc))
    doc, tie, start, end = doc[order], tie[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return [doc, tie, start, end]
    # the furthest end so far within a document: documents are lifted apart so that one running maximum does
    own = firsts(doc, tie)
    lift = np.cumsum(own) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift) - lift
    new = own.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return [doc[at], tie[at], start[at], reach[np.append(at[1:], len(doc)) - 1]]


def by_document(doc: np.ndarray, tie: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """Where the rows of each document are, of rows sorted by (doc, tie)."""
    at = np.flatnonzero(firsts(doc, tie))
    return dict(zip(zip(doc[at].tolist(), tie[at].tolist(), strict=True), zip(at.tolist(), np.append(at, len(doc))[1:].tolist(), strict=True), strict=True))


def documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(doc, tie, text) of rows: a document is an id and a text; texts of one id are told apart, and put in order, by a
    64-bit hash, so rows that share an id only are documents of their own."""
    raw = [(x or "").encode("utf-8", "replace") for x in batch.column("text").to_pylist()]
    doc = np.array([NULL_ID if x is None else x for x in batch.column("doc_id").to_pylist()], np.int64)
    return doc, np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64), raw


def windows(raw: list[bytes], limit: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, bytes) of texts, about ``limit`` bytes at a time; a longer text comes in windows that share
    LENGTH - 1 bytes, so that each of its strings is in one of them."""
    held, size = [], 0
    for i, x in enumerate(raw):
        for at in range(0, max(1, len(x) - LENGTH + 1), limit):
            w = x[at : at + limit + LENGTH - 1]
            if held and size + len(w) > limit + LENGTH - 1:
                yield held
                held, size = [], 0
            held.append((i, at, w))
            size += len(w)
    if held:
        yield held


def find(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchors of the texts: of stretches that a run of steps holds twice all but the first are settled, the rest go to
    the bucket of their gram."""
    held: list[list[np.ndarray]] = []
    texts: list[bytes] = []
    size = 0
    for b in steps(batches, "text", STEP):
        doc, tie, raw = documents(b)
        for part in windows(raw, STEP):
            text = b"".join(w for _, _, w in part)
            sizes = np.array([len(w) for _, _, w in part], np.int64)
            number, offset = np.array([i for i, _, _ in part]), np.array([at for _, at, _ in part], np.int64)
            owner = np.repeat(np.arange(len(part)), sizes)
            gram, first, last = anchors(np.frombuffer(text, np.uint8), owner)
            if len(gram):
                own = owner[first]
                start = first - (np.cumsum(sizes) - sizes)[own] + offset[own]
                held.append([gram, doc[number[own]], tie[number[own]], start, last - first + 1, first + size])
                texts.append(text)
                size += len(text)
            if size >= RUN:
                yield batch(_settled_here(held, b"".join(texts), buckets))
                held, texts, size = [], [], 0
    yield batch(_settled_here(held, b"".join(texts), buckets))


def _settled_here(held: list[list[np.ndarray]], text: bytes, buckets: int) -> list[tuple[int, int, bytes]]:
    if not held:
        return []
    gram, doc, tie, start, n, place = (np.concatenate(c) for c in zip(*held, strict=True))
    keep, spans = unlike(text, gram, doc, tie, start, n, place)
    rows = dealt(SPANS, of_doc(spans[0], spans[1], buckets), spans)
    gram, doc, tie, start, n = (c[keep] for c in (gram, doc, tie, start, n))
    at = np.flatnonzero(firsts(gram))
    size = np.diff(np.append(at, len(gram)))
    many = np.repeat(size > 1, size)
    # stretches that surely have a rival need no bucket to say so; it is told of their gram once
    rows += dealt(STRETCH, of_doc(doc[many], tie[many], buckets), [doc[many], tie[many], start[many], n[many], gram[many]])
    told = np.where(size > 1, size, 0)
    return rows + dealt(ANCHOR, of_gram(gram[at], buckets), [gram[at], doc[at], tie[at], start[at], n[at], told])


def unlike(text: bytes, gram: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The stretches (their text is at ``place``) that equal none before them, by gram, and the spans of the others.

    A hash brings equal stretches next to each other; the bytes say whether they are equal.
    """
    end = place + n + LENGTH - 1
    key = np.array([xxhash.xxh64_intdigest(text[s:e]) for s, e in zip(place.tolist(), end.tolist(), strict=True)], np.uint64)
    order = np.lexsort((start, tie, doc, n, key, gram))
    new = firsts(gram[order], key[order], n[order])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    at = np.flatnonzero(~new)
    own, first = order[at], lead[at]
    pairs = zip(place[own].tolist(), end[own].tolist(), place[first].tolist(), end[first].tolist(), strict=True)
    new[at] = [text[s:e] != text[s2:e2] for s, e, s2, e2 in pairs]
    again = ~new & ((doc[order] != doc[lead]) | (tie[order] != tie[lead]) | (start[order] != start[lead]))  # a place is no repeat of itself
    i = order[again]
    return order[new], merged_spans(doc[i], tie[i], start[i], start[i].astype(np.int64) + n[i] + LENGTH - 1)


def settle(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A bucket of grams: the stretches whose gram occurs again, and the grams of very many."""
    held: list[bytes] = []
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == ANCHOR:
                held.append(r["payload"])
            else:
                yield batch([(r["bucket"], r["kind"], r["payload"])])
    gram, doc, tie, start, n, told = gather(ANCHOR, held)
    held.clear()
    order = np.argsort(gram, kind="stable")
    gram, doc, tie, start, n, told = (c[order] for c in (gram, doc, tie, start, n, told))
    rows: list[tuple[int, int, bytes]] = []
    if len(gram):
        at = np.flatnonzero(firsts(gram))
        total = np.add.reduceat(np.maximum(told, 1).astype(np.int64), at)
        rival = (told == 0) & np.repeat(total > 1, np.diff(np.append(at, len(gram))))
        rows += dealt(STRETCH, of_doc(doc[rival], tie[rival], buckets), [doc[rival], tie[rival], start[rival], n[rival], gram[rival]])
        hot = total >= HOT_STRETCHES
        if hot.any():
            rows.append((0, HOT, pack(HOT, [gram[at][hot]])))
    yield batch(rows)


def text_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts, packed by bucket of their document; rows of one document are one text with their number."""
    held: dict[tuple[int, int], list] = {}
    size = 0

    def packed() -> pa.RecordBatch:
        if not held:
            return batch([])
        doc, tie = np.array([d for d, _ in held], np.int64), np.array([t for _, t in held], np.uint64)
        raw, many = zip(*held.values(), strict=True)
        order, parts = parts_of(of_doc(doc, tie, buckets))
        rows = []
        for k, s, e in parts:
            at = order[s:e]
            columns = [doc[at], tie[at], np.array([len(raw[i]) for i in at], np.uint32), np.array([many[i] for i in at], np.uint32)]
            rows.append((k, TEXT, pack(TEXT, columns, b"".join(raw[i] for i in at))))
        return batch(rows)

    for b in steps(batches, "text", STEP):
        doc, tie, raw = documents(b)
        for d, t, x in zip(doc.tolist(), tie.tolist(), raw, strict=True):
            if (d, t) in held:
                held[d, t][1] += 1
            else:
                held[d, t] = [x, 1]
                size += len(x)
        if size >= RUN:
            yield packed()
            held.clear()
            size = 0
    yield packed()


def _cut(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of many stretches of a text, one after the other."""
    return text[np.repeat(at - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _wanted(batches: Iterator[pa.RecordBatch], which: np.ndarray, inside: bool) -> Iterator[list[np.ndarray]]:
    """[gram, doc, tie, start, starts, text] of the stretches of a bucket of documents whose gram is (or, unless
    ``inside``, isn't) in ``which``."""
    held: list[bytes] = []
    wanted = None
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == STRETCH:  # these come before the texts
                held.append(r["payload"])
                continue
            if wanted is None:
                doc, tie, start, n, gram = gather(STRETCH, held)
                held.clear()
                mine = np.isin(gram, which) == inside
                order = np.lexsort((tie[mine], doc[mine]))
                doc, tie, start, n, gram = (c[mine][order] for c in (doc, tie, start, n, gram))
                wanted, start, n = by_document(doc, tie), start.astype(np.int64), n.astype(np.int64)
            (ids, ties, sizes, _), raw = unpack(TEXT, r["payload"])
            sizes = sizes.astype(np.int64)
            asked = {k: i for i, k in enumerate(zip(ids.tolist(), ties.tolist(), strict=True)) if k in wanted}
            if not asked:
                continue
            low, high = np.array([wanted.pop(k) for k in asked]).T  # each document once
            each = high - low
            at = np.repeat(low - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
            base = np.repeat((np.cumsum(sizes) - sizes)[list(asked.values())], each)
            yield [gram[at], doc[at], tie[at], start[at], n[at], _cut(np.frombuffer(raw, np.uint8), base + start[at], n[at] + LENGTH - 1)]


def fetch(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket of documents: the text of the wanted stretches, to the bucket of their gram; hot grams are left out."""
    held: list[list[np.ndarray]] = []
    size = 0

    def packed() -> pa.RecordBatch:
        if not held:
            return batch([])
        gram, doc, tie, start, n, text = (np.concatenate(c) for c in zip(*held, strict=True))
        cut = n + LENGTH - 1
        base = np.cumsum(cut) - cut
        order, parts = parts_of(of_gram(gram, buckets))
        gram, doc, tie, start, n, base, cut = (c[order] for c in (gram, doc, tie, start, n, base, cut))
        return batch([(k, CONTEXT, pack(CONTEXT, [c[s:e] for c in (gram, doc, tie, start, n)], _cut(text, base[s:e], cut[s:e]).tobytes())) for k, s, e in parts])

    for got in _wanted(batches, hot, False):
        held.append(got)
        size += len(got[-1])
        if size >= RUN // 2:
            yield packed()
            held, size = [], 0
    yield packed()


def _strings(n: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place in the text of all stretches, doc, tie, start) of each string of the stretches."""
    base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(base, n) + within, np.repeat(doc, n), np.repeat(tie, n), np.repeat(start, n) + within


def hot_strings(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket of documents: its strings of hot grams, each once; repeats of these are settled.  A row's bucket is
    the number of its strings."""
    for _, doc, tie, start, n, text in _wanted(batches, hot, True):
        at, doc, tie, start = _strings(n, doc, tie, start)
        raw = text.tobytes()
        for s in range(0, len(at), 1 << 20):
            p, d, t, b = (c[s : s + (1 << 20)] for c in (at, doc, tie, start))
            first, spans = repeated(raw, p, d, t, b)
            rows = dealt(SPANS, of_doc(spans[0], spans[1], buckets), spans)
            p, d, t, b = (c[first] for c in (p, d, t, b))
            yield batch([*rows, (len(p), STRING, pack(STRING, [d, t, b], _cut(text, p, np.full(len(p), LENGTH)).tobytes()))])


def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings as rows."""
    for b in batches:
        for x in b.column("payload").to_pylist():
            (doc, tie, start), raw = unpack(STRING, x)
            text = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(doc), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([text, pa.array(doc), pa.array(tie.view(np.int64)), pa.array(start.astype(np.int64))], ["string", "doc", "tie", "start"])


def ranged(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A range of strings: spans of those that are not the first of their class."""
    held = [b for b in batches if b.num_rows]
    if held:
        text = b"".join(x for b in held for x in b.column("string").to_pylist())
        doc, tie, start = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("doc", "tie", "start"))
        spans = repeated(text, np.arange(len(doc)) * LENGTH, doc, tie.view(np.uint64), start)[1]
        yield batch(dealt(SPANS, of_doc(spans[0], spans[1], buckets), spans))


def sorted_classes(text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes ``at`` of ``text`` in order of their first LENGTH bytes, and which of them differ from the one before:
    deep-shallow sorting, all groups of a level at once.

    Down to SHALLOW bytes each level splits every group by the next 8 bytes.  A group that is left there becomes a
    blind trie, built from its root: what its members share is skipped by comparing each with one of them, the bytes
    after the least common prefix branch, and so on in every branch; a group whose members share LENGTH bytes is a leaf.
    """
    data = np.frombuffer(text + bytes(16), np.uint8)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    word = lambda p: eight[p].view(">u8").ravel().astype(np.uint64)
    order = np.arange(len(at))
    group = np.zeros(len(at), np.int64)  # where the group of a suffix begins
    live = np.arange(len(at)) if len(at) > 1 else np.zeros(0, np.int64)

    def split(key: np.ndarray) -> np.ndarray:
        """Order the live groups by ``key``; returns what is live after that: members of groups of two or more."""
        g = group[live]
        o = np.lexsort((key, g))
        order[live] = order[live][o]
        new = firsts(g, key[o])
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        alone = new & np.append(new[1:], True)
        return live[~alone]

    for depth in range(0, SHALLOW, 8):
        if len(live):
            live = split(word(at[order[live]] + depth))
    while len(live):
        lead = firsts(group[live])
        own, first = at[order[live]], at[order[group[live]]]
        shared = np.full(len(live), LENGTH, np.int64)
        todo = np.arange(len(live))
        for depth in range(SHALLOW, LENGTH, 8):
            differ = word(own[todo] + depth) ^ word(first[todo] + depth)
            found = differ != 0
            shared[todo[found]] = np.minimum(LENGTH, depth + leading_bytes(differ[found]))
            todo = todo[~found]
            if not len(todo):
                break
        branch = np.minimum.reduceat(shared, np.flatnonzero(lead))
        branch = np.repeat(branch, np.diff(np.append(np.flatnonzero(lead), len(live))))
        open_ = branch < LENGTH
        live, own, branch = live[open_], own[open_], branch[open_]
        if len(live):
            over = np.maximum(0, branch + 8 - LENGTH).astype(np.uint64) * np.uint64(8)
            live = split(word(own + branch) >> over)
    new = group == np.arange(len(at))
    return order, new


def leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes before the first other one, of words that aren't zero."""
    out = np.zeros(len(x), np.int64)
    for k in (4, 2, 1):
        low = x < np.uint64(1) << np.uint64(64 - 8 * k)
        out += k * low
        x = np.where(low, x << np.uint64(8 * k), x)
    return out


def repeated(text: bytes, at: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The earliest suffix of each class, and the spans of the others."""
    order, new = sorted_classes(text, at)
    k = np.cumsum(new)
    order = order[np.lexsort((start[order], tie[order], doc[order], k))]
    first = order[np.flatnonzero(firsts(k))[k - 1]] if len(k) else order
    again = (doc[order] != doc[first]) | (tie[order] != tie[first]) | (start[order] != start[first])
    i = order[again]
    return order[firsts(k)], merged_spans(doc[i], tie[i], start[i], start[i].astype(np.int64) + LENGTH)


def repeats(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A bucket of stretches: spans of those that equal an earlier one, and of the suffixes of the others that do."""
    got = [unpack(CONTEXT, x) for b in batches for x in b.column("payload").to_pylist()]
    if not got:
        return
    text = b"".join(raw for _, raw in got)
    gram, doc, tie, start, n = (np.concatenate(c) for c in zip(*(c for c, _ in got), strict=True))
    got.clear()
    n, start = n.astype(np.int64), start.astype(np.int64)
    base = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    keep, spans = unlike(text, gram, doc, tie, start, n, base)
    at = np.flatnonzero(firsts(gram[keep]))
    size = np.diff(np.append(at, len(keep)))
    keep = keep[np.repeat(size > 1, size)]
    if len(keep):
        _, d, t, s = _strings(n[keep], doc[keep], tie[keep], start[keep])
        within = np.arange(len(s)) - np.repeat(np.cumsum(n[keep]) - n[keep], n[keep])
        more = repeated(text, np.repeat(base[keep], n[keep]) + within, d, t, s)[1]
        spans = merged_spans(*(np.concatenate(c) for c in zip(spans, more, strict=True)))
    yield batch(dealt(SPANS, of_doc(spans[0], spans[1], buckets), spans))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, list[tuple[int, int]]]]:
    """(doc_id, rows, text, spans) of a bucket of documents; its spans come before its texts."""
    held: list[bytes] = []
    spans = None
    for b in batches:
        for r in b.to_pylist():
            if r["kind"] == SPANS:
                held.append(r["payload"])
                continue
            if spans is None:
                doc, tie, start, end = merged_spans(*gather(SPANS, held))
                spans = by_document(doc, tie)
                held.clear()
            (ids, ties, sizes, many), raw = unpack(TEXT, r["payload"])
            at = 0
            for d, t, n, m in zip(ids.tolist(), ties.tolist(), sizes.tolist(), many.tolist(), strict=True):
                i, j = spans.get((d, t), (0, 0))
                yield d, m, raw[at : at + n], list(zip(start[i:j].tolist(), end[i:j].tolist(), strict=True))
                at += n


def spans_and_texts(docs: DataFrame) -> DataFrame:
    """Packed texts and spans of repeated bytes, by bucket of document, spans first."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    by_bucket = lambda df: df.repartitionById(buckets, F.col("bucket"))
    texts = docs.mapInArrow(lambda it: text_rows(it, buckets), _ROWS)
    found = by_bucket(docs.mapInArrow(lambda it: find(it, buckets), _ROWS)).mapInArrow(lambda it: settle(it, buckets), _ROWS)
    found = materialize(found, "suffix-stretches")
    # a gram of HOT_STRETCHES stretches takes that many of the input's: the driver gets 8 bytes for 160 KB of text at least
    hot = [unpack(HOT, r["payload"])[0][0] for r in found.where(F.col("kind") == HOT).select("payload").toLocalIterator()]
    hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *hot]))
    wanted = by_bucket(found.where(F.col("kind") == STRETCH).unionByName(texts)).sortWithinPartitions("kind")
    contexts = wanted.mapInArrow(lambda it: fetch(it, buckets, hot), _ROWS)
    more = by_bucket(contexts).mapInArrow(lambda it: repeats(it, buckets), _ROWS)
    if len(hot):
        strings = materialize(wanted.mapInArrow(lambda it: hot_strings(it, buckets, hot), _ROWS), "suffix-strings")
        apart = strings.where(F.col("kind") == STRING)
        ranges = -(-(apart.agg(F.sum("bucket")).first()[0] or 0) * (LENGTH + 24) // BUCKET_BYTES)
        rows = apart.select("payload").mapInArrow(loose, "string binary, doc long, tie long, start long")
        more = more.unionByName(rows.repartitionByRange(max(1, ranges), "string").mapInArrow(lambda it: ranged(it, buckets), _ROWS))
        more = more.unionByName(strings.where(F.col("kind") == SPANS))
    more = materialize(more, "suffix-repeats")
    return by_bucket(found.where(F.col("kind") == SPANS).unionByName(more).unionByName(texts)).sortWithinPartitions("kind")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs(doc_id, text).

    A document is an id and a text.  Rows that are equal in both are one document and get equal results; rows that
    share the id only are documents of their own, in an order that a hash of the text fixes.  A null doc_id comes
    before all others; null texts are empty; texts may be of any length; other columns are ignored; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for d, many, text, spans in cut_out(batches):
            edges = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
            row = {"doc_id": None if d == NULL_ID else d, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept": kept}
            for _ in range(many):
                rows.append(row)
                held += len(text)
                if held > STEP:
                    yield pa.RecordBatch.from_pylist(rows, schema=_KEPT)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_KEPT)

    return spans_and_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The operator over ``documents``, the remaining bytes as their SHA-256; cases as in ``dedup``."""
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
