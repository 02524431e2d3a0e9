"""Fuzzy line dedup: MinHash over character shingles, exact Jaccard, one line kept per component.

Equal lines are one node, known by a 128-bit hash.  Distinct lines get a signature of bin minima over their
character 8-grams (each line has its own shingles hashed once; short lines get a minimum per bin function instead),
which bands cut into keys.  Keys go to buckets in packed form; lines that share a key are fetched, compared by exact
Jaccard similarity and linked; components of links keep their first line, by doc_id and line number.  A document is an
id and a text: rows that share the id only are told apart, and put in order, by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sluice.llm.common import NULL_ID, columns, forget, fresh, materialize, read, steps, texts_of, trim
from sluice.llm.components import components

SHINGLE, SIMILARITY = 8, 0.8
#: At similarity 0.8 a pair shares a key with probability 1 - (1 - 0.8 ** 5) ** 12 = 0.99.
BANDS, ROWS = 12, 5
BINS = BANDS * ROWS
#: Lines of fewer distinct shingles than FULL have a minimum per function, those of at least DIVIDED a minimum per bin.
#: Sets at similarity 0.8 differ in size by a factor of 0.8 at most, so both lines of a pair have signatures of one kind.
DIVIDED, FULL = 80, 101
#: Bytes of text of a step: the arrays of a step stay near the processor.
STEP = 512 << 10
#: Lines of groups that are verified at once, characters of lines whose shingles are hashed at once, and hashes
#: that stay at hand.
BLOCK_LINES, BLOCK_CHARS, KEPT_SHINGLES = 1_500, 1 << 19, 3_000_000
#: Keys that are packed at once.
PACKED_KEYS = 1 << 18
#: Lines of a group that are compared in one task; a larger group is dealt as tiles of block pairs.
TILE_LINES = 2_048
#: Lines of a group from which it needn't meet the other groups of its leader in one task; tasks it may go to then.
APART_LINES, APART = 256, 4
#: Bytes of packed keys of a bucket, and of one line's.
BUCKET_BYTES, LINE_BYTES = 64 << 20, 13 * BANDS
#: Candidate lines whose hashes are handed to the scan as a filter (8 bytes each); beyond it the join alone finds them.
FILTER_LINES = 1 << 21
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, line) of the lines that aren't blank, without white space at their ends."""
    return [(i, s) for i, x in enumerate(text.split("\n")) if (s := x.strip(SPACES))]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Odd factors of a band's rows in its key.
_WEIGHTS = _mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def shingles(line: str) -> set[str]:
    """Character 8-grams; a shorter line is a shingle of its own."""
    return {line[i : i + SHINGLE] for i in range(len(line) - SHINGLE + 1)} or {line}


def similar(a: set[str], b: set[str]) -> bool:
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of every shingle of the lines, in order."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c += np.uint64(1)
    for k, p in ((1, 0x9FB21C651E98DF25), (2, 0xA0761D6478BD642F), (4, 0xE7037ED1A0B428DB)):
        if len(c) <= k:
            c = c[:0]
            break
        tail = c[k:]
        c = c[:-k] * np.uint64(p)
        c += tail
    c = _mixed(c)
    inside = np.ones(len(c), bool)
    ends = np.cumsum(size)
    for k in range(1, SHINGLE):  # windows that begin here run over the end of a line
        past = ends - k
        inside[past[(past >= 0) & (past < len(c))]] = False
    c = c[inside]
    owner = np.repeat(np.arange(len(lines), dtype=np.int32), np.maximum(size - SHINGLE + 1, 0))
    short = np.flatnonzero(size < SHINGLE).astype(np.int32)
    if not len(short):
        return c, owner
    whole = np.array([xxhash.xxh64_intdigest(lines[i].encode("utf-8", "surrogatepass"), 7) for i in short], np.uint64)
    h, line = np.concatenate([c, whole]), np.concatenate([owner, short])
    order = np.argsort(line, kind="stable")
    return h[order], line[order]


def _per_function(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A minimum per function and line."""
    out = np.empty((len(starts), BINS), np.uint32)
    h = h.astype(np.uint64)
    for k in range(BINS):
        f = ((h ^ np.uint64(int(_MIX) * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93 + 2 * k)) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(f.astype(np.uint32), starts)
    return out


def _per_bin(h: np.ndarray, line: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash per shingle: the least in each bin; an empty bin takes the next full one's.  Also the distinct shingles
    of each line, told apart by 38 bits: a count that is one short still leaves both lines of a pair a kind in common."""
    key = h >> np.uint64(40)
    key *= np.uint64(BINS)
    key >>= np.uint64(24)
    key += line * np.uint64(BINS)
    key <<= np.uint64(32)
    key |= h & np.uint64(0xFFFFFFFF)
    key.sort()
    slot = (key >> np.uint64(32)).astype(np.int64)
    n = len(places)
    distinct = np.add.reduceat(np.append(True, key[1:] != key[:-1]), np.cumsum(places) - places, dtype=np.int64)
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    least = np.zeros(n * BINS, np.uint32)
    least[slot[first]] = key[first].astype(np.uint32)
    # the next full bin of each, around the end
    nearest = np.full(n * BINS, 2 * BINS, np.int16)
    nearest[slot[first]] = (slot[first] % BINS).astype(np.int16)
    nearest = nearest.reshape(n, BINS)
    for b in range(BINS - 2, -1, -1):
        np.minimum(nearest[:, b], nearest[:, b + 1], out=nearest[:, b])
    nearest = np.minimum(nearest, nearest[:, :1] + np.int16(BINS))
    away = (nearest - np.arange(BINS, dtype=np.int16)).astype(np.uint32)
    return np.take_along_axis(least.reshape(n, BINS), (nearest % BINS).astype(np.int64), 1) ^ (away * np.uint32(0x9E3779B1)), distinct


def band_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of every band of every signature of the lines."""
    h, line = _shingle_hashes(lines)
    n = np.bincount(line, minlength=len(lines))  # places, repeats included: no fewer than distinct shingles
    long = np.flatnonzero(n >= DIVIDED)
    binned, count = None, n.copy()
    if len(long):
        binned, count[long] = _per_bin(h[np.repeat(n >= DIVIDED, n)], np.repeat(np.arange(len(long), dtype=np.uint64), n[long]), n[long])
    keys, owners = [], []
    for kind, has in ((1, count < FULL), (2, count >= DIVIDED)):
        at = np.flatnonzero(has)
        if not len(at):
            continue
        if kind == 1:
            own, mine = n[at], h[np.repeat(has, n)]
            if (own >= FULL).any():  # much repeated: each shingle once
                ends = np.cumsum(own).tolist()
                sets = [mine[e - k : e] if k < FULL else np.unique(mine[e - k : e]) for e, k in zip(ends, own.tolist(), strict=True)]
                own, mine = np.array([len(x) for x in sets]), np.concatenate(sets)
            sig = _per_function(mine, np.cumsum(own) - own)
        else:
            sig = binned[has[long]]
        banded = _mixed(sig.reshape(len(at), BANDS, ROWS).astype(np.uint64) @ _WEIGHTS + np.arange(kind * 1000, kind * 1000 + BANDS, dtype=np.uint64) * _MIX)
        keys.append(banded.ravel())
        owners.append(np.repeat(at, BANDS))
    return np.concatenate(keys), np.concatenate(owners)


def occurrences(docs: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, tie, line) of every line; a null doc_id is the least long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in steps(batches, "text"):
            doc, tie, no, h = [], [], [], []
            for d, k, t in zip(b.column("doc_id").to_pylist(), b.column("tie").to_pylist(), texts_of(b), strict=True):
                for i, s in lines_of(t):
                    doc.append(d)
                    tie.append(k)
                    no.append(i)
                    h.append(xxhash.xxh128_digest(s.encode("utf-8", "surrogatepass")))
            both = np.frombuffer(b"".join(h), ">i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64)), pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(no, pa.int32())], ["h1", "h2", "doc_id", "tie", "line"])

    return docs.select(*identity("doc_id", "tie"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long, tie long, line int")


def identity(doc: str, tie: str) -> list[Column]:
    """What tells documents apart, under these names."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(doc), F.xxhash64("text").alias(tie)]


def _distinct_lines(texts: list[str]) -> tuple[list[str], np.ndarray]:
    lines = list({s for t in texts for _, s in lines_of(t)})
    digests = b"".join(xxhash.xxh128_digest(s.encode("utf-8", "surrogatepass")) for s in lines)
    return lines, np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """(lead, gid, h1): lines (by the first half of their hash) that share a band's key, each set of lines once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            key, own = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, key, own = bucket[order], key[order], own[order]
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(at[1:], len(bucket))
            short = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]  # 40 bits beside those of the bucket
            rows = [short[s:e].tobytes() + own[s:e].astype("<i8").tobytes() for s, e in zip(at.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(rows, pa.binary())], ["bucket", "payload"])

        for b in steps(batches, "text", STEP):
            lines, h = _distinct_lines(texts_of(b))
            for s, e in runs([len(x) for x in lines]):
                key, owner = band_keys(lines[s:e])
                held.append((key, h[s:e][owner, 0]))
            if sum(len(k) for k, _ in held) > PACKED_KEYS:
                yield packed()
        if held:
            yield packed()
        trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held = [x for b in batches for x in b.column("payload").to_pylist()]
        if not held:
            return
        key = np.zeros((sum(len(x) // 13 for x in held), 8), np.uint8)
        own, at = np.empty(len(key), np.int64), 0
        while held:
            x = held.pop()
            n = len(x) // 13
            key[at : at + n, :5] = np.frombuffer(x, np.uint8, 5 * n).reshape(n, 5)
            own[at : at + n] = np.frombuffer(x, "<i8", n, 5 * n)
            at += n
        k = key.view("<u8").ravel()
        order = np.lexsort((own, k))
        k, own = k[order], own[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (own[1:] != own[:-1])
        k, own = k[new], own[new]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        sizes = np.diff(np.append(starts, len(k)))
        many = sizes > 1
        if not many.any():
            return
        starts, sizes = starts[many], sizes[many]
        rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        member = own[rows]
        # a set of lines is known by a sum of its mixed hashes
        total = np.add.reduceat(_mixed(member.view(np.uint64)), np.cumsum(sizes) - sizes)
        gid = _mixed(total + sizes.astype(np.uint64)).view(np.int64)
        last = np.sort(np.unique(gid, return_index=True)[1])
        keep = np.isin(np.repeat(np.arange(len(sizes)), sizes), last)
        # a line leads at most a group for each of its bands, so groups of one leader meet in one task
        lead = np.minimum.reduceat(member, np.cumsum(sizes) - sizes)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c, sizes)[keep]) for c in (lead, gid)), pa.array(member[keep])], ["lead", "gid", "h1"])

    packed = docs.select("text").mapInArrow(pack, "bucket int, payload binary")
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(meet, "lead long, gid long, h1 long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, text) of lines whose h1 is wanted, each once."""
    spark = docs.sparkSession
    few = None
    if wanted.count() <= FILTER_LINES:
        rows = np.fromiter((r[0] for r in wanted.toLocalIterator()), np.int64)
        few = spark.sparkContext.broadcast(np.sort(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        met: set[int] = set()
        for b in steps(batches, "text"):
            lines, h = _distinct_lines(texts_of(b))
            if not lines:
                continue
            at = np.arange(len(lines))
            if few is not None:
                if not len(few.value):
                    continue
                near = np.minimum(np.searchsorted(few.value, h[:, 0]), len(few.value) - 1)
                at = at[few.value[near] == h[:, 0]]
                # each wanted line once a task; no more of them than the filter holds
                new = [i for i, k in zip(at.tolist(), h[at, 1].tolist(), strict=True) if k not in met]
                met.update(h[new, 1].tolist())
                at = np.array(new, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[at, 0]), pa.array(h[at, 1]), pa.array([lines[i] for i in at], pa.string())], ["h1", "h2", "text"])

    out = docs.select("text").mapInArrow(run, "h1 long, h2 long, text string").dropDuplicates(["h1", "h2"])
    return out if few is not None else out.join(wanted, "h1", "left_semi")


class Judge:
    """Similarity of lines by the hashes of their shingles, near the threshold by the shingles themselves; what was
    found stays known until the next leader."""

    def __init__(self):
        self.lead, self.found, self.hashes, self.kept = None, {}, {}, 0

    def begin(self, lead: object) -> None:
        if lead != self.lead:
            self.lead, self.found = lead, {}

    def learn(self, lines: list[str]) -> None:
        """Hash the lines that aren't at hand, many at once."""
        new = [x for x in dict.fromkeys(lines) if x not in self.hashes]
        for s, e in runs([len(x) for x in new]):
            h, line = _shingle_hashes(new[s:e])
            ends = np.cumsum(np.bincount(line, minlength=e - s)).tolist()
            if self.kept + len(h) > KEPT_SHINGLES:
                self.hashes, self.kept = {}, 0
            self.kept += len(h)
            for i, x in enumerate(new[s:e]):
                self.hashes[x] = np.unique(h[ends[i - 1] if i else 0 : ends[i]])

    def of(self, line: str) -> np.ndarray:
        if line not in self.hashes:
            self.learn([line])
        return self.hashes[line]

    def similar(self, a: str, b: str) -> bool:
        if (a, b) not in self.found:
            if len(self.found) > 1 << 16:
                self.found.clear()
            x, y = self.of(a), self.of(b)
            least = SIMILARITY * max(len(x), len(y))
            if min(len(x), len(y)) + 4 < least:
                got = False
            else:
                both = np.concatenate([x, y])
                both.sort()
                n = int(np.count_nonzero(both[1:] == both[:-1]))
                over = n - SIMILARITY * (len(x) + len(y) - n)
                got = similar(shingles(a), shingles(b)) if abs(over) <= 4 else over > 0
            self.found[a, b] = got
        return self.found[a, b]


def verify(lines: list[str], judge: Judge) -> list[int]:
    """Of a group of distinct lines, the first line that each is connected to; two lines that are connected already
    need no comparison."""
    n = len(lines)
    root = list(range(n))
    for i in range(n - 1):
        for j in range(i + 1, n):
            a, b = root[i], root[j]
            if a != b and judge.similar(lines[i], lines[j]):
                low, high = min(a, b), max(a, b)
                root = [low if r == high else r for r in root] if n > 2 else [0, 0]
        if not any(root):
            break
    return root


def _group(row: dict) -> tuple:
    return row["gid"], row["i"], row["j"]


def runs(sizes: list[int], limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to about the limit; a larger item is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > (limit or BLOCK_CHARS):
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def _linked(rows: list[dict], judge: Judge) -> pa.RecordBatch:
    """Edges of a run of whole groups."""
    starts = [i for i, r in enumerate(rows) if not i or _group(r) != _group(rows[i - 1])]
    bounds = [*starts, len(rows)]
    edges: list[tuple[int, int]] = []
    for s, e in runs([sum(len(r["text"]) for r in rows[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]):
        judge.learn([r["text"] for r in rows[bounds[s] : bounds[e]]])
        for at, end in zip(bounds[s:e], bounds[s + 1 : e + 1], strict=True):
            judge.begin(rows[at]["lead"])
            edges += [(at + i, at + k) for i, k in enumerate(verify([r["text"] for r in rows[at:end]], judge)) if i != k]
    node = lambda r: {"h1": r["h1"], "h2": r["h2"]}
    return pa.RecordBatch.from_pylist([{"a": node(rows[i]), "b": node(rows[k])} for i, k in edges], schema=_EDGE)


def links(docs: DataFrame, n_lines: int = 0) -> DataFrame:
    """Edges (a, b) between distinct lines, known as struct<h1, h2>, of exact similarity 0.8 or more."""
    spark = docs.sparkSession
    buckets = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines * LINE_BYTES // BUCKET_BYTES))
    groups = materialize(candidates(docs, buckets), "line-groups")
    texts = materialize(_texts(docs, groups.select("h1").distinct()), "line-texts")
    sizes = groups.groupBy("gid").agg(F.count("*").alias("n")).where(F.col("n") > APART_LINES)
    sizes = materialize(sizes.select("gid", F.ceil(F.col("n") / F.lit(TILE_LINES)).cast("int").alias("t")), "line-sizes")
    member = groups.join(texts, "h1").join(sizes, "gid", "left")
    member = member.withColumn("apart", F.when(F.col("t").isNotNull(), F.pmod("gid", F.lit(APART))).otherwise(0).cast("int")).withColumn("t", F.coalesce("t", F.lit(1)))
    own = F.pmod(F.col("h1"), F.col("t")).cast("int")
    tiled = member.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select(
        "lead", "apart", "gid", F.least(own, F.col("o")).alias("i"), F.greatest(own, F.col("o")).alias("j"), "h1", "h2", "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[dict] = []
        judge = Judge()
        for b in batches:
            held += b.to_pylist()
            if len(held) >= BLOCK_LINES:
                last = _group(held[-1])
                n = next((i for i in range(len(held) - 1, -1, -1) if _group(held[i]) != last), -1) + 1
                if n:  # the last group may go on
                    yield _linked(held[:n], judge)
                    held = held[n:]
        if held:
            yield _linked(held, judge)
            del held, judge
        trim()

    dealt = tiled.repartition("lead", "apart", "i", "j").sortWithinPartitions("lead", "apart", "gid", "i", "j", "text")
    return dealt.mapInArrow(run, "a struct<h1: long, h2: long>, b struct<h1: long, h2: long>")


_NODE = pa.struct([("h1", pa.int64()), ("h2", pa.int64())])
_EDGE = pa.schema([("a", _NODE), ("b", _NODE)])


def removed_lines(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(doc_id, tie, line) of every line that an earlier line of its component stands for.

    Earlier is by (doc_id, hash of the text, line number), a null doc_id first (as the least long).  Blank lines are no
    lines and are never removed; null texts have none.  Rows that are equal in id and text are one document and lose the
    same lines; rows that share the id only are documents of their own.  An empty table gives nothing.
    """
    seen = materialize(occurrences(docs), "lines") if seen is None else seen
    ref = F.struct("doc_id", "tie", "line")
    reps = materialize(seen.groupBy("h1", "h2").agg(F.min(ref).alias("ref"), F.max(ref).alias("last")), "line-reps")
    parts = components(links(docs, seen.count())).select("component", F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"))
    parts = parts.join(reps.select("h1", "h2", "ref"), ["h1", "h2"])
    parts = materialize(parts, "line-parts")
    first = materialize(parts.groupBy("component").agg(F.min("ref").alias("first")), "line-first")
    fuzzy = materialize(parts.join(first, "component").select("h1", "h2", "first"), "line-fuzzy")
    # what has one occurrence and no similar line is kept and needs no join
    keep = reps.join(fuzzy, ["h1", "h2"], "left").where("first IS NOT NULL OR ref <> last").select("h1", "h2", F.coalesce("first", "ref").alias("keep"))
    keep = materialize(keep, "line-keep")
    return seen.join(keep, ["h1", "h2"]).where(ref != F.col("keep")).select("doc_id", "tie", "line").distinct()


def _per_document(docs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(doc_id, tie, gone) of the documents that lose lines."""
    return materialize(removed_lines(docs, seen).groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list("line")).alias("gone")), "line-gone")


def op7_fuzzy_lines(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines, ascending; cases as in ``removed_lines``."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = materialize(occurrences(docs), "lines")
    gone = _per_document(docs, seen)
    lines = seen.groupBy("doc_id", "tie").agg(F.countDistinct("line").alias("n"))
    ids = docs.select(*identity("doc_id", "tie"))
    none = F.array().cast("array<int>")
    return ids.join(lines, ["doc_id", "tie"], "left").join(gone, ["doc_id", "tie"], "left").select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.coalesce("gone", none).cast("array<string>"), ",").alias("removed_lines"),
    )


def without_lines(text: str, gone: list[int]) -> str:
    out = set(gone)
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)


def lines_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their removed lines; n_chars follows (where it is a whole number), and a document that loses
    every line goes.  Null and blank texts stay as they are; columns whose names clash with its own pass through; else cases as in ``removed_lines``."""
    names = docs.columns
    doc, tie, lost = (fresh(names, x) for x in ("line_doc", "line_tie", "line_gone"))
    gone = _per_document(docs).toDF(doc, tie, lost)
    joined = docs.select(*columns(docs), *identity(doc, tie)).join(gone, [doc, tie], "left").select(*columns(docs), lost)
    counted = "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            gone, texts, keep = b.column(lost).to_pylist(), b.column("text").to_pylist(), []
            for i, g in enumerate(gone):
                if g:
                    texts[i] = without_lines(texts[i], g)
                keep.append(not g or bool(texts[i].strip(SPACES)))
            cols = {c: b.column(c) for c in names}
            cols["text"] = pa.array(texts, pa.string())
            if counted:
                own = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([len(t) if g else n for t, g, n in zip(texts, gone, own, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)
