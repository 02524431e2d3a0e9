"""Deterministic sharded WARC files.

Records are range-sorted by page, each a gzip member of its own; files roll when their compressed size is reached;
headers and digests are made anew from the payload, so the same pages give the same bytes however they are
partitioned.  Files get temporary names, a manifest, then their final names (see ``store``).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import store
from sluice.llm.common import NULL_ID, materialize, range_shards, read, shared_path, steps

#: Raw bytes of pages that a shard is cut for, and the compressed size at which a file is closed.
SHARD_BYTES, ROLL_BYTES, LEVEL = 64 << 20, 16 << 20, 6
#: Payloads of fewer bytes are never revisited.
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes given to the decompressor at a time; what it leaves of them belongs to the next record.
_PIECE = 1 << 15
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(page_id: int | None, hexed: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {hexed}')}>"


def target(page_id: int | None, url: str | None) -> str:
    """A header's value can't hold control characters or line ends; a page without address gets one of its id."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{page_id}"


def member(headers: list[tuple[str, str]], block: bytes, level: int = LEVEL) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _common(kind: str, page_id: int | None, url: str | None, hexed: str, size: int) -> list[tuple[str, str]]:
    return [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id, hexed) if kind == "response" else f"<urn:uuid:{uuid.uuid5(_SPACE, f'revisit {page_id} {hexed}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target(page_id, url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(hexed)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Bytes", str(size)),
    ]


def response(page_id: int | None, url: str | None, payload: bytes, hexed: str, level: int = LEVEL) -> bytes:
    block = _HTTP.format(len(payload)).encode() + payload
    more = [("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block).hexdigest())}"), ("Content-Type", "application/http; msgtype=response")]
    return member([*_common("response", page_id, url, hexed, len(payload)), *more], block, level)


def revisit(page_id: int | None, url: str | None, hexed: str, size: int, refers_to: int, level: int = LEVEL) -> bytes:
    more = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(refers_to, hexed)), ("X-Refers-To-Page-Id", str(refers_to))]
    return member([*_common("revisit", page_id, url, hexed, size), *more], b"", level)


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a smaller page_id has.

    Only ids and digests move; the smallest page of a payload is found by a combined minimum, and the join back is
    between plain tables, so a payload with very many pages is split by the engine.
    """
    ids = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    ids = ids.where(F.col("n") >= min_bytes).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    return ids.join(materialize(first, "warc-first"), "digest").where("page_id > refers_to").distinct().select("page_id", "digest", "refers_to")


_ROWS = "shard int, page_id long, digest string, kind int, refers_to long, size long, url string, member binary"


def write_warc(
    spark: SparkSession, pages: DataFrame, out: str, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, level: int = LEVEL
) -> DataFrame:
    """Write pages(page_id, url, html) under ``out`` and return the manifest.

    A null html is an empty payload; a null page_id sorts first and is never revisited; rows of equal page_id and
    payload are equal records, those of unlike payloads are in order of digest; other columns are ignored; an empty table gives a manifest without files.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    sha1 = F.sha1(F.coalesce("html", F.lit("")))
    cuts = range_shards(pages, "page_id", F.coalesce(F.octet_length("html"), F.lit(0)) + 512, shard_bytes, F.conv(F.substring(sha1, 1, 15), 16, 10))

    def shards(ids: pa.Array, digests: list[str]) -> np.ndarray:
        keys = np.array([NULL_ID if x is None else x for x in ids.to_pylist()], np.int64)
        return cuts.of(keys, np.array([int(x[:15], 16) for x in digests], np.int64))  # in order of (page, digest)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "html"):
            digest, size, members = [], [], []
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                payload = (html or "").encode("utf-8", "replace")
                digest.append(hashlib.sha1(payload).hexdigest())
                size.append(len(payload))
                members.append(response(page, url, payload, digest[-1], level))
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards(b.column("page_id"), digest)), b.column("page_id"), pa.array(digest), pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(size, pa.int64()), b.column("url"), pa.array(members, pa.binary())],
                ["shard", "page_id", "digest", "kind", "refers_to", "size", "url", "member"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards(b.column("page_id"), b.column("digest").to_pylist())), b.column("page_id"), b.column("digest"), pa.array([0] * k, pa.int32()), b.column("refers_to"), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary())],
                ["shard", "page_id", "digest", "kind", "refers_to", "size", "url", "member"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, held, size, seq, count, shard = store.Attempt(out), [], 0, 0, 0, None
        info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{_SPACE}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
        later: tuple = ()
        done: list[dict] = []

        def close() -> None:
            nonlocal held, size, seq, count
            done.append(attempt.write(f"pages-{shard:06d}-{seq:06d}.warc.gz", b"".join([info, *held]), shard, seq, count))
            held, size, seq, count = [], 0, seq + 1, 0

        for b in batches:
            for r in b.to_pylist():
                shard = r["shard"]  # a partition is one shard
                if r["kind"] == 0:  # comes before the pages that it is about
                    later = (r["page_id"], r["digest"], r["refers_to"])
                    continue
                data = r["member"]
                if later[:2] == (r["page_id"], r["digest"]):
                    data = revisit(r["page_id"], r["url"], r["digest"], r["size"], later[2], level)
                held.append(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
        if held:
            close()
        if done:
            yield store.manifest_batch(done)

    rows = pages.mapInArrow(compress, _ROWS).unionByName(revisits(pages, min_revisit_bytes).mapInArrow(place, _ROWS))
    ordered = rows.repartitionById(cuts.n, F.col("shard")).sortWithinPartitions("page_id", "digest", "kind", "url")
    return store.commit(ordered.mapInArrow(write, store.MANIFEST), out)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each member of a file."""
    at, view = 0, memoryview(data)
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise OSError("a record ends too early")
            parts.append(z.decompress(view[at : at + _PIECE]))
            at += len(view[at : at + _PIECE]) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(spark: SparkSession, out: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to and (unless not asked for) payload of every
    record of the files in the manifest; a payload that doesn't have its digest is an error."""
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        for b in batches:
            for f in b.to_pylist():
                rows: list[tuple] = []
                held = 0

                def batch(rows: list[tuple]) -> pa.RecordBatch:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *([pa.binary()] * payloads)]
                    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] * payloads)]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

                for h, block in records(store.load(out, f["name"], f["sha256"])):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    digest, payload = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if base32_sha1(hashlib.sha1(payload).hexdigest()) != digest:
                            raise OSError(f"{f['name']}: a payload is damaged")
                    rows.append((number(h["X-Page-Id"]), h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Bytes"]), digest, number(h.get("X-Refers-To-Page-Id")), *([payload] * payloads)))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return store.spread(store.read_manifest(spark, out).select("name", "sha256")).mapInArrow(parse, schema)


def op8_warc_shards(spark, sf_dir: str) -> DataFrame:
    """The operator over ``pages``, with files under the shared folder; cases as in ``write_warc``."""
    out = shared_path(spark, "warc")
    write_warc(spark, read(spark, sf_dir, "pages"), out)
    return read_warc(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('{_ALPHABET}', CAST((('0x' || substr(h, CAST(1 + 5 * g AS INTEGER), 5))::INTEGER >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
