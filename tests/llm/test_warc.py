import base64
import gzip
import hashlib

import pytest

from sluice.llm import store, warc
from sluice.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, extra int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


ROWS = [
    (7, "http://a.example/x y", "<p>é</p>"),
    (3, "http://b.example/\r\nX: y", "<p>é</p>"),
    (5, None, None),
    (9, "", ""),
    (1, "http://c.example/", "long " * 50_000),
    (None, "http://d.example/", "<p>é</p>"),
    (3, "http://b.example/\r\nX: y", "<p>é</p>"),
    (11, "http://e.example/", "<p>é</p>"),
]


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        p = (html or "").encode()
        refers = first.get(html or "") if page is not None and len(p) >= least else None
        refers = refers if refers is not None and refers < page else None
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def read_back(spark, out):
    rows = warc.read_warc(spark, out).collect()
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str), rows


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    out = shared_path(spark, "warc")
    warc.write_warc(spark, table(spark, ROWS), out, min_revisit_bytes=least)
    got, rows = read_back(spark, out)
    assert got == expected(ROWS, least)
    text = {p: h or "" for p, _, h in ROWS}
    assert all(bytes(r.payload).decode() == text[r.page_id] for r in rows if r.record_type == "response")


def test_same_bytes_however_partitioned(spark):
    digests = []
    rows = [(i, f"http://x.example/{i}", f"page {i % 40} " * 200) for i in range(200)]
    for parts in (1, 5):
        out = shared_path(spark, "warc")
        m = warc.write_warc(spark, table(spark, rows).repartition(parts), out, shard_bytes=100_000, roll_bytes=3000)
        digests.append(sorted((r.name, r.sha256) for r in m.collect()))
        assert read_back(spark, out)[0] == expected(rows)
    assert digests[0] == digests[1] and len(digests[0]) > 4
    fs, root = store.place(out)
    assert fs.get_file_info(f"{root}/_temporary").type == store.pafs.FileType.NotFound
    name = digests[1][0][0]
    assert gzip.decompress(store.load(out, name)).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_nothing_and_damage(spark):
    out = shared_path(spark, "warc")
    assert warc.write_warc(spark, table(spark, []), out).count() == 0
    assert warc.read_warc(spark, out).count() == 0
    out = shared_path(spark, "warc")
    m = warc.write_warc(spark, table(spark, ROWS), out).first()
    fs, root = store.place(out)
    with fs.open_output_stream(f"{root}/{m.name}") as f:
        f.write(b"other")
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, out).collect()
