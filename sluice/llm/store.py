"""Files that tasks write into the shared folder: temporary names, a manifest, then final names.

A task writes each file under a name of its own attempt and reports it in its result rows.  The rows, written once
as a table, say which attempt counts; a second job gives those files their final names (again and again without
harm), and the manifest table, which Spark commits whole, is written last.  What a lost executor or a second attempt
leaves under ``_temporary`` is in no manifest and goes at the end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from sluice.llm.common import drop_table, materialize

MANIFEST = "name string, temp string, shard int, seq int, bytes long, sha256 string, records long"
ARROW = pa.schema(
    [("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("bytes", pa.int64()), ("sha256", pa.string()), ("records", pa.int64())]
)


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Attempt:
    """The files of one task attempt."""

    def __init__(self, out: str):
        self.fs, self.root = place(out)
        self.dir = f"_temporary/{uuid.uuid4().hex}"
        self.made = False

    def write(self, name: str, data: bytes, shard: int, seq: int, records: int) -> dict:
        if not self.made:
            self.fs.create_dir(f"{self.root}/{self.dir}", recursive=True)
            self.made = True
        temp = f"{self.dir}/{name}"
        with self.fs.open_output_stream(f"{self.root}/{temp}") as f:
            f.write(data)
        return {"name": name, "temp": temp, "shard": shard, "seq": seq, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest(), "records": records}


def manifest_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ARROW)


def commit(written: DataFrame, out: str) -> DataFrame:
    """Run the writing job behind ``written`` once, name its files finally and return the manifest."""
    spark = written.sparkSession
    rows = materialize(written, "written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = place(out)
        for b in batches:
            for r in b.to_pylist():
                if fs.get_file_info(f"{root}/{r['temp']}").type == pafs.FileType.File:
                    fs.create_dir(root, recursive=True)
                    fs.move(f"{root}/{r['temp']}", f"{root}/{r['name']}")
            yield b.select(["name"])

    rows.mapInArrow(rename, "name string").count()
    rows.drop("temp").write.mode("overwrite").parquet(f"{out}/manifest")
    fs, root = place(out)
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    drop_table(rows)
    return read_manifest(spark, out)


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/manifest")


def spread(manifest: DataFrame) -> DataFrame:
    """The manifest dealt over tasks, a file each as far as there are tasks."""
    spark = manifest.sparkSession
    files = manifest.count()
    most = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(max(1, min(files, most)))


def load(out: str, name: str, sha256: str | None = None) -> bytes:
    fs, root = place(out)
    with fs.open_input_stream(f"{root}/{name}") as f:
        data = f.read()
    if sha256 and hashlib.sha256(data).hexdigest() != sha256:
        raise OSError(f"{name}: its digest is not the manifest's")
    return data
