"""The corpus pipeline over ``documents``: each stage is written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import bpe, decontaminate, lines, quality, simhash
from sluice.llm.common import materialize, read

#: Quality rules drop what they reject; line dedup takes lines out of texts; one document of each near-duplicate group
#: stays; documents with benchmark items go; what is left is encoded.
STAGES = [
    ("quality rules", quality.quality_stage),
    ("line dedup", lines.lines_stage),
    ("near-duplicates", simhash.simhash_stage),
    ("decontamination", decontaminate.decontamination_stage),
    ("bpe encoding", bpe.bpe_stage),
]

#: None: fuzzy components, ranked retrieval and tokenizer output can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other; null ids, repeated ids, empty texts and empty tables are
    treated as each stage's docstring says, and no stage drops a row for them but by its rule."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
