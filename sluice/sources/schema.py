"""The canonical record: explicit schema, enumerations and fixture adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("role", "content", "tool_name", "tool_call_id")] + [T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)
TARGET = T.StructType([T.StructField("text", T.StringType()), T.StructField("structured", T.StringType())])
PROVENANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("raw_path", "raw_format", "raw_record_id", "converter_name", "converter_version")])
METADATA = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("task_type", "source_split", "language", "format_tag")),
        *(T.StructField(n, T.BooleanType()) for n in ("tool_use", "has_multiturn", "has_system_prompt")),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
        T.StructField("license", T.StringType()),
        T.StructField("extra", T.StringType()),
    ]
)
CANONICAL = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("target", TARGET),
        T.StructField("metadata", METADATA),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("canonical_version", T.StringType()),
        T.StructField("raw_fingerprint", T.StringType()),
        T.StructField("provenance", PROVENANCE),
    ]
)

ROLES = ("system", "user", "assistant", "tool")
TASK_TYPES = ("instruction", "chat", "qa", "reasoning", "code", "tool_use", "other")
SPLITS = ("train", "dev", "test", "unspecified")
#: Names that stand for a split.
SPLIT_ALIASES = {
    "training": "train",
    "validation": "dev",
    "valid": "dev",
    "val": "dev",
    "development": "dev",
    "testing": "test",
    "unknown": "unspecified",
    "": "unspecified",
}


def split_name(raw: Column) -> Column:
    """A split by any of its names, trimmed and in any case; an unknown name is an error."""
    s = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(s.isin(*SPLITS), s)
    for alias, name in SPLIT_ALIASES.items():
        out = out.when(s == alias, F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown split: "), s)).cast("string"))


def message(role: Column, content: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        role.alias("role"), content.alias("content"), none.alias("tool_name"), none.alias("tool_call_id"), F.lit(None).cast("map<string,string>").alias("metadata")
    )


def documents_pool(docs: DataFrame) -> DataFrame:
    """documents as a pool: (ord, sample_id, source_name, language, text).  doc_id is the order of the pool."""
    return docs.select(
        F.col("doc_id").cast("long").alias("ord"), F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("source_name"), F.col("lang").alias("language"), "text"
    )


def conversations_pool(turns: DataFrame) -> DataFrame:
    """conversations as canonical records: turns in order, the last one as target if an assistant says it."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    last = F.element_at("t", -1)
    has_target = last["role"] == "assistant"
    said = F.when(has_target, F.slice("t", 1, F.size("t") - 1)).otherwise(F.col("t"))
    return conv.select(
        F.col("conv_id").cast("long").alias("ord"),
        F.col("conv_id").cast("string").alias("sample_id"),
        F.lit("conversations").alias("source_name"),
        F.transform(said, lambda m: message(m["role"], m["text"])).alias("messages"),
        F.when(has_target, last["text"]).alias("target_text"),
        (F.size("t") > 2).alias("has_multiturn"),
        F.exists("t", lambda m: m["role"] == "system").alias("has_system_prompt"),
    )
