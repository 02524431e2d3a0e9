"""Readers, converters and writers of records; all of them plans over columns."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import join_non_empty, sample_text, stable_md5
from sluice.sources.schema import CANONICAL, ROLES, message, split_name

#: Keys of ``extra`` that writers leave out as too large, and those that are numeric annotations.
HEAVY_KEYS = ("feature", "embedding", "activations", "hidden_states", "sae_features", "representations")
NUMERIC_KEYS = ("sae_topk", "ifd", "varentropy", "ngram_entropy", "action_object", "mona_score", "mona_scores", "similarities")
LONGEST_LIST = 256


def read_canonical(spark: SparkSession, *paths: str) -> DataFrame:
    """Canonical JSONL by explicit schema; blank lines are skipped, missing fields get their defaults.

    A line's id may be called ``id`` and its source ``dataset``.
    """
    schema = T.StructType([*CANONICAL.fields, T.StructField("id", T.StringType()), T.StructField("dataset", T.StringType())])
    raw = spark.read.schema(schema).json(list(paths))
    md = F.col("metadata")
    return raw.select(
        F.coalesce("sample_id", "id", F.lit("unknown_id")).alias("sample_id"),
        F.coalesce("source_name", "dataset", F.lit("unknown_source")).alias("source_name"),
        F.coalesce("messages", F.array().cast(CANONICAL["messages"].dataType)).alias("messages"),
        "target",
        md.withField("source_split", split_name(md["source_split"])).alias("metadata"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("canonical_version", F.lit("v1")).alias("canonical_version"),
        "raw_fingerprint",
        "provenance",
    )


def validate(df: DataFrame) -> DataFrame:
    """(sample_id, errors): records whose fields break a rule."""
    rules = [
        (F.coalesce(F.col("sample_id"), F.lit("")) == "", "no sample_id"),
        (F.coalesce(F.size("messages"), F.lit(0)) <= 0, "no messages"),
        (F.exists("messages", lambda m: ~F.coalesce(m["role"].isin(*ROLES), F.lit(False))), "unknown role"),
        (F.exists("messages", lambda m: m["content"].isNull()), "message without content"),
    ]
    errors = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(e)) for c, e in rules)), lambda e: e.isNotNull())
    return df.select("sample_id", errors.alias("errors")).where(F.size("errors") > 0)


def _record(sample_id: Column, source: str, messages: Column, target: Column, converter: str, raw_format: str) -> list[Column]:
    turns = F.size(messages) + F.when(target.isNotNull(), 1).otherwise(0)
    return [
        sample_id.alias("sample_id"),
        F.lit(source).alias("source_name"),
        messages.alias("messages"),
        target.alias("target_text"),
        (turns > 2).alias("has_multiturn"),
        F.exists(messages, lambda m: m["role"] == "system").alias("has_system_prompt"),
        F.lit(raw_format).alias("raw_format"),
        F.lit(converter).alias("converter_name"),
        F.lit("v1").alias("converter_version"),
    ]


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def from_alpaca(df: DataFrame, source: str) -> DataFrame:
    """instruction, input, output, id? -> one user turn of instruction and input, the output as target."""
    ins, inp, out = (F.coalesce(_column(df, c), F.lit("")) for c in ("instruction", "input", "output"))
    key = stable_md5(("source", F.lit(source)), ("instruction", ins), ("input", inp), ("output", out))
    return df.select(*_record(F.coalesce(_column(df, "id").cast("string"), key), source, F.array(message(F.lit("user"), join_non_empty(ins, inp))), out, "alpaca", "alpaca"))


#: Speakers of a shared conversation and their roles.
SPEAKERS = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system", "tool": "tool", "observation": "tool"}


def from_sharegpt(df: DataFrame, source: str) -> DataFrame:
    """conversations[{from, value}], id?, target? -> turns of known speakers; the last one is the target unless given.

    A single turn stays a message and has no target.
    """
    role = F.create_map(*(F.lit(x) for kv in SPEAKERS.items() for x in kv))
    known = F.filter("conversations", lambda t: F.coalesce(t["from"].isin(*SPEAKERS), F.lit(False)))
    turns = F.transform(known, lambda t: message(role[t["from"]], F.coalesce(t["value"], F.lit(""))))
    given = _column(df, "target")
    cut = given.isNull() & (F.size(turns) > 1)
    said = F.when(cut, F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)
    target = F.when(cut, F.try_element_at(turns, F.lit(-1))["content"]).otherwise(given)
    key = stable_md5(("source", F.lit(source)), ("conversations", F.to_json("conversations")))
    return df.select(*_record(F.coalesce(_column(df, "id").cast("string"), key), source, said, target, "sharegpt", "sharegpt"))


def from_openai_chat(df: DataFrame, source: str) -> DataFrame:
    """messages[{role, content, name?...}], prompt?, id? -> the last message is the target; other keys are metadata."""
    have = [f.name for f in df.schema["messages"].dataType.elementType.fields]
    own = {"role", "content", "name", "tool_call_id"}

    def one(m: Column) -> Column:
        get = lambda k: m[k].cast("string") if k in have else F.lit(None).cast("string")
        rest = [x for k in have if k not in own for x in (F.lit(k), m[k].cast("string"))]
        metadata = F.map_filter(F.create_map(*rest), lambda _, v: v.isNotNull()) if rest else F.lit(None).cast("map<string,string>")
        return F.struct(get("role").alias("role"), F.coalesce(get("content"), F.lit("")).alias("content"), get("name").alias("tool_name"), get("tool_call_id").alias("tool_call_id"), metadata.alias("metadata"))

    turns = F.transform("messages", one)
    prompt = _column(df, "prompt")
    turns = F.concat(F.when(prompt.isNotNull(), F.array(message(F.lit("user"), prompt))).otherwise(F.array().cast(CANONICAL["messages"].dataType)), turns)
    key = stable_md5(("source", F.lit(source)), ("messages", F.to_json("messages")))
    out = _record(F.coalesce(_column(df, "id").cast("string"), key), source, F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0))), F.try_element_at(turns, F.lit(-1))["content"], "openai_chat", "openai_chat")
    return df.where(F.size("messages") > 0).select(*out)


def from_mapping(df: DataFrame, source: str, mapping: Callable[[DataFrame], dict[str, Column]]) -> DataFrame:
    """Records by a supplied mapping of raw fields: columns sample_id, messages and target_text."""
    m = mapping(df)
    return df.select(*_record(m["sample_id"], source, m["messages"], m.get("target_text", F.lit(None).cast("string")), "mapping", "auto"))


def normalized(df: DataFrame, source: str) -> DataFrame:
    """Records that are canonical already keep their fields; the source fills in where it is missing."""
    return df.withColumn("source_name", F.coalesce("source_name", F.lit(source)))


CONVERTERS = {"alpaca": from_alpaca, "sharegpt": from_sharegpt, "openai_chat": from_openai_chat, "normalized": normalized}


def to_sharegpt(df: DataFrame) -> DataFrame:
    """(sample_id, conversations[{from, value}]): tool turns go, neighbours of one role are joined by a line end, the
    target is the last answer; conversations of fewer than two turns are left out."""
    speaker = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"), F.lit("system"), F.lit("system"))
    turn = lambda who, what: F.struct(who.alias("from"), what.alias("value"))
    said = F.transform(F.filter("messages", lambda m: m["role"].isin("user", "assistant", "system")), lambda m: turn(speaker[m["role"]], F.coalesce(m["content"], F.lit(""))))
    target = F.when(F.coalesce(F.col("target_text"), F.lit("")) != "", F.array(turn(F.lit("gpt"), F.col("target_text")))).otherwise(F.array().cast("array<struct<from:string,value:string>>"))
    kind = "array<struct<from:string,value:string>>"
    merged = F.aggregate(
        F.concat(said, target).cast(kind),
        F.array().cast(kind),
        lambda a, t: F.when(
            (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["from"] == t["from"]),
            F.concat(
                F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(turn(t["from"], F.concat(F.try_element_at(a, F.lit(-1))["value"], F.lit("\n"), t["value"]))),
            ).cast(kind),
        ).otherwise(F.concat(a, F.array(t)).cast(kind)),
    )
    return df.select("sample_id", merged.alias("conversations")).where(F.size("conversations") >= 2)


def text_only(df: DataFrame, extra: str = "extra") -> DataFrame:
    """The pool without numeric annotations, as columns or as keys of ``extra`` (JSON text or a map); what else is there
    stays."""
    return without_keys(df.drop(*NUMERIC_KEYS), NUMERIC_KEYS, extra)


def without_keys(df: DataFrame, keys: tuple[str, ...], extra: str = "extra", longest: int | None = None) -> DataFrame:
    """``extra`` without the keys and, if ``longest`` is given, without lists of more items than that.

    JSON text is parsed in Arrow batches: the JVM's functions can't drop a key and leave the types of the others alone.
    Text that is no JSON object, and objects without such a key, stay as they are.
    """
    if extra not in df.columns:
        return df
    if isinstance(df.schema[extra].dataType, T.MapType):
        return df.withColumn(extra, F.map_filter(extra, lambda k, _: ~k.isin(*keys)))

    @F.pandas_udf("string")
    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(_kept, na_action="ignore")

    def _kept(text: str) -> str:
        try:
            whole = json.loads(text)
        except ValueError:
            return text
        if not isinstance(whole, dict):
            return text
        out = {k: v for k, v in whole.items() if k not in keys and not (longest is not None and isinstance(v, list) and len(v) > longest)}
        return text if len(out) == len(whole) else json.dumps(out, ensure_ascii=False)

    return df.withColumn(extra, kept(extra))


def write_records(df: DataFrame, path: str) -> None:
    """JSONL without heavy keys, as columns or in ``extra``; arrays of numbers (in ``extra`` any lists) longer than 256
    go as well."""
    keep = [c for c in df.columns if c not in HEAVY_KEYS]
    out = without_keys(df.select(*keep), HEAVY_KEYS, longest=LONGEST_LIST)
    for f in out.schema.fields:
        if f.dataType.simpleString() in ("array<float>", "array<double>", "array<int>", "array<bigint>"):
            out = out.withColumn(f.name, F.when(F.size(f.name) <= LONGEST_LIST, F.col(f.name)))
    out.write.mode("overwrite").json(path)


def scored(df: DataFrame) -> DataFrame:
    """Records with their text and scores, messages without content left out."""
    kept = F.filter("messages", lambda m: F.coalesce(m["content"], F.lit("")) != "")
    return df.withColumn("text", sample_text(F.col("messages"), F.col("target_text"))).withColumn("messages", kept)


def write_scored(df: DataFrame, path: str) -> None:
    scored(df).write.mode("overwrite").json(path)


def materialize_ids(pool: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the pool that a subset names, in the pool's order; the subset is a set."""
    return pool.join(ids.select("sample_id"), "sample_id", "left_semi")


def restore_features(pool: DataFrame, features: DataFrame) -> DataFrame:
    """Cached features joined to the pool by id; NaN stands for a missing value."""
    clean = [F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in features.schema.fields]
    return pool.join(features.select(*clean).dropDuplicates(["sample_id"]), "sample_id", "left")


def save_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)


def concatenated(spark: SparkSession, schema, *paths: str) -> DataFrame:
    """JSONL files read as one."""
    return spark.read.schema(schema).json(list(paths))


def merge_tagged(parts: dict[str, DataFrame]) -> DataFrame:
    """Evaluation sets as one, each row with the name of its set in data_source."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("data_source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def tagged(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("data_source") == name).drop("data_source")
