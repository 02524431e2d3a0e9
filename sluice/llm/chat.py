"""Preference formatting: one shared prompt and two masked completions per pair of conversations.

DataFrame functions only.  The longest common prefix of turns of a chosen and a rejected conversation is rendered
once as the prompt; what follows it on each side is a completion, cut into segments that carry a loss flag (true
for what an assistant says, with its closing mark; false for headers and for other roles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLES = ("assistant",)


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): turns in order of (turn, role, text).

    Null roles and texts count as empty, a null turn number sorts first, repeated rows stay, rows with a null id
    form no conversation.  One output row holds one conversation, as the formatted result has to.
    """
    t = F.struct(
        F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    return turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(t)).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    n = F.least(F.size(a), F.size(b))
    differs = lambda i: (i == n) | (F.get(a, i)["role"] != F.get(b, i)["role"]) | (F.get(a, i)["text"] != F.get(b, i)["text"])
    return F.array_min(F.filter(F.sequence(F.lit(0), n), differs))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def segments(turns: Column, trained_roles: tuple[str, ...] = TRAINED_ROLES) -> Column:
    """array<struct<text, train>>; the texts concatenated are the rendering."""
    part = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    turn = lambda t: F.array(
        part(F.concat(F.lit(OPEN), t["role"], F.lit("\n")), F.lit(False)),
        part(F.concat(t["text"], F.lit(CLOSE)), t["role"].isin(*trained_roles)),
        part(F.lit("\n"), F.lit(False)),
    )
    return F.flatten(F.transform(turns, turn))


def format_preferences(turns: DataFrame, pairs: DataFrame, *, trained_roles: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """pairs(pair_id, chosen_id, rejected_id) -> pair_id, chosen_id, rejected_id, n_common, prompt, and per side its
    completion segments.

    A side without turns is an empty conversation, so its partner has no common prefix.  Equal conversations give
    two empty completions.  Repeated pairs give repeated rows; an empty table gives an empty result.  Columns of
    ``pairs`` and ``turns`` beyond those named are ignored.
    """
    conv = conversations(turns)
    side = lambda name: conv.select(F.col("id").alias(f"{name}_id"), F.col("turns").alias(name))
    none = F.array().cast(conv.schema["turns"].dataType)
    both = (
        pairs.select("pair_id", "chosen_id", "rejected_id")
        .join(side("chosen"), "chosen_id", "left")
        .join(side("rejected"), "rejected_id", "left")
        .withColumns({"chosen": F.coalesce("chosen", none), "rejected": F.coalesce("rejected", none)})
        .withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))
    )
    rest = lambda name: F.slice(F.col(name), F.col("n_common") + 1, F.size(name) - F.col("n_common"))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        render(F.slice(F.col("chosen"), F.lit(1), F.col("n_common"))).alias("prompt"),
        segments(rest("chosen"), trained_roles).alias("chosen_segments"),
        segments(rest("rejected"), trained_roles).alias("rejected_segments"),
    )


def adjacent_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Every conversation 2k as chosen with 2k+1 as rejected; a pair exists where either has a turn."""
    k = F.floor(F.col(id_col) / 2).cast("long")
    return (
        turns.where(F.col(id_col).isNotNull())
        .select(k.alias("pair_id"))
        .distinct()
        .select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))
    )


def completion_text(seg: Column) -> Column:
    return F.array_join(F.transform(seg, lambda s: s["text"]), "")


def mask_text(seg: Column) -> Column:
    """'length:flag' of each segment, comma-joined."""
    return F.array_join(F.transform(seg, lambda s: F.concat(F.length(s["text"]).cast("string"), F.lit(":"), s["train"].cast("int").cast("string"))), ",")


def op4_preference_pairs(spark, sf_dir: str) -> DataFrame:
    from sluice.llm.common import read

    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_preferences(turns, adjacent_pairs(turns))
    return out.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n_common").cast("long").alias("n_common"),
        "prompt",
        completion_text(F.col("chosen_segments")).alias("chosen"),
        completion_text(F.col("rejected_segments")).alias("rejected"),
        mask_text(F.col("chosen_segments")).alias("chosen_mask"),
        mask_text(F.col("rejected_segments")).alias("rejected_mask"),
    )


_SEGMENTS = """flatten(list_transform({0}, lambda t: [
    {{'text': '<|im_start|>' || t.role || chr(10), 'train': 0}},
    {{'text': t.text || '<|im_end|>', 'train': CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END}},
    {{'text': chr(10), 'train': 0}}]))"""

ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id
), p AS (
  SELECT DISTINCT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id FROM t
), b AS (
  SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id,
         coalesce(c.turns, []) AS c, coalesce(r.turns, []) AS r
  FROM p LEFT JOIN conv c ON c.conv_id = pair_id * 2 LEFT JOIN conv r ON r.conv_id = pair_id * 2 + 1
), n AS (
  SELECT *, CAST(list_min(list_filter(range(0, least(len(c), len(r)) + 1),
    lambda i: i = least(len(c), len(r)) OR c[i + 1].role <> r[i + 1].role OR c[i + 1].text <> r[i + 1].text)) AS BIGINT) AS n_common
  FROM b
), s AS (
  SELECT pair_id, chosen_id, rejected_id, n_common,
    array_to_string(list_transform(c[1:n_common], lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS prompt,
    {_SEGMENTS.format("c[n_common + 1:]")} AS cs,
    {_SEGMENTS.format("r[n_common + 1:]")} AS rs
  FROM n
)
SELECT pair_id, chosen_id, rejected_id, n_common, prompt,
  array_to_string(list_transform(cs, lambda s: s.text), '') AS chosen,
  array_to_string(list_transform(rs, lambda s: s.text), '') AS rejected,
  array_to_string(list_transform(cs, lambda s: length(s.text) || ':' || s.train), ',') AS chosen_mask,
  array_to_string(list_transform(rs, lambda s: length(s.text) || ':' || s.train), ',') AS rejected_mask
FROM s
"""
