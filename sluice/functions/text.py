"""Text identity functions as column expressions: tokens, words, sample texts, fingerprints, shingles, entropy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from math import log2

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's word class, spelled so that Java and RE2 agree on accented text.
WORD = r"[\p{L}\p{N}_]"
WORD_PATTERN = WORD + "+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression used inside a lambda is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space at either end, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def words(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), 0)


def sample_text(messages: Column, target: Column) -> Column:
    """Trimmed non-blank contents and target, one a line."""
    parts = F.concat(F.transform(messages, lambda m: m["content"]), F.array(target))
    return F.array_join(F.filter(F.transform(parts, lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n")


def joined_text(messages: Column, target: Column) -> Column:
    """All contents and the target joined by a space; what the cheap heuristics read."""
    return F.array_join(F.concat(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), F.array(F.coalesce(target, F.lit("")))), " ")


def response_text(messages: Column, target: Column) -> Column:
    """The last non-blank assistant message, else the target, else empty."""
    said = F.filter(messages, lambda m: (m["role"] == "assistant") & (strip(F.coalesce(m["content"], F.lit(""))) != ""))
    return F.coalesce(F.when(F.size(said) > 0, F.element_at(said, -1)["content"]), target, F.lit(""))


def sample_tokens(messages: Column, target: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + token_count(m["content"])) + token_count(target)


def normalized_key(text: Column) -> Column:
    """Digest of the lower-case tokens: equal for texts that differ in case and spacing only.

    Tokens hold no whitespace, so joining them by a space keeps unlike token lists apart.
    """
    return F.md5(F.array_join(tokens(F.lower(text)), " "))


def shingles(text: Column, n: int) -> Column:
    """Distinct lower-case token n-grams; a shorter text is one gram, a text without tokens has none."""
    def grams(t: Column) -> Column:
        last = F.greatest(F.size(t) - n, F.lit(0))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), " ")))
        )

    return let(tokens(F.lower(text)), grams)


def unigram_entropy(text: Column) -> Column:
    """Entropy in bits of the word distribution, rounded to 9 places so that ties stay ties; 0 without words.

    Words are found in the JVM and counted in Arrow batches, a text at a time: nothing is exploded or shuffled.
    """

    @F.pandas_udf("double")
    def entropy(joined: pd.Series) -> pd.Series:
        def one(words: str) -> float:
            often = Counter(words.split(" ")).values() if words else ()
            n = sum(often)
            return log2(n) - sum(c * log2(c) for c in often if c > 1) / n if n else 0.0

        return joined.map(one).astype("float64")

    return F.round(entropy(F.array_join(words(text), " ")), 9)


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """Compact JSON object with keys in order and nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields, key=lambda f: f[0]))), {"ignoreNullFields": "false"})


def stable_md5(*fields: tuple[str, Column]) -> Column:
    return F.md5(canonical_json(*fields))


def join_non_empty(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n")
