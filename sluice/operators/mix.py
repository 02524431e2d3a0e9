"""Mixes: a quota of rows per source."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.base import Context, Operator, ranked_within


def quotas(available: dict[str, int], weights: dict[str, float], total: int | None = None, oversample: bool = False) -> dict[str, int]:
    """Rows per source, in the order of ``weights``: whole shares first, what remains by largest remainder, then what a
    source lacks is dealt one by one to the others, the heaviest first."""
    weight = sum(weights.values())
    share = {s: w / weight for s, w in weights.items()}
    there = sum(available[s] for s in weights)
    total = there if total is None else int(total)
    if not oversample:
        total = min(total, there)
    out = {s: math.floor(total * share[s]) for s in weights}
    by_rest = sorted(weights, key=lambda s: -(total * share[s] - out[s]))
    for s in by_rest[: total - sum(out.values())]:
        out[s] += 1
    if oversample:
        return out
    out = {s: min(q, available[s]) for s, q in out.items()}
    missing = total - sum(out.values())
    heavy = sorted(weights, key=lambda s: -share[s])
    while missing > 0:
        room = [s for s in heavy if out[s] < available[s]][:missing]
        if not room:
            break
        for s in room:
            out[s] += 1
        missing -= len(room)
    return out


class SourceMix(Operator):
    """The first rows of each source up to its quota, source after source.

    Only counts per source reach the driver.  With shuffle_within_source the order within a source is that of the md5
    of seed and id, which is the same on every run; the seed is 0 unless given.
    """

    name = "source_mix"
    kind = "mix"
    defaults = {"source_weights": None, "total_samples": None, "shuffle_within_source": False, "seed": None, "allow_oversample": False}

    def weights(self, df: DataFrame, sources: list[str]) -> dict[str, float]:
        given = self.params["source_weights"] or {}
        return {s: float(w) for s, w in given.items() if s in sources} if given else dict.fromkeys(sources, 1.0)

    def apply(self, df: DataFrame, ctx: Context | None = None) -> DataFrame:
        p = self.params
        seen = df.groupBy("source_name").agg(F.count("*").alias("n"), F.min("ord").alias("first")).collect()  # a row per source
        seen.sort(key=lambda r: r["first"])
        available = {r["source_name"]: r["n"] for r in seen}
        weights = self.weights(df, list(available))
        if not weights:
            self.trace.notes["selected_by_source"] = {}
            return df.limit(0)
        quota = quotas(available, weights, p["total_samples"], p["allow_oversample"])
        self.trace.notes["selected_by_source"] = quota
        first, rows = 0, []
        for s, q in quota.items():
            rows.append((s, q, first, available[s]))
            first += q
        table = df.sparkSession.createDataFrame(rows, "source_name string, _quota long, _first long, _there long")
        order = [F.md5(F.concat(F.lit(f"{p['seed'] or 0}:"), F.col("sample_id"))), F.col("ord")] if p["shuffle_within_source"] else [F.col("ord")]
        # places are numbered without the rest of the rows, and over all sources at once: one may hold most of them
        places = ranked_within(df.select("ord", "sample_id", "source_name"), "source_name", order, available).withColumn("_at", F.col("rn") - 1)
        table = table.withColumnRenamed("source_name", "_source")
        places = places.join(F.broadcast(table), F.col("source_name").eqNullSafe(F.col("_source"))).where(F.col("_at") < F.col("_quota")).select("ord", "_at", "_quota", "_first", "_there")
        out = df.join(places, "ord")
        if p["allow_oversample"]:
            copies = F.ceil((F.col("_quota") - F.col("_at")) / F.col("_there")).cast("int")
            out = out.where(F.col("_at") < F.col("_quota")).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(copies - 1, F.lit(0)))))
            place = F.col("_at") + F.col("_copy") * F.col("_there")
        else:
            out, place = out.where(F.col("_at") < F.col("_quota")), F.col("_at")
        return out.withColumn("ord", (F.col("_first") + place).cast("long")).select(*df.columns)


class TruncateSamples(SourceMix):
    """A source mix that shuffles within sources unless told not to: a reproducible cut to a number of rows."""

    name = "truncate_samples"
    defaults = {**SourceMix.defaults, "shuffle_within_source": True}


class VarentropyMix(SourceMix):
    """A source mix by exp(mean varentropy / temperature); sources without any score are left out, and without any
    scores at all all sources count alike."""

    name = "varentropy_mix"
    defaults = {**SourceMix.defaults, "temperature": 1.0}

    def weights(self, df: DataFrame, sources: list[str]) -> dict[str, float]:
        t = float(self.params["temperature"])
        t = t if t > 0 else 0.01
        means = {r[0]: r[1] for r in df.groupBy("source_name").agg(F.round(F.avg("varentropy"), 9)).collect()} if "varentropy" in df.columns else {}

        def weight(x: float) -> float:
            try:
                return math.exp(x / t)
            except OverflowError:
                return 1e10

        out = {s: weight(means[s]) for s in sources if means.get(s) is not None}
        return out or dict.fromkeys(sources, 1.0)
