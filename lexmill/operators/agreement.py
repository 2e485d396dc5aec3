"""Agreement of two extractors, grounding of extracted skills, and latency of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def paired(candidate: DataFrame, reference: DataFrame, file: str = "file", skill: str = "skill_id") -> DataFrame:
    """(file, skill, c, r): which side names each skill; one full outer join on both columns."""
    c = candidate.select(file, skill).distinct().withColumn("c", F.lit(1))
    r = reference.select(file, skill).distinct().withColumn("r", F.lit(1))
    return c.join(r, [file, skill], "full").na.fill(0, ["c", "r"])


def _sums() -> list[Column]:
    return [F.sum("c").alias("candidate_count"), F.sum("r").alias("reference_count"),
            F.sum(F.col("c") * F.col("r")).alias("agreed_count")]


def _jaccard() -> Column:
    c = F.col
    return ratio(c("agreed_count"), c("candidate_count") + c("reference_count") - c("agreed_count"))


def per_file(pairs: DataFrame, file: str = "file") -> DataFrame:
    return pairs.groupBy(file).agg(*_sums()).withColumn("jaccard", _jaccard())


def micro(pairs: DataFrame) -> DataFrame:
    c = F.col
    total = pairs.agg(*[F.coalesce(x, F.lit(0)).alias(n) for x, n in zip(_sums(), ("candidate_count", "reference_count", "agreed_count"))])
    return total.select(
        "candidate_count", "reference_count", "agreed_count",
        ratio(c("agreed_count"), c("candidate_count")).alias("precision_analogue"),
        ratio(c("agreed_count"), c("reference_count")).alias("recall_analogue"), _jaccard().alias("micro_jaccard"),
    )


def rolled_up(pairs: DataFrame, file: str = "file") -> DataFrame:
    """Both levels in one pass; the total has a null file."""
    return pairs.rollup(file).agg(*_sums()).withColumn("jaccard", _jaccard())


def key_mismatch(candidate: DataFrame, reference: DataFrame, file: str = "file") -> DataFrame:
    """(file, side) of the files that only one side has."""
    c = candidate.select(file).distinct().withColumn("c", F.lit(1))
    r = reference.select(file).distinct().withColumn("r", F.lit(1))
    both = c.join(r, file, "full").where("c is null or r is null")
    return both.select(file, F.when(F.col("c").isNull(), "reference").otherwise("candidate").alias("side"))


def canary(total: DataFrame, found: int, reference: int, agreed: int, jaccard: float, tolerance: float = 0.01) -> DataFrame:
    """Whether a total reproduces recorded figures: counts exactly, the index within a tolerance."""
    return total.select(
        (F.col("candidate_count") == found).alias("found_ok"), (F.col("reference_count") == reference).alias("reference_ok"),
        (F.col("agreed_count") == agreed).alias("agreed_ok"),
        (F.abs(F.col("micro_jaccard") - jaccard) <= tolerance).alias("jaccard_ok"),
    )


def grounding(skills: DataFrame, docs: DataFrame, score: Column, threshold: float = 0.5, key: str = "resume_id") -> DataFrame:
    """(key, skill_count, grounded_count, pass_rate) per text, and with a null key in total.

    ``score`` is any expression over the joined columns; a text without skills has rate 0.
    """
    joined = skills.join(docs, key).select(key, (score >= threshold).cast("int").alias("ok"))
    return joined.rollup(key).agg(
        F.count("*").alias("skill_count"), F.coalesce(F.sum("ok"), F.lit(0)).alias("grounded_count"),
        F.coalesce(F.avg("ok"), F.lit(0.0)).alias("pass_rate"),
    )


def latency(calls: DataFrame, seconds: str = "seconds", failure: str = "failure") -> DataFrame:
    """(median_s, max_s) of the calls that did not fail; (0, 0) if all did."""
    ok = calls.where(F.col(failure).isNull())
    return ok.agg(F.coalesce(F.median(seconds), F.lit(0.0)).alias("median_s"), F.coalesce(F.max(seconds), F.lit(0.0)).alias("max_s"))


def failed_seconds(calls: DataFrame, key: str, seconds: str = "seconds", failure: str = "failure") -> DataFrame:
    return calls.where(F.col(failure).isNotNull()).select(key, seconds)
