"""Weighted coverage of roles by the skills that were found, behind a core gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.taxonomy import merged_weights
from lexmill.runtime import small

#: Roles, and rows of roles and skills, that are sent to every executor; longer lists are left to the planner.
ROLE_ROWS = 100_000


def requirements(roles: DataFrame) -> DataFrame:
    """(role_id, core, all, weights, total, need) of each role; a skill in two buckets has the last one's weight."""
    merged = merged_weights(roles).groupBy("role_id").agg(
        F.sort_array(F.collect_list("skill_id")).alias("all"), F.sum("weight").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("skill_id", "weight"))).alias("weights"),
    )
    core = roles.groupBy("role_id").agg(
        F.array_distinct(F.collect_list(F.when(F.col("bucket") == "core", F.col("skill_id")))).alias("core"), F.max("min_core_ratio").alias("need"))
    return merged.join(core, "role_id")


def skill_sets(found: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, own): the skills of each candidate; sets are combined on the map side, so a hot key is a row a task."""
    return found.groupBy(key).agg(F.collect_set("skill_id").alias("own"))


def _scored(pairs: DataFrame, key: str) -> DataFrame:
    matched = F.array_intersect("all", "own")
    ratio = F.size(F.array_intersect("core", "own")) / F.size("core")
    hits = F.aggregate(matched, F.lit(0).cast("long"), lambda acc, x: acc + F.element_at("weights", x))
    return pairs.select(
        key, "role_id", ratio.alias("core_ratio"), (hits / F.col("total")).alias("score"), (ratio >= F.col("need")).alias("passed"),
        matched.alias("matched"), F.array_except("all", "own").alias("missing"),
    )


def coverage(found: DataFrame, roles: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, role_id, core_ratio, score, passed, matched, missing) of every candidate and role.

    ``found`` has (key, skill_id) rows; repeated ones count once. The result has a row for each
    candidate and role, as excluded roles are reported too; it is made from one row of each
    candidate and the broadcast roles, in one shuffle.
    """
    return _scored(skill_sets(found, key).crossJoin(small(requirements(roles), ROLE_ROWS, "roles")), key)


def passed(found: DataFrame, roles: DataFrame, key: str = "resume_id") -> DataFrame:
    """``coverage`` of the roles that pass the gate only.

    A role can't pass without one of its core skills, so each candidate meets the roles of its own
    skills alone. The shuffle of ``skill_sets`` by key serves the whole plan.
    """
    by_skill = roles.where("bucket = 'core'").groupBy("skill_id").agg(F.collect_set("role_id").alias("r"))
    # Neither list has more rows than ``roles``, so one count decides for both.
    send = F.broadcast if roles.limit(ROLE_ROWS + 1).count() <= ROLE_ROWS else lambda df: df
    near = skill_sets(found, key).select(key, "own", F.explode("own").alias("skill_id")).join(send(by_skill), "skill_id")
    pairs = near.select(key, "own", F.explode("r").alias("role_id")).groupBy(key, "role_id").agg(F.first("own").alias("own"))
    return _scored(pairs.join(send(requirements(roles)), "role_id"), key).where("passed")


def top_roles(covered: DataFrame, n: int = 5, key: str = "resume_id") -> DataFrame:
    """The best ``n`` passed roles of each candidate with their rank; equal scores by role."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "role_id")
    ranked = covered.where("passed").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n)


def best_roles(found: DataFrame, roles: DataFrame, n: int = 5, key: str = "resume_id") -> DataFrame:
    """``top_roles`` straight from what was found; one shuffle, by key."""
    return top_roles(passed(found, roles, key), n, key)


def excluded(covered: DataFrame, key: str = "resume_id") -> DataFrame:
    """Every role that failed the gate, never capped, with its reason."""
    return covered.where("not passed").select(key, "role_id", F.lit("core_gate_failed").alias("reason"), "core_ratio")


def pass_rate(covered: DataFrame) -> DataFrame:
    return covered.groupBy("role_id").agg(
        F.count("*").alias("n"), F.sum(F.col("passed").cast("int")).alias("n_passed"),
        F.avg(F.col("passed").cast("int")).alias("pass_rate"),
    )
