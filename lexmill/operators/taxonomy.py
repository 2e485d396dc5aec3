"""The canonical list of skills, its roles, and the checks on both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.runtime import small

#: Rows of a list of skills or roles that are sent to every executor; a longer one is left to the planner.
LIST_ROWS = 100_000
# Bucket names in order; a later bucket wins where a skill is in two.
BUCKETS = ("core", "supporting", "differentiator")
ID = r"^[a-z0-9_]+$"


def family_roles(skills: DataFrame) -> DataFrame:
    """One role for each family of skills: (role_id, bucket, skill_id, weight, min_core_ratio).

    The first three skills of a family are its core with weight 3, the next three support it with
    weight 2, further ones have weight 1; an even number of skills asks for 0.6 of the core, an
    odd one for 0.7. The list of skills is small, so the window is too.
    """
    by = Window.partitionBy("family")
    place = F.row_number().over(by.orderBy("skill_id"))
    ranked = skills.where("family is not null and skill_id is not null").select(
        "family", "skill_id", place.alias("r"), F.count("*").over(by).alias("n")
    )
    return ranked.select(
        F.concat(F.lit("role_"), "family").alias("role_id"),
        F.when(F.col("r") <= 3, "core").when(F.col("r") <= 6, "supporting").otherwise("differentiator").alias("bucket"),
        "skill_id",
        F.when(F.col("r") <= 3, 3).when(F.col("r") <= 6, 2).otherwise(1).alias("weight"),
        F.when(F.col("n") % 2 == 0, 0.6).otherwise(0.7).alias("min_core_ratio"),
    )


def merged_weights(roles: DataFrame) -> DataFrame:
    """One row for each role and skill; the last bucket's weight wins."""
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return roles.groupBy("role_id", "skill_id").agg(F.max_by("weight", order).alias("weight"))


def by_family(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    n = aliases.groupBy("skill_id").agg(F.count("*").alias("n"))
    return (
        skills.join(n, "skill_id", "left")
        .groupBy("family")
        .agg(F.count("*").alias("n_skills"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_aliases"))
    )


def owners(aliases: DataFrame) -> DataFrame:
    """(alias, owners) of the aliases that more than one skill has."""
    own = aliases.groupBy("alias").agg(F.sort_array(F.collect_set("skill_id")).alias("o"))
    return own.where(F.size("o") > 1).select("alias", F.array_join("o", ", ").alias("owners"))


def orphans(skills: DataFrame, used: DataFrame) -> DataFrame:
    """(family, n, skills) of the skills that no row of ``used`` names."""
    left = skills.join(used.select("skill_id").distinct(), "skill_id", "left_anti")
    listed = F.array_join(F.sort_array(F.collect_list("skill_id")), ", ")
    return left.groupBy("family").agg(F.count("*").alias("n"), listed.alias("skills"))


def counts(skills: DataFrame, aliases: DataFrame, roles: DataFrame) -> DataFrame:
    """One row: (n_skills, n_roles, n_aliases) of a taxonomy."""
    one = lambda df, name, what: df.agg(F.count_distinct(what).alias(name))
    return one(skills, "n_skills", "skill_id").crossJoin(one(roles, "n_roles", "role_id")).crossJoin(aliases.agg(F.count("*").alias("n_aliases")))


def role_totals(roles: DataFrame) -> DataFrame:
    core = F.sum(F.when(F.col("bucket") == "core", 1).otherwise(0))
    return roles.groupBy("role_id").agg(
        core.alias("n_core"), F.count("*").alias("n_skills"), F.sum("weight").alias("total_weight")
    )


def bucket_overlap(roles: DataFrame) -> DataFrame:
    """(role_id, skill_id, buckets) of the skills that a role lists in more than one bucket."""
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    found = F.sort_array(F.collect_list(F.struct(order.alias("o"), "bucket")))
    both = roles.groupBy("role_id", "skill_id").agg(found.alias("b"))
    names = F.array_join(F.transform("b", lambda x: x["bucket"]), ", ")
    return both.where(F.size("b") > 1).select("role_id", "skill_id", names.alias("buckets"))


def contained(aliases: DataFrame) -> DataFrame:
    """(alias, inside, skill_id) of aliases that stand within a longer alias of another skill.

    A contains-join of two small lists; the longer side is filtered to phrases first.
    """
    a = aliases.select(F.col("alias").alias("inside"), F.col("skill_id").alias("own"))
    b = aliases.where(F.instr("alias", " ") > 0)
    on = F.expr("contains(alias, inside)") & (F.col("own") != F.col("skill_id"))
    return b.join(small(a, LIST_ROWS, "aliases"), on).select("alias", "inside", "skill_id")


def _violation(df: DataFrame, check: str, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check_id"), subject.alias("subject"), detail.alias("detail"))


def violations(skills: DataFrame, aliases: DataFrame, roles: DataFrame, versions: tuple[str, str, str], role_ids: DataFrame | None = None) -> DataFrame:
    """(check_id, subject, detail): every violated rule of a taxonomy, all checks in one union.

    ``roles`` has a row for each role, bucket and skill, ``role_ids`` (role_id) one for each role as
    listed; without it the roles are those of ``roles`` and none can be listed twice or be empty.
    """
    c, none = F.col, F.lit("")
    listed = roles.select("role_id").distinct() if role_ids is None else role_ids.select("role_id")
    skill_ids = small(skills.select("skill_id").distinct(), LIST_ROWS, "skills")
    own = small(aliases.where(c("alias") == c("skill_id")).select("skill_id").distinct(), LIST_ROWS, "skills")
    named = small(aliases.select("skill_id").distinct(), LIST_ROWS, "skills")
    core = small(roles.where("bucket = 'core'").select("role_id").distinct(), LIST_ROWS, "roles")
    twice = lambda df, name: df.groupBy(name).count().where("count > 1")
    parts = [
        _violation(twice(skills, "skill_id"), "V01", c("skill_id"), c("count").cast("string")),
        _violation(twice(listed, "role_id"), "V02", c("role_id"), c("count").cast("string")),
        _violation(aliases.where("alias <> trim(lower(alias))"), "V03", c("alias"), c("skill_id")),
        _violation(owners(aliases), "V04", c("alias"), c("owners")),
        _violation(skills.join(own, "skill_id", "left_anti"), "V05", c("skill_id"), none),
        _violation(skills.where("description is null or length(description) not between 20 and 200"), "V06",
                   c("skill_id"), F.coalesce(F.length("description").cast("string"), F.lit("missing"))),
        _violation(roles.join(skill_ids, "skill_id", "left_anti"), "V07", c("role_id"), F.concat_ws(": ", "bucket", "skill_id")),
        _violation(bucket_overlap(roles), "V08", c("role_id"), F.concat_ws(": ", "skill_id", "buckets")),
        _violation(listed.distinct().join(core, "role_id", "left_anti"), "V09", c("role_id"), none),
        _violation(skills.where(~c("skill_id").rlike(ID) | ~c("family").rlike(ID)), "V11", c("skill_id"), c("family")),
        _violation(skills.join(named, "skill_id", "left_anti"), "V11", c("skill_id"), F.lit("no alias")),
        _violation(listed.distinct().where(~c("role_id").rlike(ID)), "V11", c("role_id"), F.lit("id")),
        _violation(roles.where("weight not between 1 and 5 or min_core_ratio <= 0 or min_core_ratio > 1"), "V11",
                   c("role_id"), c("skill_id")),
    ]
    a, b, r = versions
    mismatch = [(n, f"{x} vs {y}") for n, x, y in (("roles", a, r), ("skills", a, b)) if x != y]
    if mismatch:
        got = skills.sparkSession.createDataFrame(mismatch, "subject string, detail string")
        parts.append(_violation(got, "V10", c("subject"), c("detail")))
    return reduce(DataFrame.unionAll, parts)


#: Texts of the checks, in the order in which a report lists them.
TITLES = {
    "V01": "skill id listed more than once", "V02": "role id listed more than once", "V03": "alias is not lower case or not trimmed",
    "V04": "alias belongs to several skills", "V05": "own id is not among the aliases", "V06": "description missing or not of 20 to 200 characters",
    "V07": "role names an unknown skill", "V08": "skill stands in several buckets of a role", "V09": "role has no core skill",
    "V10": "versions differ", "V11": "field is out of its form or range",
}


def report(found: DataFrame) -> DataFrame:
    """(place, line): one line for each violation in the order of the checks, then of subject and detail."""
    title = F.element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.col("check_id"))
    line = F.concat(F.lit("- "), F.col("check_id"), F.lit(" "), F.col("subject"), F.lit(": "), title,
                    F.when(F.col("detail") == "", "").otherwise(F.concat(F.lit(" ("), F.col("detail"), F.lit(")"))))
    return found.select(F.struct("check_id", "subject", "detail").alias("place"), line.alias("line")).orderBy("place")
