"""Checks of hand-made labels: every violated rule as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import small

#: Known ids that are sent to every executor; a longer list is left to the planner.
LIST_ROWS = 200_000
# The schema of a label, its enumerations, and the set that each id prefix stands for.
SCHEMA = (
    "label_version int, resume_id string, set string, source string, status string, file_name string, file_sha256 string, "
    "format string, layout string, taxonomy_version string, labeller string, labelled_at string, skills_present array<string>, "
    "skills_ambiguous array<string>, roles_fit array<string>, roles_should_exclude array<string>, notes string"
)
STATUS, SETS, FORMATS = ("draft", "final"), ("practice", "exam"), ("pdf", "docx")
PREFIX = {"prac": "practice", "exam": "exam"}
LISTS = {"skills_present": "skill", "skills_ambiguous": "skill", "roles_fit": "role", "roles_should_exclude": "role"}
RESUME_ID, SHA = r"^(prac|exam)_[0-9]{3}$", r"^[0-9a-f]{64}$"


def violations(labels: DataFrame, skills: DataFrame, roles: DataFrame, version: str, require_final: bool = False) -> DataFrame:
    """(check_id, resume_id, detail) of every violated rule; one label may violate several.

    A label that fails a check of its fields (V12) gives only those, one that fails V13 only that; neither
    takes part in the other checks. Files are named by ``label_file`` if there is such a column. Labels
    that share an id (V19) or a file (V20) give a row each, with their file name, so that a
    group of any size is never one row. Each label's own rules are one array in one scan.
    """
    c = F.col

    def rule(check: str, cond: Column, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(check).alias("check_id"), detail.alias("detail"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("id")))

    bad = {
        "label_version": ~c("label_version").eqNullSafe(1), "resume_id": ~F.coalesce(c("resume_id").rlike(RESUME_ID), F.lit(False)),
        "set": ~F.coalesce(c("set").isin(*SETS), F.lit(False)), "status": ~F.coalesce(c("status").isin(*STATUS), F.lit(False)),
        "format": ~F.coalesce(c("format").isin(*FORMATS), F.lit(False)),
        "file_sha256": ~F.coalesce(c("file_sha256").rlike(SHA), F.lit(False)),
        "labelled_at": F.try_to_date("labelled_at", "yyyy-MM-dd").isNull(),
    }
    broken = reduce(lambda a, b: a | b, bad.values())
    final = c("status") == "final"
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv]), F.split_part("resume_id", F.lit("_"), F.lit(1)))
    lacking = {x: final & (F.coalesce(F.size(x), F.lit(0)) <= 0) for x in ("skills_present", "roles_fit")}
    empty = reduce(lambda a, b: a | b, lacking.values())
    rules = []
    if require_final:
        rules.append(rule("V14", ~final, c("status")))
    rules.append(rule("V17", ~prefix.eqNullSafe(c("set")), c("set")))
    rules.append(rule("V18", ~c("taxonomy_version").eqNullSafe(version), c("taxonomy_version")))
    each = [F.filter(F.array(*rules), lambda x: x.isNotNull())]
    for a, b in (("skills_present", "skills_ambiguous"), ("roles_fit", "roles_should_exclude")):
        each.append(F.transform(F.array_intersect(a, b), lambda x: rule("V16", F.lit(True), x)))

    def listed(column: str, kind: str) -> Column:
        return F.transform(F.array_distinct(column), lambda x: F.struct(
            F.lit("V15").alias("check_id"), F.concat_ws(": ", F.lit(column), x).alias("detail"), F.lit(kind).alias("kind"), x.alias("id")))

    each += [listed(*x) for x in LISTS.items()]
    none = F.array().cast("array<struct<check_id:string,detail:string,kind:string,id:string>>")
    every = lambda check, conds: F.filter(F.array(*[rule(check, cond, F.lit(name)) for name, cond in conds.items()]), lambda x: x.isNotNull())
    own = F.when(broken, every("V12", bad)).when(empty, every("V13", lacking)).otherwise(F.concat(*[F.coalesce(x, none) for x in each]))
    rows = labels.select("resume_id", F.explode(own).alias("x")).select("x.check_id", "resume_id", "x.detail", "x.kind", "x.id")
    known = skills.select(F.lit("skill").alias("kind"), F.col("skill_id").alias("id")).unionAll(roles.select(F.lit("role"), "role_id")).distinct()
    rows = rows.join(small(known, LIST_ROWS, "known ids"), ["kind", "id"], "left_anti").select("check_id", "resume_id", "detail")
    file = "label_file" if "label_file" in labels.columns else "file_name"
    good = labels.where(~broken & ~empty).select("resume_id", c(file).alias("file"), "file_sha256")
    for check, key in (("V19", "resume_id"), ("V20", "file_sha256")):
        shared = good.groupBy(key).count().where("count > 1").select(key)
        name = c("file") if check == "V19" else F.concat_ws(": ", "file_sha256", "file")
        rows = rows.unionAll(good.join(shared, key, "left_semi").select(F.lit(check), "resume_id", name))
    return rows


def report(found: DataFrame) -> DataFrame:
    """The violations in the order of their labels, then of the checks."""
    return found.orderBy("resume_id", "check_id", "detail")


def hash_check(labels: DataFrame, files: DataFrame) -> DataFrame:
    """(resume_id, problem) of the labels that can't be read, or whose file is missing or has other content.

    A label that can't be read has no ``file_sha256``.
    """
    joined = labels.join(files.select("resume_id", F.col("sha256").alias("now")), "resume_id", "left")
    problem = F.when(F.col("file_sha256").isNull(), "unreadable").when(F.col("now").isNull(), "missing").when(
        F.col("now") != F.col("file_sha256"), "mismatch")
    return joined.select("resume_id", problem.alias("problem")).where("problem is not null")


def stubs(files: DataFrame, version: str) -> DataFrame:
    """Draft labels, to be filled in by hand, of files given as (resume_id, file_name, sha256).

    Everything but the file is what most labels have, and is corrected by hand.
    """
    empty, blank = F.array().cast("array<string>"), F.lit("")
    kind = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    return files.select(
        F.lit(1).alias("label_version"), "resume_id", F.lit("practice").alias("set"), F.lit("self").alias("source"), F.lit("draft").alias("status"),
        "file_name", F.col("sha256").alias("file_sha256"), kind.alias("format"), F.lit("other").alias("layout"), F.lit(version).alias("taxonomy_version"),
        blank.alias("labeller"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("labelled_at"),
        *[empty.alias(x) for x in LISTS], blank.alias("notes"),
    )
