"""Problem 4: duplicates hidden by formatting differences.

Byte-identical rows collapse first, with their count; only the distinct survivors are brought to
a canonical form, and these are grouped again with their counts summed. Everything is a built-in
expression. Both groupings combine on the map side, so a text or a group that holds a third of
all rows arrives at its reducer as one partial row per task; the second one and the join back to
the rows move digests of the full canonical text, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import written

# The headings that open a field of a résumé text.
HEADINGS = ("name", "contact", "profile", "skills", "experience", "projects", "education", "languages", "references")
#: A heading alone on its line, or at the start of a line or of a part set off by a bar.
HEAD = r"(?i)(?:^|\n)[ \t]*(?:##|==)?[ \t]*(" + "|".join(HEADINGS) + r")[ \t]*(?:==[ \t]*(?:\n|$)|:|\n|$)"
FIELD, BODY = "\x1e", "\x1f"
PLAIN = r"[^\p{L}\p{N}\p{M}\x1f]"


def canonical(text: Column) -> Column:
    """The letters and digits of each field, fields sorted; equal for copies that differ in format only."""
    lines = F.regexp_replace(text, r"[\r\n|]", "\n\n")
    fields = F.split(F.regexp_replace(lines, HEAD, FIELD + "$1" + BODY), FIELD)
    plain = F.transform(fields, lambda f: letters(f, PLAIN))
    return F.array_join(F.array_sort(F.filter(plain, lambda f: f != "")), FIELD)


def letters(text: Column, other: str = r"[^\p{L}\p{N}\p{M}]") -> Column:
    return F.translate(F.lower(F.regexp_replace(text, other, "")), "ς", "σ")


def survivors(df: DataFrame, key: str, text: str, category: str) -> DataFrame:
    """(raw, n, keep, canon) of each distinct pair of category and text that has a letter or digit."""
    rows = df.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(category), F.lit("")).alias("category")
    ).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    distinct = (
        rows.withColumn("raw", raw_key(F.col("text"), F.col("category")))
        .groupBy("raw")
        .agg(F.count("*").alias("n"), F.min("id").alias("keep"), F.first("text").alias("text"),
             F.first("category").alias("category"))
    )
    canon = F.sha2(F.concat_ws(FIELD * 2, letters(F.col("category")), canonical(F.col("text"))), 256)
    return distinct.select("raw", "n", "keep", canon.alias("canon"))


def raw_key(text: Column, category: Column) -> Column:
    return F.sha2(F.concat_ws(FIELD, category, text), 256)


def records(df: DataFrame, key: str = "resume_id", text: str = "text", category: str = "category") -> DataFrame:
    """(keep_id, copies): one record for each set of copies, with the number of its rows.

    Null texts and texts without a letter or digit are no records. A null category equals an
    empty one. ``keep_id`` is the smallest key of the set. Other columns are not read.
    """
    groups = survivors(df, key, text, category).groupBy("canon")
    return groups.agg(F.min("keep").alias("keep_id"), F.sum("n").alias("copies")).select("keep_id", "copies")


def duplicates(df: DataFrame, key: str = "resume_id", text: str = "text", category: str = "category") -> DataFrame:
    """(keep_id, dup_id) of each row that repeats another one but for its format."""
    distinct = written(survivors(df, key, text, category), "distinct-texts")
    groups = distinct.groupBy("canon").agg(F.min("keep").alias("keep_id"), F.sum("n").alias("n"))
    owners = distinct.join(groups.where("n > 1").select("canon", "keep_id"), "canon").select("raw", "keep_id")
    rows = df.select(
        F.col(key).alias("dup_id"),
        raw_key(F.col(text), F.coalesce(F.col(category), F.lit(""))).alias("raw"),
    ).where(F.col(text).isNotNull())
    return rows.join(owners, "raw").where("dup_id <> keep_id").select("keep_id", "dup_id")
