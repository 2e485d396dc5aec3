"""Pattern scan for contact data: nine patterns in order of priority, then a list of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import MATCH, escape, first_come, matches, replace_spans
from lexmill.runtime import small

#: Phrases that are sent to every executor; a longer list is left to the planner.
PHRASES = 100_000

# The patterns in order of priority, and the placeholder of each kind.
PATTERNS = (
    ("mailto", r"(?iU)mailto:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("email", r"(?U)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("linkedin", r"(?iU)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"),
    (
        "linkedin_shorthand",
        r"(?iU)(?:https?://)?(?:www\.)?linkedin\.com/(?!in/)[A-Za-z0-9_-]+/?"
        r"|(?:https?://)?(?:www\.)?linkedin/[A-Za-z0-9_-]+/?"
        r"|(?<![\w/.-])(?:www\.)?in/(?=[A-Za-z0-9_-]*[0-9-])[A-Za-z0-9_-]+\b",
    ),
    ("github", r"(?iU)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_-]+/?"),
    ("github_shorthand", r"(?iU)(?:https?://)?(?:www\.)?github/[A-Za-z0-9_-]+/?"),
    ("url", r"(?iU)https?://[^\s)>\]]+"),
    (
        "domain",
        r"(?iU)(?<![\w.@/])(?!www\.)[A-Za-z][A-Za-z0-9-]*\.(?:com|dev|io|tech|me|net|org|xyz|in|co)(?![A-Za-z0-9-])",
    ),
    (
        "phone",
        r"(?U)(?:\+\d{1,3}(?:[\s().-]?\d){6,12})|(?:(?<!\d)[6-9]\d(?:[\s-]?\d){8}(?!\d))"
        r"|(?:(?<!\d)\(?\d{3}\)?(?:[\s.-]?\d){7}(?!\d))",
    ),
)
#: What a text must have for a pattern to be tried at all.
ANCHORS = {
    "mailto": "@", "email": "@", "linkedin": r"(?i)linkedin\.com/in/", "linkedin_shorthand": r"(?i)linkedin|in/", "github": r"(?i)github\.com/",
    "github_shorthand": r"(?i)github/", "url": "://", "domain": r"(?i)\.(?:com|dev|io|tech|me|net|org|xyz|in|co)", "phone": r"\d[^\n]{5,}\d",
}
PLACEHOLDER = {
    "email": "[EMAIL]", "mailto": "[EMAIL]", "phone": "[PHONE]", "linkedin": "[LINKEDIN]", "linkedin_shorthand": "[LINKEDIN]",
    "github": "[GITHUB]", "github_shorthand": "[GITHUB]", "url": "[URL]", "domain": "[URL]", "name": "[NAME]",
}
NOTHING = r"(?!)"


def kind_matches(text: Column, kind: str) -> Column:
    """The matches of one kind; the pattern is only tried where its anchor is."""
    anchor = ANCHORS[kind]
    there = text.rlike(anchor) if kind not in ("mailto", "email", "url") else F.contains(text, F.lit(anchor))
    return F.when(there, matches(text, dict(PATTERNS)[kind], kind)).otherwise(F.array().cast(MATCH))


def found(text: Column, name_pattern: Column | None = None) -> Column:
    """The accepted matches of a text, sorted by start; names come last and win no overlap."""
    parts = [kind_matches(text, k) for k, _ in PATTERNS]
    if name_pattern is not None:
        parts.append(matches(text, F.coalesce(name_pattern, F.lit(NOTHING)), "name"))
    return F.when(text.isNotNull(), first_come(F.concat(*parts)))


def once(value: Column) -> Column:
    """The value as a generated column: later projections read it and do not compute it again."""
    return F.explode(F.array(value))


def name_pattern(names: Column) -> Column:
    """The pattern of an array of names: each name and each of its words, longest first, whole words."""
    flat = lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")
    all_ = F.array_distinct(F.flatten(F.transform(names, lambda x: F.concat(F.array(flat(x)), F.split(flat(x), " ")))))
    by_length = F.array_sort(F.transform(F.filter(all_, lambda x: x != ""), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    parts = F.transform(by_length, lambda s: F.replace(escape(s["x"]), F.lit(" "), F.lit(r"\s+")))
    return F.when(F.size(parts) > 0, F.concat(F.lit(r"(?iU)\b(?:"), F.array_join(parts, "|"), F.lit(r")\b")))


def scan(docs: DataFrame, names: DataFrame | None = None, key: str = "resume_id", text: str = "text") -> DataFrame:
    """``docs`` with an array column ``found``; ``names`` gives (key, name) rows that hold for their own text."""
    if names is None:
        return docs.withColumn("found", once(found(F.col(text))))
    own = names.where("name is not null").groupBy(key).agg(name_pattern(F.collect_set("name")).alias("__names"))
    joined = docs.join(own, key, "left")
    return joined.withColumn("found", once(found(F.col(text), F.col("__names")))).drop("__names")


def exploded(scanned: DataFrame, key: str = "resume_id") -> DataFrame:
    return scanned.select(key, F.explode("found").alias("m")).select(key, "m.kind", "m.value", "m.start", "m.end")


def redact(text: Column, spans: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    return F.when(text.isNotNull(), replace_spans(text, spans, lambda m: labels[m["kind"]]))


def tally(spans: Column) -> Column:
    """(kind, n) of an array of matches, in order of kind; from the array itself, so nothing is shuffled."""
    kinds = F.array_sort(F.array_distinct(F.transform(spans, lambda m: m["kind"])))
    return F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter(spans, lambda m: m["kind"] == k)).cast("long").alias("n")))


def counts(scanned: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, kind, n) of each text."""
    return scanned.select(key, F.explode(tally(F.col("found"))).alias("x")).select(key, "x.kind", "x.n")


def detail(scanned: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, n, detail) with ``kind=n`` parts in order of kind; ``none`` where nothing was found."""
    n = F.coalesce(F.size("found"), F.lit(0))
    parts = F.array_join(F.transform(tally(F.col("found")), lambda x: F.concat_ws("=", x["kind"], x["n"])), ", ")
    return scanned.select(key, F.greatest(n, F.lit(0)).cast("long").alias("n"), F.when(n > 0, parts).otherwise("none").alias("detail"))


def rescan_gate(scanned: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, before, after, clean): what a second scan still finds in the redacted text."""
    again = scanned.withColumn("__text", once(redact(F.col(text), F.col("found")))).withColumn("__again", once(found(F.col("__text"))))
    return again.select(key, F.size("found").alias("before"), F.size("__again").alias("after"),
                        (F.size("__again") == 0).alias("clean"))


def overmatched(scanned: DataFrame, limit: int = 200, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, hits) of the texts in which the distinct found values occur more than ``limit`` times."""
    values = F.array_distinct(F.transform("found", lambda m: m["value"]))
    hits = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.size(F.split(F.col(text), F.concat(F.lit("\\Q"), v, F.lit("\\E")), -1)) - 1)
    return scanned.where(F.size("found") > 0).select(key, hits.alias("hits")).where(F.col("hits") > limit)


def name_collisions(names: DataFrame, aliases: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, skill_id, token_length): words of names that are an alias, or stand in one of several words.

    Only the length of the word comes out. Exact hits are an equi-join; the contains-join takes
    each distinct word once against the short list of phrases.
    """
    words = names.where("name is not null").select(key, F.explode(F.split(F.lower(F.trim("name")), r"\s+")).alias("token"))
    words = words.where("token <> ''").distinct()
    distinct = words.select("token").distinct()
    whole = distinct.join(aliases.select(F.col("alias").alias("token"), "skill_id"), "token")
    phrases = small(aliases.where(F.instr("alias", " ") > 0), PHRASES, "phrases")
    inside = distinct.join(phrases, F.expr("contains(alias, token)")).select("token", "skill_id")
    hits = whole.unionByName(inside).distinct()
    return words.join(hits, "token").select(key, "skill_id", F.length("token").alias("token_length")).distinct()
