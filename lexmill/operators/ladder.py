"""Several extractors over the same texts: one protocol, prompts and checks of the model rung, comparison, run record."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import agreement, gazetteer, responses, similarity
from lexmill.runtime import small, take_bounded

RUNGS = ("1", "2", "3")
IDS = 200_000
#: The rules that the model gets; {N} is the number of skills and {SKILL_LIST} their ids, one a line.
TEMPLATE = """Name the skills that the text below gives evidence of.

Answer with a JSON object {"skills_present": [...]} and nothing else.
Use only these {N} ids, each at most once:

{SKILL_LIST}
"""


class Extractor(Protocol):
    """From texts (key, text) to (key, skill_id), once for each skill of a text."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def selected(rungs: str, model: str | None = None) -> list[str]:
    """The rungs of a list like ``1,2``; an unknown one, or a model without rung 3, is an error."""
    out = [r.strip() for r in rungs.split(",") if r.strip()]
    if bad := [r for r in out if r not in RUNGS]:
        raise ValueError(f"unknown rungs: {', '.join(bad)} (there are {', '.join(RUNGS)})")
    if model is not None and "3" not in out:
        raise ValueError("a model is for rung 3 only")
    return out


def by_gazetteer(aliases: DataFrame, key: str = "resume_id") -> Extractor:
    return lambda docs: gazetteer.skills(docs, aliases, key)


def by_vectors(vectors: DataFrame, skills: DataFrame, threshold: float = 0.5, key: str = "resume_id") -> Extractor:
    """Rung 2: ``vectors`` has (key, span_id, embedding) of the spans of texts; ``skills`` (skill_id, embedding)."""

    def extract(docs: DataFrame) -> DataFrame:
        own = vectors.join(docs.select(key), key, "left_semi").withColumn("__id", F.struct(key, "span_id"))
        near = similarity.above(similarity.nearest(own, skills, "__id", "skill_id", "embedding"), threshold)
        return near.select(F.col(f"__id.{key}").alias(key), "skill_id").distinct()

    return extract


def extraction_prompts(docs: DataFrame, skills: DataFrame, template: str = TEMPLATE, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, prompt) of each text; the closed vocabulary is in order of id. A plain replacement, so braces in a template stay."""
    ids = [r[0] for r in take_bounded(skills.select("skill_id").dropna().distinct().orderBy("skill_id"), IDS, "the skills")]
    rules = template.replace("{N}", str(len(ids))).replace("{SKILL_LIST}", "\n".join(ids))
    return docs.where(F.col(text).isNotNull()).select(key, F.concat(F.lit(rules + "\nRESUME:\n"), text).alias("prompt"))


def answers(replies: DataFrame, skills: DataFrame, key: str = "resume_id") -> DataFrame:
    """(key, error, skills): the first failed check of each reply to an extraction prompt, or its skills, sorted.

    Order: failed call, cut off by length, empty, no JSON, key missing, no list, id outside the vocabulary.
    ``replies`` has (key, content, done_reason, failure). A failure is never an empty list of skills.
    """
    body = F.trim("content")
    inner = F.get_json_object("content", "$.skills_present")
    listed = F.from_json(inner, "array<string>")
    error = (
        F.when(F.col("failure").isNotNull(), "failed").when(F.col("done_reason") == "length", "length")
        .when(F.col("content").isNull() | (body == ""), "empty").when(F.get_json_object("content", "$").isNull(), "not_json")
        .when(~body.startswith("{") | inner.isNull(), "missing_key").when(~F.trim(inner).startswith("[") | listed.isNull(), "not_list")
    )
    done = replies.select(key, error.alias("error"), F.when(error.isNull(), F.array_sort(F.array_distinct(listed))).alias("skills"))
    known = small(skills.select(F.col("skill_id").alias("id")).distinct(), IDS, "skills")
    bad = done.select(F.col(key).alias("__k"), F.explode("skills").alias("id")).join(known, "id", "left_anti").select("__k").distinct()
    joined = done.join(bad, F.col(key).eqNullSafe(F.col("__k")), "left")
    outside = F.col("__k").isNotNull()
    return joined.select(key, F.when(outside, "unknown_id").otherwise(F.col("error")).alias("error"), F.when(~outside, F.col("skills")).alias("skills"))


def by_model(client, skills: DataFrame, template: str = TEMPLATE, key: str = "resume_id"):
    """Rung 3: from texts to (key, error, skills, seconds, failure), one row a text; calls that fail are kept apart."""

    def run(docs: DataFrame) -> DataFrame:
        asked = responses.ask(extraction_prompts(docs, skills, template, key), client, key)
        return answers(asked, skills, key).join(asked.select(key, "seconds", "failure"), key)

    return run


def restricted(reference: DataFrame, done: DataFrame, file: str = "file") -> DataFrame:
    """The reference rows of the texts that were answered; failed ones take no part in agreement."""
    return reference.join(done.where("error is null").select(file).distinct(), file, "left_semi")


def compared(found: dict[str, DataFrame], reference: DataFrame, file: str = "file") -> DataFrame:
    """(rung, file, counts, jaccard): agreement of every rung with one reference, per file and in total (null file)."""
    parts = [agreement.rolled_up(agreement.paired(x, reference, file), file).withColumn("rung", F.lit(name)) for name, x in sorted(found.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record(done: DataFrame, total: DataFrame, about: dict[str, str], timestamp: Column | None = None, file: str = "file") -> DataFrame:
    """One row with the JSON record of a model run: ids, counts and seconds, never a text.

    ``done`` is the output of ``by_model``, ``total`` the micro agreement. A run is a bounded set of
    files; its record lists each of them.
    """
    ok = F.col("error").isNull()
    entry = F.struct(F.col(file), F.when(ok, F.col("skills")).alias("skills"), "seconds", "error", "failure")
    runs = done.agg(
        F.array_sort(F.collect_list(F.when(ok, entry))).alias("per_resume"), F.array_sort(F.collect_list(F.when(~ok, entry))).alias("failures"),
        F.coalesce(F.median(F.when(ok, F.col("seconds"))), F.lit(0.0)).alias("latency_median_seconds"),
        F.coalesce(F.max(F.when(ok, F.col("seconds"))), F.lit(0.0)).alias("latency_max_seconds"),
    )
    both = runs.crossJoin(F.broadcast(total))
    stamp = F.date_format(timestamp if timestamp is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    as_map = lambda xs, field: F.map_from_entries(F.transform(xs, lambda x: F.struct(x[file].alias("k"), field(x).alias("v"))))
    body = F.struct(
        stamp.alias("timestamp"), *[F.lit(v).alias(k) for k, v in sorted(about.items())],
        as_map("per_resume", lambda x: F.struct(x["skills"].alias("skills"), x["seconds"].alias("seconds"))).alias("per_resume"),
        as_map("failures", lambda x: F.coalesce(x["failure"], x["error"])).alias("failures"), as_map("failures", lambda x: x["seconds"]).alias("failed_seconds"),
        F.struct(*total.columns, "latency_median_seconds", "latency_max_seconds").alias("aggregate"),
    )
    return both.select(F.to_json(body).alias("body"))
