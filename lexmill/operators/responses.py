"""Checks of model replies, and the record of a mining run."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.runtime import small

#: Skills that are sent to every executor; a longer list is left to the planner.
ID_ROWS = 200_000

ITEM = "struct<resume_id:string,skill_id:string,quoted_phrase:string,suggested_name:string>"
ITEMS = f"array<{ITEM}>"
# The keys that every item of a reply must have.
REQUIRED = ("resume_id", "skill_id", "quoted_phrase")


def checked(replies: DataFrame, skills: DataFrame, *key: str) -> DataFrame:
    """(key, error, items): the first failed check of each reply, in order, or its items.

    Order: cut off by length, empty, no JSON, no list, an item without a required key, an id
    outside the list and ``NEW``. One bad item fails the whole reply; ``[]`` is valid. A reply's key
    is ``batch_index`` unless other columns are named.
    """
    key = key or ("batch_index",)
    kind = F.get_json_object("content", "$")
    body = F.trim("content")
    keys = F.from_json("content", "array<map<string,string>>")
    parsed = F.from_json("content", ITEMS)
    lacking = F.exists(keys, lambda m: F.expr("false") if not REQUIRED else ~(
        F.array_contains(F.map_keys(m), REQUIRED[0]) & F.array_contains(F.map_keys(m), REQUIRED[1]) & F.array_contains(F.map_keys(m), REQUIRED[2])))
    named_ids = F.filter(F.array_distinct(F.transform(parsed, lambda x: F.coalesce(x["skill_id"], F.lit("")))), lambda i: i != "NEW")
    error = (
        F.when(F.col("done_reason") == "length", "length")
        .when(F.col("content").isNull() | (body == ""), "empty")
        .when(kind.isNull() & ~body.rlike(r"^\[\s*\]$"), "not_json")
        .when(~body.startswith("["), "not_list")
        .when(keys.isNull() | lacking, "missing_key")
    )
    named = F.transform(parsed, lambda x: F.struct(
        x["resume_id"].alias("resume_id"), x["skill_id"].alias("skill_id"), x["quoted_phrase"].alias("quoted_phrase"),
        F.when(x["skill_id"] == "NEW", x["suggested_name"]).alias("suggested_name")))
    done = replies.select(*key, error.alias("error"), F.when(error.isNull(), named).alias("items"), F.when(error.isNull(), named_ids).alias("ids"))
    # Ids are looked up by an anti-join, so the list of skills never goes into a row.
    known = small(skills.select(F.col("skill_id").alias("id")).distinct(), ID_ROWS, "skills")
    bad = done.select(*[F.col(k).alias(f"__{k}") for k in key], F.explode("ids").alias("id")).join(known, "id", "left_anti").drop("id").distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    joined = done.join(bad.withColumn("__bad", F.lit(True)), same, "left")
    outside = F.col("__bad").isNotNull()
    return joined.select(*key, F.when(outside, "unknown_id").otherwise(F.col("error")).alias("error"), F.when(~outside, F.col("items")).alias("items"))


def proposals(done: DataFrame, model: str, key: str = "batch_index") -> DataFrame:
    return done.select(key, F.explode("items").alias("p")).select("p.*", F.lit(model).alias("model"), key)


def manifest(done: DataFrame, *by: str) -> DataFrame:
    """One row about a run (each run, where ``by`` tells them apart), also where every batch failed."""
    return done.groupBy(*by).agg(
        F.count("*").alias("n_batches"), F.count(F.when(F.col("error").isNull(), 1)).alias("n_ok"),
        F.count("error").alias("n_failed"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("n_proposals"),
    )


def ask(prompts: DataFrame, client: Callable[[str], tuple[str | None, str]], key: str = "batch_index") -> DataFrame:
    """(key, content, done_reason, seconds, failure) of a model called once for each prompt.

    ``client`` takes the prompt and gives (content, done_reason). A call that raises is recorded as
    a failure and never as an empty reply. Each task warms its client with one untimed call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        warm = False
        for batch in batches:
            rows = []
            for k, prompt in zip(batch[key], batch["prompt"]):
                if not warm:
                    try:
                        client("")
                    except Exception:  # noqa: BLE001  the timed calls report what is wrong
                        pass
                    warm = True
                began = time.perf_counter()
                try:
                    content, reason = client(prompt)
                    rows.append((k, content, reason, time.perf_counter() - began, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, None, time.perf_counter() - began, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "content", "done_reason", "seconds", "failure"])

    kind = dict(prompts.dtypes)[key]
    return prompts.select(key, "prompt").mapInPandas(
        run, f"{key} {kind}, content string, done_reason string, seconds double, failure string"
    )
