"""Corpus preparation: row ids, first-row deduplication, batches within a budget, prompts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import repair
from lexmill.runtime import small, take_bounded, with_index, written

#: Consecutive rows that a task forms batches of at a time, and groups whose starts are broadcast; neither changes the result.
BATCH_ROWS, GROUPS = 200_000, 1_000_000


def row_ids(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """``df`` with a zero-padded id of its place, at least four digits wide."""
    placed = with_index(df, order, "__ix")
    n = placed.agg(F.max("__ix").alias("n"))
    width = F.greatest(F.lit(4), F.length(F.coalesce("n", F.lit(0)).cast("string")))
    digits = F.col("__ix").cast("string")
    return placed.join(F.broadcast(n)).withColumn(name, F.lpad(digits, width, F.lit("0"))).drop("n", "__ix")


def deduplicated(df: DataFrame, order: str, text: str = "text") -> DataFrame:
    """The first row, by ``order``, of each distinct text.

    The smallest key of each text is found with map-side combining on a digest, so a text that
    many rows have costs one partial row a task; the rows are then picked by key.
    """
    first = df.where(F.col(text).isNotNull()).groupBy(F.sha2(F.col(text), 256).alias("__h")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")


def repaired(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, repair(F.col(text)))


def starts(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch that begins at each row: where the next one begins, how many follow to the end, and the size of the last.

    The rows that fit are found in the running sum; a longer text has a batch of its own.
    """
    n = len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    after = np.maximum(np.searchsorted(total, total[:-1] + budget, "right") - 1, np.arange(n) + 1)
    count, last = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
    count[n] = 0
    for i in range(n - 1, -1, -1):
        j = after[i]
        if j < n:
            count[i], last[i] = count[j] + 1, last[j]
        else:
            last[i] = total[n] - total[i]
    return after, count, last


def batches(df: DataFrame, order: str, budget: int = 15000, text: str = "text", group_rows: int = BATCH_ROWS) -> DataFrame:
    """(order, n_chars, batch_index): greedy batches in order, each within ``budget`` characters.

    A batch closes when the next text does not fit; a longer text has a batch of its own. The
    rows are worked on in groups, yet the result is that of one fold over all rows: each group gives,
    for every room that the batch before it may have left, how many batches follow and how full the
    last one is (a few rows a group); these are chained, and each group is then filled from its start.
    """
    kind = dict(df.dtypes)[order]
    sized = with_index(df.where(F.col(text).isNotNull()).select(order, F.length(text).cast("long").alias("n_chars")), order)
    rows = sized.select(F.floor(F.col("ix") / group_rows).alias("g"), "ix", order, "n_chars")

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values("ix")["n_chars"].to_numpy()
        _, count, last = starts(sizes, budget)
        total = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.arange(int(np.searchsorted(total, budget, "right")))  # rows that the open batch may still take
        taken = taken[np.append(total[taken[1:]] > total[taken[:-1]], True)]
        whole = taken == len(sizes)
        out = pd.DataFrame({"g": pdf["g"].iloc[0], "room": total[taken], "n": count[taken], "last": np.where(whole, total[-1], last[taken]), "open": whole})
        first = pd.DataFrame({"g": [pdf["g"].iloc[0]], "room": [-1], "n": [count[0]], "last": [last[0]], "open": [False]})
        return pd.concat([first, out])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        used, base, out = budget + 1, 0, []
        for g, own in pdf.sort_values(["g", "room"]).groupby("g", sort=True):
            out.append((g, used, base))
            way = own.iloc[int(np.searchsorted(own["room"].to_numpy(), budget - used, "right")) - 1] if used <= budget else own.iloc[0]
            used = int(way["last"]) + (used if way["open"] else 0)
            base += int(way["n"])
        return pd.DataFrame(out, columns=["g", "used", "base"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        sizes, used = pdf["n_chars"].to_numpy(), int(pdf["used"].iloc[0])
        total = np.concatenate([[0], np.cumsum(sizes)])
        i = min(int(np.searchsorted(total, budget - used, "right")) - 1, len(sizes)) if used <= budget else 0
        after, _, _ = starts(sizes, budget)
        begins = np.zeros(len(sizes), np.int64)
        while i < len(sizes):
            begins[i] = 1
            i = int(after[i])
        pdf["batch_index"] = pdf["base"].iloc[0] + np.cumsum(begins) - 1
        return pdf[[order, "n_chars", "batch_index"]]

    maps = rows.groupBy("g").applyInPandas(ways, "g long, room long, n long, last long, open boolean")
    begin = maps.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(chain, "g long, used long, base long")
    filled = rows.join(small(begin, GROUPS, "groups"), "g").groupBy("g").applyInPandas(fill, f"{order} {kind}, n_chars long, batch_index long")
    return written(filled, "batches")


def batch_stats(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_index").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars"))


def prompts(docs: DataFrame, batched: DataFrame, vocabulary: str, key: str = "resume_id") -> DataFrame:
    """(batch_index, prompt): the vocabulary block, then the texts of the batch in order of key."""
    head = F.concat(F.lit("--- resume_id: "), F.col(key), F.lit(" (category: "), F.coalesce("category", F.lit("None")), F.lit(") ---\n"))
    rows = docs.join(batched.select(key, "batch_index"), key).select("batch_index", F.struct(F.col(key), F.concat(head, "text").alias("p")).alias("r"))
    parts = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["p"])
    return rows.groupBy("batch_index").agg(F.concat(F.lit(vocabulary + "\n\nRESUMES:\n\n"), F.array_join(parts, "\n\n")).alias("prompt"))


#: The rules of a mining prompt; {N} is the number of skills, {VOCABULARY} a line ``id: aliases`` for each.
MINING_RULES = """Find wordings in the résumés below that name a skill of the list and are not among its known aliases.

- skill_id is one of the {N} ids of the list, or NEW for a skill that the list lacks; for NEW add suggested_name, in the form of the ids.
- Leave out what is listed as an alias already, whatever its letter case.
- quoted_phrase is copied from the text letter by letter.
- Answer with a JSON list and nothing around it, [] if there is nothing:
[{"resume_id": "0000", "skill_id": "...", "quoted_phrase": "..."}, {"resume_id": "0000", "skill_id": "NEW", "quoted_phrase": "...", "suggested_name": "..."}]

{N} skills, as id: known aliases

{VOCABULARY}"""


def vocabulary(skills: DataFrame, aliases: DataFrame, most: int = 200_000) -> tuple[int, str]:
    """(number of skills, a line for each with its aliases besides its id), in order of id."""
    own = aliases.where(F.col("alias") != F.col("skill_id")).groupBy("skill_id").agg(F.array_join(F.sort_array(F.collect_list("alias")), ", ").alias("a"))
    rows = take_bounded(skills.select("skill_id").dropna().distinct().join(own, "skill_id", "left").orderBy("skill_id"), most, "the vocabulary")
    return len(rows), "\n".join(f"{r.skill_id}: {r.a or ''}" for r in rows)


def mining_prompts(docs: DataFrame, batched: DataFrame, skills: DataFrame, aliases: DataFrame, rules: str = MINING_RULES, key: str = "resume_id") -> DataFrame:
    """``prompts`` with the rules and the vocabulary before the texts; a plain replacement, so braces in the rules stay."""
    n, block = vocabulary(skills, aliases)
    return prompts(docs, batched, rules.replace("{N}", str(n)).replace("{VOCABULARY}", block), key)
