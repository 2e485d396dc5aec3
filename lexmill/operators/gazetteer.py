"""Closed-vocabulary extraction: token phrases, longest first, without overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import TOKEN, tokens
from lexmill.runtime import spread, take_bounded

#: Aliases that are sent to every executor, some hundred bytes each; a longer list is joined by shuffle.
ALIAS_ROWS = 100_000
SPAN = "array<struct<first:int,n:int,alias:string,skill_id:string>>"
#: The token pattern of the JVM for Python, where \w has the letters and numbers of all scripts.
PYTHON_TOKEN = re.compile(TOKEN.replace(r"[^\s\p{L}\p{N}_]", r"[^ \t\n\x0b\f\r\w]").replace(r"[^\s]", r"[^ \t\n\x0b\f\r]").replace(r"\p{L}\p{N}_", r"\w"))

Phrases = dict[str, list[tuple[tuple[str, ...], str, str]]]


def phrases(aliases: DataFrame) -> DataFrame:
    """(t, skill_id, alias): aliases as the tokens that they match, in small letters."""
    t = aliases.where("alias is not null and skill_id is not null").select(
        F.transform(tokens(F.lower("alias")), F.lower).alias("t"), "skill_id", "alias"
    )
    return t.where(F.size("t") > 0)


def _heads(rows: list) -> Phrases:
    """The phrases by their first token."""
    out: Phrases = {}
    for r in rows:
        out.setdefault(r.t[0], []).append((tuple(r.t), r.alias, r.skill_id))
    return out


def found(text: str, heads: Phrases) -> list[tuple[int, int, str, str]]:
    """(first, n, alias, skill_id) of every phrase in a text, overlapping ones too."""
    t = [x.lower() for x in PYTHON_TOKEN.findall(text)]
    out = []
    for i, x in enumerate(t):
        for phrase, alias, skill in heads.get(x, ()):
            if len(phrase) == 1 or tuple(t[i : i + len(phrase)]) == phrase:
                out.append((i, len(phrase), alias, skill))
    return out


def longest_first(matches: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The matches kept without overlap: longest first, then leftmost, then by alias and skill."""
    taken: set[int] = set()
    out = []
    for m in sorted(matches, key=lambda m: (-m[1], *m)):
        place = range(m[0], m[0] + m[1])
        if taken.isdisjoint(place):
            taken.update(place)
            out.append(m)
    return out


def _scan(docs: DataFrame, known: list, pick: Callable, key: str, text: str) -> DataFrame:
    """One pass over the texts in Arrow batches; nothing is shuffled, the texts do not come out."""
    heads = _heads(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *m) for k, t in zip(batch[key], batch[text]) for m in pick(found(t, heads))]
            yield pd.DataFrame(rows, columns=[key, "first", "n", "alias", "skill_id"])

    kind = dict(docs.dtypes)[key]
    return spread(docs.where(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, f"{key} {kind}, first int, n int, alias string, skill_id string")


def _joined(docs: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Every phrase in every text for a list that is too long to be sent: joined on the head, then on the phrase."""
    known = known.select(F.array_join("t", "\x00").alias("phrase"), F.col("t")[0].alias("head"), F.size("t").alias("n"), "skill_id", "alias")
    toks = docs.where(F.col(text).isNotNull()).select(key, F.transform(tokens(F.col(text)), F.lower).alias("t"))
    at = toks.select(key, "t", F.posexplode("t").alias("first", "head")).join(known.select("head", "n").distinct(), "head")
    run = F.array_join(F.slice("t", F.col("first") + 1, F.col("n")), "\x00").alias("phrase")
    runs = at.where(F.col("first") + F.col("n") <= F.size("t")).select(key, "first", run)
    return runs.join(known, "phrase").select(key, "first", "n", "alias", "skill_id")


def candidates(docs: DataFrame, aliases: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, first, n, alias, skill_id) of every alias in every text, overlapping ones too."""
    known = phrases(aliases)
    rows = known.limit(ALIAS_ROWS + 1).collect()
    return _scan(docs, rows, list, key, text) if len(rows) <= ALIAS_ROWS else _joined(docs, known, key, text)


def spans(docs: DataFrame, aliases: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, first, n, alias, skill_id) of the accepted phrases: longest first, then leftmost.

    Keys are unique; with a list that is sent to the executors, repeated ones each give their own spans.
    """
    known = phrases(aliases)
    rows = known.limit(ALIAS_ROWS + 1).collect()
    if len(rows) <= ALIAS_ROWS:
        return _scan(docs, rows, longest_first, key, text)
    every = _joined(docs, known, key, text).groupBy(key).agg(F.collect_list(
        F.struct((-F.col("n")).alias("rank"), "first", "n", "alias", "skill_id")).alias("c"))
    pick = lambda x: F.struct(x["first"].alias("first"), x["n"].alias("n"), x["alias"].alias("alias"), x["skill_id"].alias("skill_id"))  # noqa: E731, E501
    fold = lambda acc, x: F.when(
        F.exists(acc, lambda k: (x["first"] < k["first"] + k["n"]) & (x["first"] + x["n"] > k["first"])), acc
    ).otherwise(F.concat(acc, F.array(pick(x))))
    kept = F.aggregate(F.array_sort("c"), F.array().cast(SPAN), fold)
    return every.select(key, F.explode(kept).alias("k")).select(key, "k.*")


def mentions(docs: DataFrame, aliases: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, skill_id, matched_alias, start, end) of the accepted phrases, as they stand in the text; offsets in code points.

    The list must be short enough to be sent to the executors.
    """
    heads = _heads(take_bounded(phrases(aliases), ALIAS_ROWS, "the list of aliases"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                at = [m.span() for m in PYTHON_TOKEN.finditer(t)]
                rows += [(k, s, t[at[i][0] : at[i + n - 1][1]], at[i][0], at[i + n - 1][1]) for i, n, _, s in longest_first(found(t, heads))]
            yield pd.DataFrame(rows, columns=[key, "skill_id", "matched_alias", "start", "end"])

    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, skill_id string, matched_alias string, start int, end int"
    return spread(docs.where(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, schema)


def skills(docs: DataFrame, aliases: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, skill_id), once for each skill that a text names."""
    return spans(docs, aliases, key, text).select(key, "skill_id").distinct()
