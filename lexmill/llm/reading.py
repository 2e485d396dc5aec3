"""Problem 9: reading level of each document.

The graded sample gives each word its distribution over the levels; the level at which a quarter
of its use is reached is its acquisition grade. A document's level comes from quantiles of the
grades of its known words, each calibrated against the sample by monotone regression.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import spread, take_bounded

#: The graded sample is read to the driver; this is the most rows it may have.
MAX_SAMPLE = 50_000
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
QUANTILES = (0.35, 0.5, 0.65, 0.8)
ACQUIRED = 0.25
#: Share of known words from which a text of unknown language counts as in the sample's language.
KNOWN_SHARE = 0.3


@dataclass
class Scale:
    """Word grades, and for each quantile the knots of its map to a level."""

    grades: dict[str, float]
    knots: list[tuple[np.ndarray, np.ndarray]]
    top: int

    def features(self, text: str) -> tuple[np.ndarray | None, float]:
        words = WORD.findall(text.lower())
        get = self.grades.get
        known = [g for g in map(get, words) if g is not None]
        if not known:
            return None, 0.0
        return np.quantile(known, QUANTILES), len(known) / len(words)

    def level(self, text: str) -> tuple[float | None, float]:
        """(level, share of known words); no level if no word is known."""
        q, share = self.features(text)
        if q is None:
            return None, 0.0
        return float(np.mean([np.interp(x, *k) for x, k in zip(q, self.knots)])), share


def fit(sample: DataFrame, text: str = "text", level: str = "reading_level") -> Scale:
    """The scale of a graded sample of at most ``MAX_SAMPLE`` rows; rows with a null are left out."""
    rows = take_bounded(sample.select(text, level).dropna(), MAX_SAMPLE, "the graded sample")
    levels = sorted({r[1] for r in rows})
    place = {v: i for i, v in enumerate(levels)}
    use: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(levels)))
    size = np.zeros(len(levels))
    counted = []
    for t, v in rows:
        words = Counter(WORD.findall(t.lower()))
        counted.append((words, v))
        size[place[v]] += words.total()
        for w, n in words.items():
            use[w][place[v]] += n
    scale = Scale({w: _grade(n, size, levels) for w, n in use.items()}, [], max(levels, default=0))
    # The knots are fitted to each text by the grades that the other texts give its words.
    found = []
    for words, v in counted:
        rest, known = size.copy(), []
        rest[place[v]] -= words.total()
        for w, n in words.items():
            others = use[w].copy()
            others[place[v]] -= n
            if others.sum() > 0:
                known += [_grade(others, rest, levels)] * n
        if known:
            found.append((np.quantile(known, QUANTILES), v))
    for i in range(len(QUANTILES)):
        scale.knots.append(_monotone(np.array([q[i] for q, _ in found]), np.array([v for _, v in found], float)))
    return scale


def _grade(use: np.ndarray, size: np.ndarray, levels: list) -> float:
    """The level at which the share ``ACQUIRED`` of a word's use, per word of text of a level, is reached."""
    share = use / np.maximum(size, 1)
    return float(levels[int(np.searchsorted(np.cumsum(share) / share.sum(), ACQUIRED))])


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares nondecreasing map from x to y (pool adjacent violators)."""
    if not len(x):
        return np.array([0.0]), np.array([0.0])
    blocks: list[list[float]] = []
    for v in np.unique(x):
        own = y[x == v]
        blocks.append([float(own.mean()), len(own), v, v])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            m, n, _, hi = blocks.pop()
            m0, n0, lo, _ = blocks.pop()
            blocks.append([(m * n + m0 * n0) / (n + n0), n + n0, lo, hi])
    xs = [b[k] for b in blocks for k in ((2, 3) if b[3] > b[2] else (2,))]
    ys = [b[0] for b in blocks for _ in ((2, 3) if b[3] > b[2] else (2,))]
    return np.array(xs), np.array(ys)


def levels(df: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
           language: str = "en") -> DataFrame:
    """(key, level, score, known) of each document; one row per row.

    ``score`` is the level as a number, ``level`` the nearest grade, ``known`` the share of the
    words that the sample has. Both are null for null, empty and wordless texts, for a stated
    other language, and for a text of unstated language with few known words.
    """
    scale = fit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [
                (None, 0.0) if not isinstance(t, str) or isinstance(g, str) and g.strip().lower() != language
                else scale.level(t)
                for t, g in zip(batch["t"], batch["g"])
            ]
            got = [(None if g is None and k < KNOWN_SHARE else s, k) for (s, k), g in zip(got, batch["g"])]
            score = pd.array([s for s, _ in got], dtype="Float64")
            yield pd.DataFrame({"k": batch["k"], "score": score, "known": [k for _, k in got]})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("g"))
    kind = dict(df.dtypes)[key]
    out = spread(rows).mapInPandas(run, f"k {kind}, score double, known double")
    grade = F.round("score").cast("int")
    return out.select(F.col("k").alias(key), grade.alias("level"), "score", "known")


def most_demanding(df: DataFrame, sample: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of the documents at the sample's highest level."""
    top = sample.agg(F.max("reading_level").alias("top"))
    return levels(df, sample, key).join(F.broadcast(top), F.col("level") >= F.col("top")).select(key)
