"""Problem 1: garbled text from wrong character encoding.

Every text is a source whose code-page swap is unknown. Words with unusual characters are
counted over the whole corpus; expectation-maximisation over these counts learns the bigrams
of clean text, the weight of each channel and its symbol-to-letter table (see charset.py).
The model is bounded by the alphabet, so it is broadcast; the texts are then scanned once,
without a shuffle, and restored with ``str.translate`` under each source's own channel weights.
A source whose words no known pair of pages explains gets a table of its own, learned from its
words against the same bigrams (``charset.cipher``).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import charset as C
from lexmill.llm.common import beyond_ascii, spread, take_bounded, written

#: Upper bound of summed statistics: pairs of characters of the known code pages, and channels.
MAX_STATISTICS = 2_000_000
COUNTS = "kind string, a string, b string, v double"


#: Different words that a worker counts before it hands them on.
MOST_WORDS = 200_000


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of all words with a character that plain English text lacks."""
    texts = spread(df.select(F.col(text).alias("t"))).where(beyond_ascii(F.col("t")))
    return texts.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of a part, each with its number; one that was handed on may come again."""
    word, suspect = re.compile(C.WORD), re.compile(C.SUSPECT)
    counts: Counter = Counter()
    for batch in batches:
        for t in batch["t"]:
            if suspect.search(t):
                counts.update(word.findall(t))
                if len(counts) > MOST_WORDS:
                    yield pd.DataFrame(list(counts.items()), columns=["word", "n"])
                    counts.clear()
    yield pd.DataFrame(list(counts.items()), columns=["word", "n"])


def _summed(df: DataFrame) -> dict:
    rows = take_bounded(
        df.groupBy("kind", "a", "b").agg(F.sum("v").alias("v")), MAX_STATISTICS, "the table of letter statistics"
    )
    return {(r.kind, r.a, r.b): r.v for r in rows}


def _frame(counts: dict) -> pd.DataFrame:
    return pd.DataFrame([(*k, float(v)) for k, v in counts.items()], columns=["kind", "a", "b", "v"])


def _start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict = defaultdict(float)
    for batch in batches:
        for word, n in zip(batch["word"], batch["n"]):
            if C.plain_start(word):
                w = C.shape(word)
                for i in range(len(w) - 1):
                    if (w[i] > "\x7f" or w[i + 1] > "\x7f") and C.Model.unknown not in w[i : i + 2]:
                        counts["b", w[i : i + 2], ""] += n
    yield _frame(counts)


def fit(df: DataFrame, text: str = "text", rounds: int = 3) -> C.Model:
    """The channel model of a corpus, from the counts of all its unusual words.

    An empty corpus, or one of ASCII only, gives a model that finds nothing but control
    characters and lost ones.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = written(word_counts(df, text).repartition(parts), "unusual-words")
    first = C.first_model({k[1]: v for k, v in _summed(words.mapInPandas(_start, COUNTS)).items()})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [C.readings(word, first, 30.0) for word in batch["word"]]
            yield pd.DataFrame({
                "word": batch["word"], "n": batch["n"], "true": [[x for _, x, _ in f] for f in found],
                "wrong": [[c[0] for *_, c in f] for f in found], "page": [[c[1] for *_, c in f] for f in found],
            })

    schema = "word string, n long, true array<string>, wrong array<string>, page array<string>"
    readings = written(words.mapInPandas(read, schema), "readings")
    model = first
    for _ in range(rounds):
        model = C.update(model, _summed(readings.mapInPandas(_expectation(model), COUNTS)))
    return model


def _expectation(model: C.Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = defaultdict(float)
        for batch in batches:
            for word, n, true, wrong, page in zip(*(batch[c] for c in ("word", "n", "true", "wrong", "page"))):
                found = [(model.score(x), x, c) for x, c in zip(true, zip(wrong, page))]
                C.expected(found, word, n, model, out)
        yield _frame(out)

    return run


def repair(df: DataFrame, model: C.Model, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, n_garbled, n_lost, channel, restored) of each text with a wrongly decoded sequence.

    Null, empty, blank and clean texts give no row; every row of a repeated key gives its own.
    ``restored`` has each garbled word replaced by its most likely reading; a word whose
    characters were lost (U+FFFD) stays as it is. Other columns of ``df`` are not read.
    """
    word, suspect = re.compile(C.WORD), re.compile(C.SUSPECT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        known: dict = {}

        def is_strange(w: str) -> bool:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                known[w] = C.strange(w, model)
            return known[w]

        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"]):
                if not suspect.search(t):
                    continue
                words = word.findall(t)
                found = C.posteriors(words, model, memo)
                fixes, lost, seen, odd = {}, 0, Counter(), []
                for w, f in zip(words, found):
                    _, true, channel = f[0]
                    if C.LOST in w or C.CONTROL.search(w) and channel in (C.SAME, C.ALIKE):
                        lost += 1
                    if channel not in (C.SAME, C.ALIKE):
                        fixes[w] = C.restored(w, true, channel, model)
                        seen[f"{channel[1]} read as {channel[0]}"] += 1
                    elif channel == C.SAME and C.LOST not in w:
                        odd.append(w)
                if len({w for w in odd if is_strange(w)}) >= C.CIPHER_WORDS:
                    table = C.cipher(odd, model)
                    own = {w: w.translate(table) for w in odd if w.translate(table) != w}
                    fixes |= own
                    if own:
                        seen[f"text read as {C.CIPHER[0]}"] += len(own)
                if fixes or lost:
                    best = min(seen, key=lambda c: (-seen[c], c)) if seen else None
                    restored = word.sub(lambda m: fixes.get(m[0], m[0]), t) if fixes else t
                    rows.append((k, sum(seen.values()), lost, best, restored))
            yield pd.DataFrame(rows, columns=["k", "n_garbled", "n_lost", "channel", "restored"])

    keys = dict(df.dtypes)[key]
    suspects = df.where(beyond_ascii(F.col(text))).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = spread(suspects).mapInPandas(run, f"k {keys}, n_garbled int, n_lost int, channel string, restored string")
    return out.withColumnRenamed("k", key)


def garbled(df: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """``repair`` with a model learned from the same corpus."""
    return repair(df, fit(df, text), key, text)
