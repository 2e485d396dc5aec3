"""Problem 2: filling fixed-capacity containers with items.

Each task cuts its rows into shards of bounded size and builds a BM25 inverted index of each. The
longest unused text seeds a container; its nearest unused neighbours by BM25 fill the window while
they fit, and the longest unused text that fits closes what remains of it. Only a text longer than
the capacity is split: full pieces have containers of their own, the rest is packed as an item.
Rows are never shuffled; only the number of containers of each shard is, to number them throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import take_bounded, written

#: Texts and characters of one shard; what a task holds in memory at a time.
SHARD_ROWS, SHARD_CHARS = 4096, 24_000_000
#: Rows that the table of capacities may have.
MAX_CAPACITIES = 1000
K1, B = 1.2, 0.75
#: Parameters of the search, not of what is packed: terms of a query (the rarest ones), neighbours that are looked at.
QUERY_TERMS, NEIGHBOURS = 10, 24
TERM = re.compile(r"[^\W_]{3,}")


class Index:
    """The BM25 inverted index of a shard's texts."""

    def __init__(self, texts: list[str]) -> None:
        vocabulary: dict[str, int] = {}
        add = vocabulary.setdefault
        terms, owners, counts, sizes = [], [], [], []
        for i, t in enumerate(texts):
            found = np.array([add(w, len(vocabulary)) for w in TERM.findall(t.lower())], dtype=np.int32)
            sizes.append(len(found))
            own, n = np.unique(found, return_counts=True)
            terms.append(own)
            counts.append(n)
            owners.append(np.full(len(own), i, dtype=np.int32))
        self.n = len(texts)
        self.own = terms
        term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int32)
        tf = np.concatenate(counts).astype(np.float32) if counts else np.zeros(0, np.float32)
        size = np.array(sizes, dtype=np.float32)
        norm = K1 * (1 - B + B * size / max(1.0, float(size.mean()) if len(size) else 1.0))
        order = np.argsort(term, kind="stable")
        self.owner = owner[order]
        df = np.bincount(term, minlength=len(vocabulary))
        self.df = df
        self.idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.weight = (tf * (K1 + 1) / (tf + norm[owner]))[order] * np.repeat(self.idf, df)
        self.start = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, i: int, unused: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` unused texts by falling BM25 score for the ``QUERY_TERMS`` rarest shared terms of text ``i``."""
        own = self.own[i]
        own = own[self.df[own] > 1]
        if not len(own):
            return own
        if len(own) > QUERY_TERMS:
            own = own[np.argpartition(self.df[own], QUERY_TERMS - 1)[:QUERY_TERMS]]
        spans = [slice(self.start[w], self.start[w + 1]) for w in own]
        score = np.bincount(
            np.concatenate([self.owner[s] for s in spans]),
            weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n,
        )
        score[~unused] = 0
        top = np.argpartition(-score, most)[:most] if self.n > most else np.arange(self.n)
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]


class Lengths:
    """The unused items by length: the longest one that fits, in logarithmic time."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sorted = sizes[self.order]
        self.place = np.empty(len(sizes), dtype=np.int64)
        self.place[self.order] = np.arange(len(sizes))
        self.below = list(range(len(sizes) + 1))  # below[p]: root of the used places up to p

    def _find(self, p: int) -> int:
        below = self.below
        root = p
        while below[root] != root:
            root = below[root]
        while below[p] != root:
            below[p], p = root, below[p]
        return root

    def use(self, i: int) -> None:
        p = int(self.place[i]) + 1
        self.below[p] = p - 1

    def longest(self, room: int) -> int:
        """Item of the greatest length up to ``room``; -1 if none is left."""
        p = self._find(int(np.searchsorted(self.sorted, room, "right")))
        return int(self.order[p - 1]) if p else -1


def pack(index: Index, lengths: np.ndarray, capacity: int, most: int = NEIGHBOURS) -> list[tuple[int, int, int, int]]:
    """(item, part, size, container) of a shard's texts; containers count from 0.

    The filling is done with each share of ``SPARE``; the one with the fewest containers counts.
    """
    return min((_pack(index, lengths, capacity, most, spare) for spare in SPARE), key=lambda got: max((x[3] for x in got), default=0))


def _pack(index: Index, lengths: np.ndarray, capacity: int, most: int, spare: float) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    box = 0
    rest = lengths.copy()
    part = np.zeros(len(lengths), dtype=np.int64)
    for i in np.flatnonzero(lengths > capacity):
        while rest[i] > capacity or rest[i] == capacity and part[i]:
            out.append((int(i), int(part[i]), capacity, box))
            rest[i] -= capacity
            part[i] += 1
            box += 1
    unused = rest > 0
    left = Lengths(np.where(unused, rest, 0))
    for i in np.flatnonzero(~unused):
        left.use(int(i))
    sizes = rest.tolist()
    while (seed := left.longest(capacity)) >= 0:
        room = capacity
        chosen = [seed]
        unused[seed] = False
        left.use(seed)
        room -= sizes[seed]
        smallest = left.longest(room)
        if smallest >= 0:
            # Neighbours fill the window as long as a further text can follow or they close it well.
            for j in index.neighbours(seed, unused, most).tolist():
                n = sizes[j]
                if n <= room and (room - n >= spare * capacity or room - n <= CLOSE * capacity):
                    chosen.append(j)
                    unused[j] = False
                    left.use(j)
                    room -= n
                    if room <= CLOSE * capacity:
                        break
            while (j := left.longest(room)) >= 0:
                chosen.append(j)
                unused[j] = False
                left.use(j)
                room -= sizes[j]
        out.extend((j, int(part[j]), sizes[j], box) for j in chosen)
        box += 1
    for i in np.flatnonzero(lengths == 0):
        out.append((int(i), 0, 0, 0))
    return out


#: Room, as a share of the capacity, that a neighbour must leave for a last item (several are tried), or may waste.
SPARE, CLOSE = (0.2, 0.3, 0.5), 0.01


def batches(texts: DataFrame, capacities: DataFrame, key: str = "resume_id", text: str = "text",
            model: str = "model", capacity: str = "char_budget") -> DataFrame:
    """(model, key, part, n_parts, n_chars, batch_index) of each text and model.

    Lengths count code points. A null text has no batch and gives no row; an empty one lies in a
    container of its shard without using room. A text longer than the capacity has several rows.
    Capacities that are null or not positive are no containers. Repeated keys are packed one by one.
    """
    sizes = sorted({
        (m, int(c)) for m, c in take_bounded(capacities.select(model, capacity), MAX_CAPACITIES, "the capacities")
        if m is not None and c is not None and c > 0
    })
    kind = dict(texts.dtypes)[key]
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, shard = TaskContext.get().partitionId(), 0
        for keys, values in _shards(parts):
            index = Index(values)
            lengths = np.array([len(t) for t in values], dtype=np.int64)
            for m, c in sizes:
                got = pd.DataFrame(pack(index, lengths, c), columns=["i", "part", "n_chars", "box"])
                n = got.groupby("i")["part"].transform("count") if len(got) else got["i"]
                yield pd.DataFrame({
                    "model": m, "k": [keys[i] for i in got["i"]], "part": got["part"], "n_parts": n,
                    "n_chars": got["n_chars"], "task": task, "shard": shard, "box": got["box"],
                })
            shard += 1

    schema = f"model string, k {kind}, part int, n_parts int, n_chars int, task int, shard int, box int"
    packed = written(rows.mapInPandas(run, schema), "packed")
    own = packed.groupBy("model", "task", "shard").agg((F.max("box") + 1).alias("n"))
    before = Window.partitionBy("model").orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.select("model", "task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return packed.join(offsets, ["model", "task", "shard"]).select(
        F.col("model").alias(model), F.col("k").alias(key), "part", "n_parts", "n_chars",
        (F.col("first") + F.col("box")).cast("int").alias("batch_index"),
    )


def _shards(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    keys: list = []
    values: list[str] = []
    chars = 0
    for part in parts:
        for k, t in zip(part["k"], part["t"]):
            if values and (len(values) >= SHARD_ROWS or chars + len(t) > SHARD_CHARS):
                yield keys, values
                keys, values, chars = [], [], 0
            keys.append(k)
            values.append(t)
            chars += len(t)
    if values:
        yield keys, values


def sums(packed: DataFrame, capacities: DataFrame, key: str = "resume_id", model: str = "model", capacity: str = "char_budget") -> DataFrame:
    """(model, n_texts, n_chars, n_over): what lies in containers, and containers that hold more than they may."""
    texts = packed.groupBy(model).agg(F.count(F.when(F.col("part") == 0, 1)).alias("n_texts"), F.sum("n_chars").alias("n_chars"))
    full = packed.groupBy(model, "batch_index").agg(F.sum("n_chars").alias("n")).join(capacities.select(model, F.col(capacity).alias("__most")), model)
    return texts.join(full.groupBy(model).agg(F.count(F.when(F.col("n") > F.col("__most"), 1)).alias("n_over")), model)


def split(packed: DataFrame, model: str = "model", key: str = "resume_id") -> DataFrame:
    """(model, key) of the texts that had to be split."""
    return packed.where("n_parts > 1 and part = 0").select(model, key)
