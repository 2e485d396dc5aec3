"""Problem 8: evaluation texts leaking into training text.

Every document is cut into windows of words. Random-walk (CGK) embeddings turn the edit distance
of windows into Hamming distance; sampled positions of several such embeddings are the keys under
which windows of items and documents meet. Around each meeting the furthest reach for a few wrong
words is followed on all near diagonals at once; pairs that may hold a stretch are aligned exactly
by word-level edit distance. The items are the stated query set: they are sent to the executors in
blocks of bounded size, one scan of the corpus for each block, so no document row is ever shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import small, spread

#: Words of the items that one block may have; a larger set of items takes more scans.
BLOCK_WORDS = 400_000
#: A sentence of so many different items is an instruction, not passage; counted over all items.
BOILERPLATE = 3
#: Shared sentences up to which their list is broadcast; a longer one is joined by shuffle.
SHARED_ROWS = 100_000
WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[/!a-zA-Z][^<>]{0,300}>")
COMPOUND = re.compile(r"[^\W_]+(?:['’‐‑-][^\W_]+)+")
SENTENCE = re.compile(r"(?<=[.?!])[\"'”’)]*\s+")
INVISIBLE = re.compile("[\xad​-‏⁠﻿]")


@dataclass(frozen=True)
class Rule:
    """What counts as a leak, and the sizes of the search."""

    least: int = 25  # words of the passage that a document must have
    stretch: int = 11  # words of a stretch at least; shorter ones are scattered phrases
    wrong: float = 0.14  # share of changed, misspelt or missing words
    window: int = 8
    pairs: int = 4  # neighbouring words of a window that must stand side by side in some item
    walks: int = 8
    positions: int = 5
    drift: int = 1  # diagonals beside that of two windows that met
    seed: int = 17


def words(text: str) -> list[str]:
    """The words of a text without case, punctuation, markup, invisible signs and styled letters."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return WORD.findall(text.lower())


def passage(sentences: list[str], shared: list[bool]) -> str:
    """The sentences without shared ones and questions before and after the passage.

    An item of which nothing else would be left keeps its shared sentences.
    """
    ask = [s.rstrip("\"'”’) ").endswith("?") for s in sentences]
    for out in ([a or b for a, b in zip(ask, shared)], ask):
        keep = [i for i, x in enumerate(out) if not x]
        if keep:
            return " ".join(sentences[keep[0] : keep[-1] + 1])
    return ""


def passages(items: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t): the passage of each item; which sentences are shared is counted over all items."""
    rows = items.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null").distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"]):
                parts = SENTENCE.split(t.strip())
                out += [(k, h, i, s, " ".join(words(s))) for h in [hash(t)] for i, s in enumerate(parts)]
            yield pd.DataFrame(out, columns=["k", "h", "i", "s", "plain"])

    kind = dict(rows.dtypes)["k"]
    sentences = rows.mapInPandas(cut, f"k {kind}, h long, i int, s string, plain string")
    sentences = sentences.withColumn("h", F.xxhash64("k", "h"))
    whole = sentences.groupBy("k", "h").agg(F.array_sort(F.collect_list(F.struct("i", "s", "plain"))).alias("p"))
    by_text = whole.groupBy(F.transform("p", lambda x: x["plain"]).alias("all")).agg(F.lit(1).alias("one"))
    common = by_text.select(F.explode(F.array_distinct("all")).alias("plain")).groupBy("plain").agg(F.count("*").alias("n"))
    common = small(common.where(F.col("n") >= BOILERPLATE), SHARED_ROWS, "shared sentences").withColumn("shared", F.lit(True))
    marked = sentences.join(common, "plain", "left").groupBy("k", "h").agg(
        F.array_sort(F.collect_list(F.struct("i", "s", F.coalesce("shared", F.lit(False)).alias("shared")))).alias("p"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "t": [passage([x["s"] for x in p], [x["shared"] for x in p]) for p in batch["p"]]})

    return marked.select("k", "p").mapInPandas(keep, f"k {kind}, t string")


class Items:
    """A block of items' passages, their embedding tables and the keys of all their windows."""

    def __init__(self, texts: dict[int, str], rule: Rule) -> None:
        self.rule = rule
        lists = {k: words(t) for k, t in texts.items()}
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in lists.values() for w in p}))}
        # A document may have lost the hyphen or apostrophe of a compound; its word then stands for both parts.
        self.compounds: list[list[int]] = []
        for t in texts.values():
            for m in COMPOUND.findall(t.lower()):
                parts = [self.vocabulary.get(w, 0) for w in WORD.findall(m)]
                joined = "".join(WORD.findall(m))
                if all(parts) and joined not in self.vocabulary:
                    self.compounds.append(parts)
                    self.vocabulary[joined] = -len(self.compounds)
        self.names = list(lists)
        self.items = {k: np.array([self.vocabulary[w] for w in p], dtype=np.int32) for k, p in lists.items()}
        # All passages as one array, each with a sign before and after it that equals no word.
        sign = np.array([-1], np.int32)
        self.flat = np.concatenate([sign, *[x for p in self.items.values() for x in (p, sign)]])
        sizes = np.array([len(p) for p in self.items.values()], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64) + 1
        self.last = self.first + sizes
        self.beside = np.zeros(1 << 22, dtype=bool)
        self.beside[self.pair(self.flat[:-1], self.flat[1:])] = True
        self.beside[self.pair(sign, sign)] = False
        random = np.random.default_rng(rule.seed)
        steps = 2 * rule.window
        self.bits = random.integers(0, 2, (rule.walks, steps, len(self.vocabulary) + 1), dtype=np.int8)
        self.picks = [np.sort(random.choice(steps, rule.positions, replace=False)) for _ in range(rule.walks)]
        self.mix = random.integers(1, 2**62, (rule.walks, rule.positions), dtype=np.int64) * 2 + 1
        starts = [np.arange(a, b - rule.window + 1) for a, b in zip(self.first, self.last) if b - a >= rule.least]
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        keys = self.keys(self.flat, starts)
        found = np.unique(np.stack([keys.ravel(), np.repeat(starts, rule.walks)]), axis=1)
        self.sorted_keys, self.places = found[0], found[1]
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self.sorted_keys & (1 << 20) - 1] = True

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of two neighbouring words; different pairs may share one."""
        return (a.astype(np.int64) * 2_654_435_761 + b.astype(np.int64) * 40_503) >> 3 & (1 << 22) - 1

    def keys(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the windows at ``starts``, one column for each walk."""
        r = self.rule
        padded = np.concatenate([np.maximum(ids, 0), np.zeros(1, np.int32)])
        out = np.empty((len(starts), r.walks), dtype=np.int64)
        for walk in range(r.walks):
            at = np.zeros(len(starts), dtype=np.int64)
            key = np.full(len(starts), walk + 1, dtype=np.int64)
            taken = 0
            last = self.picks[walk][-1]
            for step in range(last + 1):
                w = np.where(at < r.window, padded[np.minimum(starts + at, len(ids))], 0)
                if step == self.picks[walk][taken]:
                    key = (key ^ (key >> 29) ^ w) * self.mix[walk][taken]
                    taken += 1
                at += self.bits[walk, step][w]
            out[:, walk] = key ^ (key >> 31)
        return out

    def meetings(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, place in ``flat``) of the windows that share a key with an item's."""
        keys = self.keys(ids, starts)
        row, col = np.nonzero(self.filter[keys & (1 << 20) - 1])
        found = keys[row, col]
        lo = np.searchsorted(self.sorted_keys, found, "left")
        hi = np.searchsorted(self.sorted_keys, found, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
        both = np.unique(np.repeat(row, n) * np.int64(len(self.flat)) + self.places[at])
        return both // len(self.flat), both % len(self.flat)

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """(index into starts, item) pairs whose windows share a key."""
        row, place = self.meetings(ids, starts)
        owner = np.searchsorted(self.first, place, "right") - 1
        return sorted({(int(i), self.names[k]) for i, k in zip(row, owner)})

    def single(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, start: np.ndarray, place: np.ndarray,
               most: int, least: int, drift: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, wrong ones) of the best stretch of ``least`` words through each meeting with its own share of wrong ones kept.

        At most ``most`` words are wrong; words less twice the wrong ones make it the best; (0, 0) where there is none.
        With a ``drift`` both directions start from so many diagonals at once: the stretch is then never too short.
        ``lo``, ``hi``: bounds of the document of each meeting.
        """
        r = self.rule
        owner = np.searchsorted(self.first, place, "right") - 1
        after = self.reach(ids, start, hi, place, self.last[owner], 1, most, drift)
        before = self.reach(ids, start, lo, place, self.first[owner], -1, most, drift)
        words, wrong = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for w in range(most + 1):
            n = np.max([after[a] + before[w - a] for a in range(w + 1)], axis=0)
            better = (n >= least) & (w <= r.wrong * n + 1e-9) & (n - 2 * w > words - 2 * wrong)
            words[better], wrong[better] = n[better], w
        return words, wrong

    def reach(self, ids: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray, last: np.ndarray,
              way: int, most: int, drift: int) -> np.ndarray:
        """Words of the passage from ``place`` that 0, 1, .. ``most`` wrong words reach at best, one row for each number.

        What is reached ends with a right word.

        ``way`` is 1 for what follows the meeting, -1 for what precedes it.
        """
        width = 2 * (drift + most) + 1
        shift = np.arange(width, dtype=np.int32) - np.int32(drift + most)  # passage words less document words
        room = ((end - start) * way)[:, None].astype(np.int32)
        left = ((last - place) * way)[:, None].astype(np.int32)
        off = 0 if way > 0 else -1
        used = np.where(np.abs(shift) <= drift, np.maximum(shift, 0), np.int32(-9_999))[None, :].repeat(len(start), 0)
        d0, p0 = (start + off)[:, None], (place + off)[:, None]
        out = np.zeros((most + 1, len(start)), dtype=np.int64)
        for e in range(most + 1):
            if e:
                new = used + 1  # a changed word
                np.maximum(new[:, 1:], used[:, :-1] + 1, out=new[:, 1:])  # a missing one
                np.maximum(new[:, :-1], used[:, 1:], out=new[:, :-1])  # one more in the document
                used = new
            used[(used > left) | (used - shift > room) | (used - shift < 0)] = -9_999
            row, col = np.nonzero(used >= 0)
            at = used[row, col]
            was = at.copy()
            live = np.arange(len(row))
            while len(live):
                j, k = at[live], row[live]
                i = j - shift[col[live]]
                ok = (j < left[k, 0]) & (i < room[k, 0])
                live, j, i, k = live[ok], j[ok], i[ok], k[ok]
                same = ids[d0[k, 0] + way * i] == self.flat[p0[k, 0] + way * j]
                live = live[same]
                at[live] += 1
            used[row, col] = at
            out[e] = out[e - 1] if e else 0
            np.maximum.at(out[e], row[at > was], at[at > was])
        return out

    def leaks(self, doc: np.ndarray, item: int, around: list[int]) -> tuple[int, int]:
        """(words, wrong ones) of the item's passage in the document, (0, 0) if it is no leak.

        ``around``: word positions of the document near which windows met.
        """
        r, words = self.rule, self.items[item]
        if len(words) < r.least:
            return 0, 0
        reach = len(words) + len(words) // 4 + 8
        lo, hi = max(0, min(around) - reach), min(len(doc), max(around) + reach + r.window)
        return self.best(doc[lo:hi], words)

    def best(self, doc: np.ndarray, words: np.ndarray) -> tuple[int, int]:
        """(words, wrong ones) of the best leak of one stretch, or of two in the same order; else (0, 0).

        Best is the one with most words less twice the wrong ones. What lies between two stretches is
        counted in neither. A stretch of twice ``least`` words, or one beside another of as many as are
        needed, has a part that does as well, so no more wrong words are looked at than so few words may have.
        """
        r = self.rule
        most = int(r.wrong * min(len(words), 2 * r.least + 5) + 1e-9)
        ahead = self.longest(doc, words, most)
        found = (0, 0, 0)
        for w in range(most + 1):
            n = int(ahead[:, w].max())
            if n >= r.least and w <= r.wrong * n + 1e-9:
                found = max(found, (n - 2 * w, n, w))
        # The same search from behind gives the longest stretch from each place on.
        back = self.longest(doc[::-1], words[::-1], most)[::-1, :, ::-1]
        np.maximum.accumulate(np.maximum.accumulate(ahead, axis=0, out=ahead), axis=2, out=ahead)
        back = np.maximum.accumulate(np.maximum.accumulate(back[::-1], axis=0)[:, :, ::-1], axis=2)[::-1, :, ::-1]
        top = [int(ahead[:, w].max()) for w in range(most + 1)]
        rear = [int(back[:, w].max()) for w in range(most + 1)]
        for a in range(most + 1):
            for b in range(most + 1 - a):
                limit = top[a] + rear[b]
                if min(top[a], rear[b]) < r.stretch or limit < r.least or a + b > r.wrong * limit + 1e-9 or limit - 2 * (a + b) <= found[0]:
                    continue
                both = ahead[:, a] + back[:, b]
                n = int(both[(ahead[:, a] > 0) & (back[:, b] > 0)].max(initial=0))
                if n >= r.least and a + b <= r.wrong * n + 1e-9:
                    found = max(found, (n - 2 * (a + b), n, a + b))
        return found[1:]

    def longest(self, doc: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
        """At (d, w, p): words of the longest stretch with w wrong ones that ends after d words of the
        document and p of the passage; 0 where none of ``stretch`` words does.

        A stretch begins and ends with a right word; its wrong words are the word-level edit distance
        between the two sides. The table of a row holds the least passage start for w wrong words at
        passage position p, at (w, p - w): there a missing word only moves along w, and one row of the
        document is a few operations on whole arrays.
        """
        r = self.rule
        size = len(words)
        none = np.int16(1 << 14)
        shape = (most + 1, size + most + 2)  # column c of row w is passage position c + w - most - 1
        same = np.zeros((len(doc), size + 2 * most + 3), bool)
        same[:, most + 2 : most + 2 + size] = doc[:, None] == words[None, :]
        position = (np.arange(shape[1])[None, :] + np.arange(most + 1)[:, None] - most - 1).astype(np.int16)
        begin = np.where(np.arange(most + 1)[:, None] == 0, position - 1, none).astype(np.int16)
        beyond = position > size
        old = np.full(shape, none, np.int16)
        right = np.full((len(doc), *shape), none, np.int16)
        for d, row in enumerate(same):
            hit = np.lib.stride_tricks.as_strided(row, shape, (1, 1))
            now = right[d]
            now[:, 1:] = old[:, :-1]
            np.minimum(now, begin, out=now)
            np.copyto(now, none, where=~hit)
            new = now.copy()
            if most:
                np.minimum(new[1:], old[:-1], out=new[1:])  # a changed word
                np.minimum(new[1:, :-1], old[:-1, 1:], out=new[1:, :-1])  # one word more in the document
                np.minimum.accumulate(new, axis=0, out=new)  # missing words
                new[beyond] = none
            old = new
        out = np.zeros((len(doc) + 1, most + 1, size + 1), np.int16)
        for w in range(most + 1):
            c = most + 1 - w
            n = np.arange(size + 1, dtype=np.int16)[None, :] - right[:, w, c : c + size + 1]
            out[1:, w] = np.where(n >= r.stretch, n, 0)
        return out


def blocks(passages: DataFrame) -> Iterator[dict[int, str]]:
    """The passages in blocks of bounded size, in order of their keys, one at a time on the driver."""
    block: dict[int, str] = {}
    size = 0
    for k, t in passages.orderBy("k", "t").toLocalIterator():
        n = len(t) // 5 + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = {}, 0
        block[k] = block[k] + "\n" + t if k in block else t
        size += n
    if block:
        yield block


def leaked(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_words, n_wrong) of each document row and item of which it has a passage.

    Null and empty texts have none; each row of a repeated document gives its own; items with
    fewer words than ``rule.least`` can't leak; other columns are not read.
    """
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item]
    schema = f"k {kinds[0]}, i {kinds[1]}, n_words int, n_wrong int"
    rows = spread(docs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")))
    found = [rows.mapInPandas(_scan(block, rule), schema) for block in blocks(passages(items, item, item_text))]
    if not found:
        found = [rows.sparkSession.createDataFrame([], schema)]
    return reduce(DataFrame.unionAll, found).withColumnsRenamed({"k": key, "i": item})


_BUILT: dict = {}


def _scan(block: dict[int, str], rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = (rule, tuple(block.items()))
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Items(block, rule)
        index = _BUILT[name]
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield pd.DataFrame(
                    _leaks_of(index, part["k"].tolist(), part["t"].tolist()), columns=["k", "i", "n_words", "n_wrong"]
                )

    return run


def _leaks_of(index: Items, keys: list, texts: list[str]) -> list[tuple]:
    """Leaks of some documents, whose words are searched as one array."""
    r, get = index.rule, index.vocabulary.get
    lists = [[get(w, 0) for w in words(t)] for t in texts]
    for k, x in enumerate(lists):
        if x and min(x) < 0:
            lists[k] = [j for i in x for j in ((i,) if i >= 0 else index.compounds[-i - 1])]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    ends = np.cumsum(sizes)
    ids = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]) if len(ends) else 0)
    if len(ids) < r.window:
        return []
    beside = index.beside[index.pair(ids[:-1], ids[1:])] & (ids[:-1] > 0) & (ids[1:] > 0)
    total = np.concatenate([[0], np.cumsum(beside)])
    starts = np.flatnonzero(total[r.window - 1 :] - total[: len(total) - r.window + 1] >= r.pairs)
    row = np.searchsorted(ends, starts, "right")
    inside = starts + r.window <= ends[row]
    starts, row = starts[inside], row[inside]
    if not len(starts):
        return []
    at, place = index.meetings(ids, starts)
    start, doc = starts[at], row[at]
    owner = np.searchsorted(index.first, place, "right") - 1
    # Meetings of one document and item on about the same diagonal and in about the same place say the same.
    lane = (start - place + len(index.flat)) // 3
    near = ((doc * len(index.first) + owner) * (len(ids) + len(index.flat)) + lane) * (len(ids) // r.window + 1) + start // r.window
    _, one = np.unique(near, return_index=True)
    start, doc, owner, place = start[one], doc[one], owner[one], place[one]
    lo, hi = ends[doc] - sizes[doc], ends[doc]
    # A leak has a stretch with its own share kept, and that a part of less than twice the least length.
    few = int(r.wrong * 2 * r.stretch + 1e-9)
    good = np.flatnonzero(index.single(ids, lo, hi, start, place, few, r.stretch, r.drift)[0])
    shift = np.arange(-r.drift, r.drift + 1)
    good, place = np.repeat(good, len(shift)), (place[good, None] + shift).ravel()
    inside = (place >= index.first[owner[good]]) & (place <= index.last[owner[good]])
    good, place = good[inside], place[inside]
    start, doc, owner, lo, hi = start[good], doc[good], owner[good], lo[good], hi[good]
    n, wrong = index.single(ids, lo, hi, start, place, few, r.stretch, 0)
    start, doc, owner, lo, hi, place, n, wrong = (x[n > 0] for x in (start, doc, owner, lo, hi, place, n, wrong))
    if not len(start):
        return []
    pair, group = np.unique(np.stack([doc, owner]), axis=1, return_inverse=True)
    order = np.lexsort((2 * wrong - n, group))
    best = order[np.searchsorted(group[order], np.arange(pair.shape[1]))]  # of each pair the meeting in the best stretch
    most = int(r.wrong * (index.last - index.first)[owner].max() + 1e-9)
    n, wrong = index.single(ids, lo[best], hi[best], start[best], place[best], most, r.least, 0)
    out = []
    for g, (d, k) in enumerate(pair.T.tolist()):
        found = int(n[g]), int(wrong[g])
        if not found[0]:
            begin = int(ends[d] - sizes[d])
            found = index.leaks(ids[begin : ends[d]], index.names[k], (start[group == g] - begin).tolist())
        if found[0]:
            out.append((keys[d], index.names[k], *found))
    return out
