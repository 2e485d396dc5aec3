"""Problem 5: mapping freely typed values to a canonical list.

The list is small and fixed, so its symmetric-delete dictionary (every form with up to k letters
left out) is sent to the executors after a check of its size. A typed value is cut into runs of
words; a run is looked up by its own deletes, and the entries found are ranked by how much of the
value they explain, by a weighted Damerau-Levenshtein distance and by how often the corpus names
the entry. Values that no entry is near to are reported as misses.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import small, take_bounded

#: Rows that the reference list may have, and entries of its dictionary (some hundred bytes each); both are
#: checked, because the dictionary is sent to every executor.
MAX_LIST, MAX_DELETES = 50_000, 4_000_000
#: Typed words that a listed name may be torn into, beyond its own number.
TORN = 2
NONE = "NONE"
# Little words that carry no meaning of their own in a name.
SMALL = frozenset("a an and at by for from in of on or the to with".split())
VOWELS = frozenset("aeiouy")
SPLIT = re.compile(r"[^\W_]+(?:-?\.)?")
#: Deletes are taken of the first letters of a form only; the distance is checked on all of it.
PREFIX = 8
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[a-z])(?=[A-Z]{2,}$)")


def parts(value: str) -> list[str]:
    """The words of a typed value in small letters; a cut word keeps its full stop."""
    value = unicodedata.normalize("NFKC", value)
    return [w.lower().replace("-.", ".") for w in SPLIT.findall(HUMP.sub(" ", value))]


def deletes(word: str, k: int) -> set[str]:
    """The word with up to ``k`` letters left out."""
    out = {word}
    edge = {word}
    for _ in range(k):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))} - out
        out |= edge
    return out


def bound(n: int) -> int:
    """Edits allowed in a form of ``n`` letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance from typed ``a`` to listed ``b``; above ``most`` it is inexact.

    Swapped neighbours, doubled letters and confused vowels cost less than other edits.
    """
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most + 1:
        return most + 1
    # What both begin and end with costs nothing; one letter is kept on the left for doubled ones.
    p, n = 0, min(len(a), len(b))
    while p < n and a[p] == b[p]:
        p += 1
    q = 0
    while q < n - p and a[-1 - q] == b[-1 - q]:
        q += 1
    p = max(0, p - 1)
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    if len(a) > 2 * most + 3 and len({*a} & {*b}) < min(len({*a}), len({*b})) - most:
        return most + 1
    band = int(most) + 2  # a path beside it has more insertions or deletions than are allowed
    far = most + 9.0
    before: list[float] = []
    row = [min(float(j), far) for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        older, before = before, row
        twice = 0.6 if i and a[i - 1] == x else 0.9
        row = [far] * (len(b) + 1)
        if i < band:
            row[0] = before[0] + 1
        best = row[0]
        for j in range(max(0, i - band), min(len(b), i + band + 1)):
            y = b[j]
            v = before[j] + (0.0 if x == y else 0.8 if x in VOWELS and y in VOWELS else 1.0)
            w = before[j + 1] + twice
            if w < v:
                v = w
            w = row[j] + (0.6 if j and b[j - 1] == y else 0.9)
            if w < v:
                v = w
            if i and j and x == b[j - 1] and a[i - 1] == y:
                v = min(v, older[j - 1] + 0.8)
            row[j + 1] = v
            if v < best:
                best = v
        if best > most + 0.85:
            return most + 1
    return row[-1]


def code_points(forms: list[str]) -> np.ndarray:
    """One row of code points for each form, filled up with zeros."""
    width = max(map(len, forms), default=0) or 1
    return np.array(forms, dtype=f"U{width}").view(np.uint32).reshape(len(forms), width)


def letter_sets(points: np.ndarray) -> np.ndarray:
    """The letters of each form as bits; letters outside the alphabet share some."""
    bit = np.where((points >= 97) & (points < 123), points - 97, 26 + points % 6).astype(np.uint32)
    return np.bitwise_or.reduce(np.where(points > 0, np.uint32(1) << bit, np.uint32(0)), axis=1)


def distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``distance`` of many pairs at once, rows of code points; inexact above ``most``."""
    n, (la, lb) = len(a), ((a > 0).sum(axis=1), (b > 0).sum(axis=1))
    vowel = np.zeros(128, bool)
    vowel[[*map(ord, VOWELS)]] = True
    is_vowel = [(x < 128) & vowel[np.minimum(x, 127)] for x in (a, b)]
    band, far = most + 2, np.int16(10 * most + 90)
    twice = [np.where((x[:, 1:] == x[:, :-1]) & (x[:, 1:] > 0), np.int16(6), np.int16(9)) for x in (a, b)]
    width = int(lb.max(initial=0))
    row = [np.full(n, min(10 * j, far), np.int16) for j in range(width + 1)]
    out = np.full(n, far, np.int16)
    before: list = []
    for i in range(int(la.max(initial=0))):
        older, before = before, row
        row = [None] * (width + 1)
        row[0] = before[0] + np.int16(10) if i < band else np.full(n, far)
        x, lost = a[:, i], twice[0][:, i - 1] if i else np.int16(9)
        for j in range(max(0, i - band), min(width, i + band + 1)):
            y = b[:, j]
            v = np.where(x == y, np.int16(0), np.where(is_vowel[0][:, i] & is_vowel[1][:, j], np.int16(8), np.int16(10)))
            v += before[j] if before[j] is not None else far
            if before[j + 1] is not None:
                np.minimum(v, before[j + 1] + lost, out=v)
            if row[j] is not None:
                np.minimum(v, row[j] + (twice[1][:, j - 1] if j else np.int16(9)), out=v)
            if i and j and older[j - 1] is not None:
                swapped = (x == b[:, j - 1]) & (a[:, i - 1] == y)
                np.minimum(v, np.where(swapped, older[j - 1] + np.int16(8), far), out=v)
            row[j + 1] = v
            np.copyto(out, v, where=(la == i + 1) & (lb == j + 1))
    return out / 10


@dataclass
class Names:
    """The list's forms with their deletes, and how often each entry is named."""

    listed: list[str]  # forms: the joined words of a name in each order
    owners: list[list[str]]  # entries of each form
    deletes: dict[str, list[int]]  # delete of a form's first letters -> forms
    entries: dict[str, str]  # canonical id in lower case -> id
    weight: dict[str, float]
    words: dict[str, list[tuple[str, str]]] = field(default_factory=dict)  # initials -> [(words, entry)]
    whole: dict[str, str] = field(default_factory=dict)  # longer names in their own order
    longest: int = 1  # words of the longest name
    memo: dict = field(default_factory=dict)
    found: dict = field(default_factory=dict)
    read: dict = field(default_factory=dict)
    places: dict = field(default_factory=dict)

    @classmethod
    def make(cls, listed: list[tuple[str, str]], counts: dict[str, int]) -> Names:
        cut: dict[str, set] = defaultdict(set)
        exact: dict[str, set] = defaultdict(set)
        longest = 1
        for text, entry in listed:
            words = [w.rstrip(".") for w in parts(text)]
            if not words:
                continue
            longest = max(longest, len(words))
            orders = {tuple(words)}
            main = [w for w in words if w not in SMALL]
            if 1 < len(main) <= 4:
                orders |= set(permutations(main))
                if len(words) <= 4:
                    orders |= set(permutations(words))
            if len(words) > 1:  # "tuning of queries" is also typed "queries, tuning of"
                orders |= {tuple(words[i:] + words[:i]) for i in range(1, len(words))}
            for order in orders:
                exact["".join(order)].add(entry)
                cut["".join(w[0] for w in order)].add((" ".join(order), entry))
            if len(words) > 2:  # the last word of a cut name may be lost
                cut["".join(w[0] for w in words[:-1])].add((" ".join(words[:-1]), entry))
        forms = sorted(exact)
        dictionary: dict[str, list[int]] = defaultdict(list)
        size = 0
        for i, form in enumerate(forms):
            own = deletes(form[:PREFIX], bound(len(form)))
            size += len(own)
            if size > MAX_DELETES:
                raise ValueError(f"the dictionary of the canonical list has more than {MAX_DELETES} entries; it can't be sent to every executor")
            for d in own:
                dictionary[d].append(i)
        total = sum(counts.values()) + 1
        whole = {"".join(w.rstrip(".") for w in parts(t)): e for t, e in sorted(listed, reverse=True)}
        return cls(forms, [sorted(exact[f]) for f in forms], dict(dictionary), {e.lower(): e for _, e in listed},
                   {e: counts.get(e, 0) / total for _, e in listed}, {k: sorted(v) for k, v in cut.items()},
                   {k: v for k, v in whole.items() if len(k) > 7}, longest)

    def __post_init__(self) -> None:
        self.number = {f: i for i, f in enumerate(self.listed)}
        self.points = code_points(self.listed)
        self.letters = letter_sets(self.points)
        self.sizes = np.array([len(f) for f in self.listed], dtype=np.int64)
        self.bounds = np.array([bound(len(f)) for f in self.listed], dtype=np.int64)

    def look_up(self, forms: set[str]) -> None:
        """Remembers for each form (cost, entry, listed form) of the entries within its bound."""
        if len(self.memo) > 300_000:
            self.memo.clear()
            self.found.clear()
            self.read.clear()
            self.places.clear()
        new = sorted((f for f in forms if f not in self.memo), key=lambda f: (len(f), f))
        self.memo.update((f, []) for f in new)
        new = [f for f in new if bound(len(f))]
        for at in range(0, len(new), 4000):
            self._look_up(new[at : at + 4000])

    def _look_up(self, forms: list[str]) -> None:
        near = []
        for f in forms:
            start = f[:PREFIX], bound(len(f))
            got = self.places.get(start)
            if got is None:
                found = {i for d in deletes(*start) for i in self.deletes.get(d, ())}
                got = self.places[start] = np.fromiter(sorted(found), np.int32, len(found))
            near.append(got)
        left = np.repeat(np.arange(len(forms)), [len(x) for x in near])
        right = np.concatenate(near)
        size = np.array([len(f) for f in forms])[left]
        most = np.minimum(np.array([bound(len(f)) for f in forms])[left], self.bounds[right])
        points = code_points(forms)
        letters = letter_sets(points)[left]
        own = self.letters[right]
        ok = (np.abs(size - self.sizes[right]) <= most) & (np.bitwise_count(letters & ~own) <= most) & (np.bitwise_count(own & ~letters) <= most)
        left, right, most = left[ok], right[ok], most[ok]
        for k in (1, 2):
            i, j = left[most == k], right[most == k]
            for at in range(0, len(i), 20_000):
                a, b = i[at : at + 20_000], j[at : at + 20_000]
                cost = distances(points[a], self.points[b], k)
                for n in np.flatnonzero(cost <= k + 0.05).tolist():
                    form, listed = forms[a[n]], self.listed[b[n]]
                    self.memo[form] += [(float(cost[n]), entry, listed) for entry in self.owners[b[n]]]

    def shortened(self, words: list[str]) -> list[tuple[float, str, str]]:
        """Entries whose words begin as the typed ones do, where a typed word ends in a full stop."""
        out = []
        if len(words) > 1 or len(words[0]) > 5:
            for listed, entry in self.words.get("".join(w[0] for w in words), ()):
                cost = 0.0
                for a, b in zip(words, listed.split()):
                    n = len(a) - 1
                    if a[-1] == ".":
                        cost += 0.3 + min(distance(a[:-1], b[:m], 2) for m in (n - 1, n, n + 1))
                    else:
                        cost += distance(a, b, 2)
                    if cost > 2.2:
                        break
                if cost <= (2.2 if len(listed) > 9 else 1.4):
                    out.append((cost, entry, listed.replace(" ", "")))
        return out

    def runs(self, value: str) -> tuple[list[str], list[tuple[int, int, int, str]]]:
        """The words of a typed value, and (letters, from, to, joined words) of its runs, longest first.

        ``wanted`` and then ``find`` ask for them, so they are kept for the second time.
        """
        got = self.read.pop(value, None)
        if got is None:
            got = self.read[value] = self._runs(value)
        return got

    def _runs(self, value: str) -> tuple[list[str], list[tuple[int, int, int, str]]]:
        words = parts(value)
        bare = [w.rstrip(".") for w in words]
        runs = []
        for i in range(len(words)):
            form = ""
            for j in range(i, min(len(words), i + self.longest + TORN)):
                form += bare[j]
                runs.append((len(form), i, j + 1, form))
        return words, sorted(runs, key=lambda r: (-r[0], r[1]))

    def wanted(self, value: str) -> set[str]:
        """The forms that the reading of a value looks up."""
        out = set()
        _, runs = self.runs(value)
        whole = max((n for n, *_, f in runs if f in self.number), default=0)
        for n, *_, form in runs:
            if n + 2 < whole:
                break
            out.add(form)
            if form[-1:] == "s" and n > 4:
                out |= {form[:-1], form[:-2]} if form[-2:] == "ss" else {form[:-1]}
        return out

    def find(self, value: str) -> tuple[str | None, float]:
        """(entry, quality) of the best reading of a typed value; (None, 0) if none is near."""
        got = self.found.get(value)
        if got is None:
            got = self.found[value] = self._find(value)
        return got

    def _find(self, value: str) -> tuple[str | None, float]:
        words, runs = self.runs(value)
        best: tuple = ()

        def offer(cost: float, entry: str, listed: str) -> None:
            nonlocal best
            rank = (len(listed) - 2.5 * cost, -cost, self.weight[entry], entry)
            if not best or rank > best[0]:
                best = (rank, entry)

        for *_, form in runs:  # the delete of no letter
            if form in self.number:
                for entry in self.owners[self.number[form]]:
                    offer(0.0, entry, form)
        for n, i, j, form in runs:
            if best and n + 2 < best[0][0]:  # no shorter run can explain more
                break
            if form not in self.number:
                for hit in self.near(form):
                    offer(*hit)
            if form[-1:] == "s" and n > 4:
                for cut, extra in ((1, 0.1), (2, 0.2)) if form[-2:] == "ss" else ((1, 0.1),):
                    for cost, entry, listed in self.near(form[:-cut]):
                        offer(cost + extra, entry, listed)
            if any(w[-1] == "." for w in words[i:j]):
                for hit in self.shortened(words[i:j]):
                    offer(*hit)
        if best:
            return best[1], best[0][0]
        if max(map(len, words), default=0) > 9:  # words run together: every part of them is looked up
            joined = "".join(w.rstrip(".") for w in words)
            for n in sorted({len(f) for f in self.whole if len(f) <= len(joined)}, reverse=True):
                found = [joined[i : i + n] for i in range(len(joined) - n + 1) if joined[i : i + n] in self.whole]
                if found:
                    return self.whole[min(found)], n / 2
        return None, 0.0

    def near(self, form: str) -> list[tuple[float, str, str]]:
        """(cost, entry, listed form) of the entries within the bound of the joined words."""
        if form in self.number:
            return [(0.0, e, form) for e in self.owners[self.number[form]]] + [x for x in self._memo(form) if x[2] != form]
        return self._memo(form)

    def _memo(self, form: str) -> list[tuple[float, str, str]]:
        if form not in self.memo:
            self.look_up({form})
        return self.memo[form]

    def decide(self, typed_id: str | None, values: list[str | None]) -> str:
        """The entry that a row's fields mean, or ``NONE``."""
        scores: dict[str, float] = defaultdict(float)
        if typed_id is not None and typed_id.strip() and typed_id.strip().upper() != "NEW":
            plain = typed_id.strip().lower()
            entry = self.entries.get(plain)
            if entry:
                return entry
            entry, quality = self.find(typed_id)
            if entry:
                scores[entry] += 2 * quality
        for value in values:
            if value is not None and value.strip():
                entry, quality = self.find(value)
                if entry:
                    scores[entry] += quality
        if not scores:
            return NONE
        return min(scores, key=lambda e: (-scores[e], -self.weight[e], e))


def names(skills: DataFrame, aliases: DataFrame, mentions: DataFrame) -> Names:
    """The dictionary of a canonical list; ``mentions`` gives the frequency of each entry."""
    listed = [(r.form, r.entry) for r in take_bounded(
        aliases.selectExpr("alias form", "skill_id entry")
        .unionAll(skills.selectExpr("display_name", "skill_id")).unionAll(skills.selectExpr("skill_id", "skill_id"))
        .dropna().distinct(), MAX_LIST, "the canonical list")]
    known = mentions.join(small(skills.select("skill_id").distinct(), MAX_LIST, "the list of entries"), "skill_id", "left_semi")
    counts = {r.skill_id: r.n for r in take_bounded(
        known.groupBy("skill_id").agg(F.count("*").alias("n")), MAX_LIST, "the list of entries")}
    return Names.make(sorted(listed), counts)


def mapped(proposals: DataFrame, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(proposal_id, skill_id) of each proposal whose own skill_id is no canonical one.

    ``NONE`` if no entry is meant, also where all fields are null or blank. Each row gives one
    row, repeated ones included. Other columns are not read.
    """
    known = names(skills, aliases, proposals)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            typed = {v for c in ("s", "q", "n") for v in batch[c] if v is not None} - known.found.keys()
            known.look_up(set().union(*map(known.wanted, typed)))
            yield batch.assign(skill_id=[known.decide(s, [q, n]) for s, q, n in zip(batch["s"], batch["q"], batch["n"])])

    own = small(skills.select(F.col("skill_id").alias("own")).dropna().distinct(), MAX_LIST, "the list of entries")
    rows = proposals.join(own, F.col("skill_id") == F.col("own"), "left_anti").select(
        F.col("proposal_id").alias("k"), F.col("skill_id").alias("s"),
        F.col("quoted_phrase").alias("q"), F.col("suggested_name").alias("n"),
    )
    # Equal rows are decided once. Typed values are short and the lookup is long: every core gets its share.
    spark = proposals.sparkSession
    n = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = rows.select("s", "q", "n").distinct().repartition(n, F.xxhash64("s", "q", "n"))
    decided = distinct.mapInPandas(run, "s string, q string, n string, skill_id string")
    decided = decided.select(*[F.col(c).alias(f"_{c}") for c in ("s", "q", "n")], "skill_id")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("s", "q", "n")]
    return rows.join(decided, same).select(F.col("k").alias("proposal_id"), "skill_id")
