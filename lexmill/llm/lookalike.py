"""Problem 6: visually identical text with different characters.

A batch of Arrow text becomes one numpy array of code points. Lookup-table gathers fold styled,
wide and joined forms and blanks, expansion offsets make room for folds of several letters and
close the gaps of invisible characters, accents are composed by a search in the table of pairs,
and letters of another script are replaced where whole-array token counts show that they stand
in Latin text. No Python call is made per row.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import beyond_ascii, spread

# Letters that are drawn like a Latin one, alone or inside a Latin word ...
STRICT = (
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονАВЕЗКМНОРСТУХІЅЈҮаеорсухіѕјԁһԛԝӏ",
    "ABEZHIKMNOPTYXovABE3KMHOPCTYXISJYaeopcyxisjdhqwl",
)
# ... and letters that pass for one only inside a Latin word.
LOOSE = ("αγικρτυχωкмнтгпивоԍɡɑ", "ayikptuxwkmhtrnubogga")
#: Characters that never are a case; a text of only these is not looked at.
HARMLESS = "\\x00-\\x7f\\u00a1-\\u00ac\\u00ae-\\u0131\\u0134-\\u0148\\u014a-\\u017f•–—‘’“”„…€™"
SUSPECT = f"[^{HARMLESS}]"
#: A text of nothing else, as Arrow writes patterns; bytes that are no UTF-8 do not match.
ONLY_HARMLESS = r"\A[" + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", HARMLESS) + r"]*\z"
FOLDED_TAGS = ("<font>", "<wide>", "<narrow>", "<circle>", "<initial>", "<medial>", "<final>", "<isolated>")
LETTER, ALIKE, LOOSELY, OTHER = 1, 2, 3, 4


class Tables:
    """Lookup tables over all code points, built once per worker from the Unicode database."""

    _made = None

    @classmethod
    def get(cls) -> Tables:
        if cls._made is None:
            cls._made = cls()
        return cls._made

    def __init__(self) -> None:
        size = sys.maxunicode + 1
        self.fold = np.arange(size, dtype=np.uint32)  # first character of the fold
        self.length = np.ones(size, dtype=np.uint8)  # characters of the fold, 0 for invisible ones
        self.more: dict[int, str] = {}  # folds of more than one character, and where each begins in one array of them all
        self.begin = np.zeros(size, dtype=np.int32)
        self.kind = np.zeros(size, dtype=np.uint8)
        self.mark = np.zeros(size, dtype=bool)
        self.joiner = np.zeros(size, dtype=bool)  # scripts and signs in which joiners have a meaning
        pairs = {}
        for cp in range(0xA0, size):
            if 0xAC00 <= cp < 0xD7B0 or 0x3400 <= cp < 0xA000 or 0xD800 <= cp < 0xE000 or 0x20000 <= cp < 0x3FFFF:
                continue
            c = chr(cp)
            kind = unicodedata.category(c)
            if kind == "Cn":
                continue
            parts = unicodedata.decomposition(c)
            if kind == "Zs":
                self.put(cp, " ")
            elif kind in ("Zl", "Zp"):
                self.put(cp, "\n")
            elif kind == "Cf" and not 0x600 <= cp < 0x610 or cp in (0x34F, 0x115F, 0x1160, 0x3164) or 0xFE00 <= cp < 0xFE10:
                self.put(cp, "")
            elif parts:
                tag = parts.split()[0]
                joined = 0xFB00 <= cp <= 0xFB17 or 0x2160 <= cp <= 0x217F or cp in (0x132, 0x133, 0x149) or 0x1C4 <= cp <= 0x1CC
                if tag in FOLDED_TAGS or tag == "<compat>" and joined:
                    self.put(cp, unicodedata.normalize("NFKC", c))
                elif tag[0] != "<":
                    whole = [chr(int(x, 16)) for x in parts.split()]
                    if len(whole) == 1:
                        self.put(cp, unicodedata.normalize("NFC", c))
                    elif unicodedata.normalize("NFC", "".join(whole)) == c:
                        pairs[ord(whole[0]) << 21 | ord(whole[1])] = cp
            if kind[0] == "M" and 0x300 <= cp < 0x370:
                self.mark[cp] = True
            if kind[0] == "L":
                self.kind[cp] = LETTER if "LATIN" in unicodedata.name(c, "") else OTHER
        for a in [*range(65, 91), *range(97, 123)]:
            self.kind[a] = LETTER
        for cp in map(ord, LOOSE[0]):
            self.kind[cp] = LOOSELY
        for cp in map(ord, STRICT[0]):
            self.kind[cp] = ALIKE
        self.latin = np.arange(size, dtype=np.uint32)
        for a, b in (LOOSE, STRICT):
            self.latin[[*map(ord, a)]] = [*map(ord, b)]
        self.joiner[0x600:0x1100] = self.joiner[0x1800:0x18B0] = self.joiner[0x1F000:0x1FB00] = True
        self.joiner[0x2600:0x27C0] = self.joiner[0xFE0F] = self.joiner[0xA800:0xAC00] = True
        at = 0
        for cp, to in self.more.items():
            self.begin[cp] = at
            at += len(to)
        self.long = np.array([ord(c) for to in self.more.values() for c in to], dtype=np.uint32)
        self.pairs = np.array(sorted(pairs), dtype=np.uint64)
        self.composed = np.array([pairs[k] for k in sorted(pairs)], dtype=np.uint32)

    def put(self, cp: int, to: str) -> None:
        self.length[cp] = len(to)
        self.fold[cp] = ord(to[0]) if to else 0
        if len(to) > 1:
            self.more[cp] = to


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column without nulls, and the bounds of its rows among them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, before[offsets - offsets[0]]


def to_column(points: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The string column of code points and row bounds."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    offsets = np.concatenate([[0], np.cumsum(width)])[bounds].astype(np.int64)
    return pa.Array.from_buffers(
        pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    )


def _by_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] > total[bounds[:-1]]


def unify(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The column in one consistent form, and which rows had a character that stands for another.

    The column has no nulls. Empty rows stay empty. Typographic quotes, dashes, bullets, signs,
    composed letters and words of another script stay as they are.
    """
    t = Tables.get()
    points, bounds = code_points(column)
    touched = np.zeros(len(bounds) - 1, dtype=bool)
    if not len(points):
        return column, touched
    # Fold, expand and delete; joiners and selectors stay where a script or sign needs them.
    length = t.length[points].astype(np.int64)
    gone = length == 0
    if gone.any():
        near = np.zeros(len(points), dtype=bool)
        needed = t.joiner[points] & ~gone
        near[1:] |= needed[:-1]
        keep = gone & near & np.isin(points, (0x200C, 0x200D, 0xFE0E, 0xFE0F))
        length[keep] = 1
        gone &= ~keep
    folded = t.fold[points]
    kept = (length == 1) & (t.length[points] == 0)
    folded[kept] = points[kept]
    touched |= _by_row((folded != points) | (length != 1), bounds)
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.repeat(folded, length)
    wide = np.flatnonzero(length > 1)
    if len(wide):
        n = length[wide]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(start[wide], n) + step] = t.long[np.repeat(t.begin[points[wide]], n) + step]
    points, bounds = out, start[bounds]
    # Compose accents with the letter before them.
    head = np.zeros(len(points) + 1, dtype=bool)
    head[bounds] = True
    for _ in range(4):
        marks = np.flatnonzero(t.mark[points] & ~head[: len(points)])
        marks = marks[marks > 0]
        if not len(marks):
            break
        key = points[marks - 1].astype(np.uint64) << np.uint64(21) | points[marks].astype(np.uint64)
        at = np.minimum(np.searchsorted(t.pairs, key), len(t.pairs) - 1)
        hit = t.pairs[at] == key
        first = np.concatenate([[True], np.diff(marks) > 1]) if len(marks) > 1 else np.array([True])
        hit &= first
        if not hit.any():
            break
        points = points.copy()
        points[marks[hit] - 1] = t.composed[at[hit]]
        drop = np.zeros(len(points), dtype=bool)
        drop[marks[hit]] = True
        touched |= _by_row(drop, bounds)
        moved = np.concatenate([[0], np.cumsum(~drop)])
        points, bounds = points[~drop], moved[bounds]
        head = np.zeros(len(points) + 1, dtype=bool)
        head[bounds] = True
    # Letters of another script in Latin text.
    kind = t.kind[points]
    if ((kind == ALIKE) | (kind == LOOSELY)).any():
        points, swapped = _latin(points, kind, head, t)
        touched |= _by_row(swapped, bounds)
    return to_column(points, bounds), touched


def _latin(points: np.ndarray, kind: np.ndarray, head: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Look-alikes replaced in words that also have Latin letters, or stand among Latin words."""
    letter = kind > 0
    before = np.concatenate([[False], letter[:-1]])
    begins = letter & (~before | head[: len(points)])
    token = np.cumsum(begins) - 1
    n = int(begins.sum())
    counts = [np.bincount(token[kind == k], minlength=n) for k in (LETTER, ALIKE, LOOSELY, OTHER)]
    latin, alike, loosely, other = counts
    mixed = (latin > 0) & (other == 0)
    alone = (latin == 0) & (loosely == 0) & (other == 0) & (alike > 0)
    row = np.cumsum(head[: len(points)])[np.flatnonzero(begins)]
    foreign = (loosely + other > 0) & (latin == 0)
    beside = np.zeros(n, dtype=bool)
    beside[1:] |= foreign[:-1] & (row[1:] == row[:-1])
    beside[:-1] |= foreign[1:] & (row[1:] == row[:-1])
    swap = letter & ((kind == ALIKE) | (kind == LOOSELY)) & (mixed | alone & ~beside)[np.maximum(token, 0)]
    return np.where(swap, t.latin[points], points), swap


def unified(df: DataFrame, key: str, text: str, only_changed: bool = False) -> DataFrame:
    """(key, text, changed) with the text in one consistent form.

    A null text stays null and is never changed; other columns are not read; repeated rows each
    give their own. With ``only_changed`` just the rows with a stand-in character come out; texts
    of ASCII do not leave the JVM, and one pattern over a batch leaves out others that can't have one.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    if only_changed:
        rows = rows.where(beyond_ascii(F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if only_changed:
                batch = batch.filter(pc.invert(pc.match_substring_regex(batch.column(1), ONLY_HARMLESS)))
                if not batch.num_rows:
                    continue
            column = batch.column(1)
            fixed, touched = unify(pc.fill_null(column, ""))
            fixed = pc.if_else(pc.is_valid(column), fixed, pa.scalar(None, pa.large_string())).cast(pa.string())
            out = pa.RecordBatch.from_arrays([batch.column(0), fixed, pa.array(touched)], ["k", "t", "changed"])
            yield out.filter(out.column(2)) if only_changed else out

    out = spread(rows).mapInArrow(run, f"k {kinds[key]}, t string, changed boolean")
    return out.withColumnsRenamed({"k": key, "t": text})
