"""Channel model for wrongly decoded words: pure functions, no Spark.

A *channel* is one unknown code-page swap: the bytes of the true text, written in some
encoding, were read with the code page ``wrong``. Every character that ``wrong`` can show is a
cipher symbol (for multi-byte channels the symbol is the whole byte sequence), and a channel
is a substitution table from symbols to letters. The tables start from what the public
code pages suggest and are re-estimated by expectation-maximisation against the character
bigrams of the corpus, so a symbol that the assumed pair of pages does not define still gets
the letter its neighbours ask for.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

# The single-byte code pages that text is most often misread with.
PAGES = (
    "cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "cp1254", "cp1257",
    "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman",
)
UTF8 = "utf-8"
SAME = ("", "")
ALIKE = ("alike", "")
LOST = "�"
# A run of non-ASCII characters; the unit that a wrong decoding turns into something else.
RUN = re.compile(r"[^\x00-\x7f]+")
#: A word with at least one character that a clean English text would not have.
#: It starts at the head of a run of plain characters, so the scan is linear in the text.
WORD = r"(?<![\x21-\x7e•–—])[\x21-\x7e•–—]*+[^\x00-\x7f•–—][^ \t\r\n]*"
SUSPECT = r"[^\x00-\x7f•–—]"
CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")


def _page_tables() -> tuple[dict, dict]:
    """Byte to character and back for every page; undefined bytes show as C1 controls."""
    to_char, to_byte = {}, {}
    for page in PAGES:
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(page))
            except UnicodeDecodeError:
                chars.append(chr(b))
        to_char[page] = chars
        to_byte[page] = {c: b for b, c in reversed(list(enumerate(chars)))}
    return to_char, to_byte


CHARS, BYTES = _page_tables()
SINGLE = tuple((w, t) for w in PAGES for t in PAGES if w != t and CHARS[w] != CHARS[t])


def to_bytes(run: str, page: str) -> bytes | None:
    """The bytes that ``page`` showed as ``run``, or None if it has no such characters."""
    table = BYTES[page]
    try:
        return bytes([table[c] for c in run])
    except KeyError:
        return None


def undo_utf8(word: str, page: str) -> str | None:
    """The word if its runs were UTF-8 read as ``page``; None if a run is no valid UTF-8.

    A lost byte (U+FFFD) or an ASCII-converted no-break space inside the word leaves that
    run as it is, so the rest of the word can still be restored.
    """
    out, last, changed = [], 0, False
    for m in RUN.finditer(word):
        out.append(word[last : m.start()])
        last = m.end()
        fixed = None
        if LOST not in m[0]:
            b = to_bytes(m[0], page)
            if b is not None:
                try:
                    fixed = b.decode(UTF8)
                except UnicodeDecodeError:
                    fixed = None
            if fixed is None:
                fixed = _partly(m[0], page)
        if fixed is None:
            if LOST not in m[0]:
                return None
            fixed = m[0]
        else:
            changed = True
        out.append(fixed)
    return "".join(out) + word[last:] if changed else None


def _partly(run: str, page: str) -> str | None:
    """A run with clean typographic signs at its ends around one garbled stretch."""
    for a in range(len(run)):
        if a and run[a - 1] not in TYPOGRAPHIC:
            break
        for z in range(len(run), a + 1, -1):
            if z < len(run) and run[z] not in TYPOGRAPHIC:
                break
            if (a, z) == (0, len(run)):
                continue
            b = to_bytes(run[a:z], page)
            if b is None:
                continue
            try:
                return run[:a] + b.decode(UTF8) + run[z:]
            except UnicodeDecodeError:
                continue
    return None


# Letters of other scripts that are drawn like a Latin one, and that Latin one.
ALIKE_TABLE = str.maketrans(
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονаеорсухіѕјԁАВЕКМНОРСТХІЅЈ",
    "ABEZHIKMNOPTYXovaeopcyxisjdABEKMHOPCTXISJ",
)
BLANKS = frozenset("\u00a0\u00ad")
TYPOGRAPHIC = frozenset("‘’“”„•–—…«»")


class Model:
    """Bigrams of clean text, channel priors and the learned symbol tables; size-bounded.

    Characters outside the pages' repertoire share one class, so the bigram table has at most
    (256 * pages + 130) squared entries whatever the corpus.
    """

    known = frozenset(c for page in PAGES for c in CHARS[page])
    unknown = "\ufffe"

    def __init__(self) -> None:
        self.pair: dict[str, float] = {}
        self.one: dict[str, float] = {}
        self.total = 1.0
        self.prior: dict[tuple[str, str], float] = {SAME: 0.9}
        self.learned: dict[tuple[str, str], dict[str, str]] = {}
        self._memo: dict[str, float] = {}
        self._tables: dict[tuple[str, str], tuple] = {}

    def fill(self, counts: dict[str, float]) -> None:
        self.pair = dict(counts)
        self.one = defaultdict(float)
        before: dict[str, float] = defaultdict(float)
        for ab, n in counts.items():
            before[ab[0]] += n
            self.one[ab[1]] += n
        self.before = dict(before)
        self.one = dict(self.one)
        self.total = sum(self.one.values()) or 1.0
        self._memo = {}

    def log(self, ab: str) -> float:
        got = self._memo.get(ab)
        if got is None:
            base = (self.one.get(ab[1], 0.0) + 0.02) / (self.total + 50) * odd(ab)
            got = math.log((self.pair.get(ab, 0.0) + 1.5 * base) / (self.before.get(ab[0], 0.0) + 1.5))
            self._memo[ab] = got
        return got

    def score(self, word: str) -> float:
        w = shape(word)
        return sum(self.log(w[i : i + 2]) for i in range(len(w) - 1) if w[i] > "\x7f" or w[i + 1] > "\x7f")


def kind(c: str) -> str:
    if c < "\x80":
        return "L" if c.isalpha() else "l" if c in "\x02\x03" else "d" if c.isdigit() else "p"
    if c in TYPOGRAPHIC:
        return "p"
    if not c.isalpha():
        return "s"
    return "G" if "\u0370" <= c < "\u0400" else "C" if "\u0400" <= c < "\u0530" else "L"


def odd(ab: str) -> float:
    """How much rarer than its letters a pair is: signs, capitals or other scripts in a word."""
    a, b = kind(ab[0]), kind(ab[1])
    if "s" in (a, b) and "L" in (a, b):
        return 0.02
    if len({a, b} & {"L", "G", "C"}) == 2:
        return 0.05
    return 0.05 if a == b == "L" and ab[0].islower() and ab[1].isupper() else 1.0


def shape(word: str) -> str:
    """The word between boundary marks, digits and rare characters folded into classes."""
    return "\x02" + "".join(
        "0" if c.isdigit() and c < "\x7f" else c if c in Model.known else Model.unknown for c in word
    ) + "\x03"


def candidates(word: str, model: Model) -> dict[str, tuple[str, str]]:
    """True words that a channel may have turned into ``word``, each with its first channel.

    Repeated UTF-8 damage is undone up to four times. Restored words with control characters
    are no candidates: no language has them.
    """
    out: dict[str, tuple[str, str]] = {}
    bodies = [r.strip("‘’“”„•–—…«»�") for r in RUN.findall(word)]
    if all(len(r) != 1 for r in bodies) or any(len(r) > 1 for r in bodies if LOST in word):
        frontier = [(word, SAME)]
        for _ in range(4):
            later = []
            for w, first in frontier:
                for page in PAGES:
                    x = undo_utf8(w, page)
                    if x is None or x == w or x in out:
                        continue
                    c = first if first != SAME else (page, UTF8)
                    later.append((x, c))
                    if not CONTROL.search(x):
                        out[x] = c
            frontier = later
            if not frontier:
                break
    if LOST not in word:
        plain = word.translate(ALIKE_TABLE)
        if plain.isascii():
            out.setdefault(plain, ALIKE)
        chars = {c for c in word if c > "\x7f"}
        one = model.one
        if chars <= BLANKS or any(all(c < "\x80" or c in one for c in x) for x, c in out.items() if c[1] == UTF8):
            return out
        for wrong in PAGES:
            table = BYTES[wrong]
            if not all(c in table for c in chars):
                continue
            for true in PAGES:
                if (wrong, true) not in SINGLE_SET:
                    continue
                to = single_table(wrong, true, model)
                if not all(to.get(ord(c), c) in one for c in chars):
                    continue
                x = word.translate(to)
                if x != word and x not in out and not CONTROL.search(x):
                    out[x] = (wrong, true)
    return out


SINGLE_SET = frozenset(SINGLE)


def single_table(wrong: str, true: str, model: Model) -> dict[int, str]:
    """The translate() table of a one-byte channel: what EM has learned, the pages' own letters for symbols it never saw."""
    table = model._tables.get((wrong, true))
    if table is None:
        table = {ord(CHARS[wrong][b]): CHARS[true][b] for b in range(128, 256)}
        table |= {ord(s): z for s, z in model.learned.get((wrong, true), {}).items()}
        model._tables[wrong, true] = table
    return table


def restored(word: str, true: str, channel: tuple[str, str], model: Model) -> str:
    """``word`` with the channel's learned table applied by translate(); ``true`` where the table lacks a symbol.

    A symbol of several characters is folded into one private character first. Repeated damage is undone
    by the same table again.
    """
    if channel[1] != UTF8:
        return true
    got = model._tables.get(channel)
    if got is None:
        sequences = sorted(model.learned.get(channel, {}), key=lambda x: (-len(x), x))
        private = {x: chr(0xF0000 + i) for i, x in enumerate(sequences)}
        table = {ord(private[x]): model.learned[channel][x] for x in sequences}
        rx = re.compile("|".join(map(re.escape, sequences))) if sequences else None
        got = model._tables[channel] = rx, private, table
    rx, private, table = got
    now = word
    for _ in range(4 if rx else 0):
        now = rx.sub(lambda m: private[m[0]], now).translate(table)
        if now == true:
            break
    return now if now == true else true


def aligned(word: str, true: str, page: str) -> list[tuple[str, str]]:
    """(symbol, letter) pairs of a word whose runs were UTF-8 read as ``page`` once; empty if they don't fit."""
    out, i = [], 0
    for z in true:
        n = 1 if z < "\x80" else len(z.encode(UTF8))
        if n > 1 and word[i : i + 1] != z:
            out.append((word[i : i + n], z))
        else:
            n = 1
        i += n
    return out if i == len(word) else []


def strange(word: str, model: Model) -> bool:
    """Whether a word that no channel explains has letters that stand where the bigrams don't want them."""
    w = shape(word)
    pairs = [w[i : i + 2] for i in range(len(w) - 1) if w[i] > "\x7f" or w[i + 1] > "\x7f"]
    plain = any("a" <= c.lower() <= "z" for c in word)
    return plain and bool(pairs) and min(map(model.log, pairs)) < STRANGE


#: Log-likelihood under which a pair is strange; what a cipher and each of its symbols cost, in nats; different
#: words that a cipher must change (fewer could be a name or a single look-alike letter).
STRANGE, CIPHER_COST, SYMBOL_COST, CIPHER_WORDS = -5.5, 14.0, 5.0, 3
CIPHER = ("an unknown page", "")


def between(a: str, b: str, model: Model):
    """How likely each letter of the alphabet is between two characters; an empty one says nothing."""
    import numpy as np

    got = model._tables.get((a, b, ""))
    if got is None:
        left, right = shape(a)[1:-1] if a > "\x03" else a, shape(b)[1:-1] if b > "\x03" else b
        logs = np.array([(model.log(left + z) if left else 0.0) + (model.log(z + right) if right else 0.0) for z in ALPHABET])
        got = model._tables[a, b, ""] = np.exp(logs - logs.max()) + 1e-12
    return got


def cipher(words: list[str], model: Model, rounds: int = 8) -> dict[int, str]:
    """The translate() table of one source under an unknown code page; empty if none explains its words better.

    Expectation-maximisation: each symbol starts with all letters alike, gets the letters that its neighbours'
    bigrams expect, and the neighbours follow. The table must gain more likelihood than it takes to write it
    down, send different symbols to different letters, and leave no pair of letters that the corpus lacks.
    """
    import numpy as np

    own = sorted({c for w in words for c in w if c > "\x7f" and c.isalpha()})
    place = {s: i for i, s in enumerate(own)}
    share = np.full((len(own), len(ALPHABET)), 1.0 / len(ALPHABET))
    best = {s: s for s in own}
    for turn in range(rounds):
        seen = np.full_like(share, 1e-6)
        for w in words:
            for i, s in enumerate(w):
                if s in place:
                    # In the first turn a neighbour that is a symbol itself says nothing.
                    a = "\x02" if i == 0 else best.get(w[i - 1], w[i - 1]) if turn or w[i - 1] not in place else ""
                    b = "\x03" if i + 1 == len(w) else best.get(w[i + 1], w[i + 1]) if turn or w[i + 1] not in place else ""
                    p = share[place[s]] * between(a, b, model)
                    seen[place[s]] += p / p.sum()
        share = seen / seen.sum(axis=1, keepdims=True)
        found = {s: ALPHABET[int(share[k].argmax())] for s, k in place.items()}
        if found == best:
            break
        best = found
    changed = {s: z for s, z in best.items() if s != z}
    if not changed or len(set(best.values())) < len(best):
        return {}
    table = {ord(s): z for s, z in changed.items()}
    words = sorted({w for w in words if w.translate(table) != w})
    gain = 0.0
    for w in words:
        x = w.translate(table)
        gain += model.score(x) - model.score(w)
        y = shape(x)
        if any(model.pair.get(y[i : i + 2], 0) <= 0 for i in range(len(y) - 1) if y[i] > "\x7f" or y[i + 1] > "\x7f"):
            return {}
    return table if len(words) >= CIPHER_WORDS and gain > CIPHER_COST + SYMBOL_COST * len(changed) else {}


def readings(word: str, model: Model, slack: float = 18.0) -> list[tuple[float, str, tuple[str, str]]]:
    """(log-likelihood, true word, channel) of the word itself and of each likely candidate.

    A candidate whose likelihood is ``slack`` nats under the best, priors included, can't win
    in any source and is left out.
    """
    got = [(model.score(word), word, SAME)]
    got += [(model.score(x), x, c) for x, c in candidates(word, model).items()]
    top = max(g[0] + (0 if g[2] == SAME else -4) for g in got)
    return [g for g in got if g[2] == SAME or g[0] > top - slack]


def scored(word: str, model: Model, memo: dict) -> list[tuple[float, str, tuple[str, str]]]:
    got = memo.get(word)
    if got is None:
        if len(memo) > 200_000:
            memo.clear()
        got = memo[word] = readings(word, model)
    return got


def posteriors(words: list[str], model: Model, memo: dict) -> list[list[tuple[float, str, tuple[str, str]]]]:
    """For each word of one source its readings as (probability, true word, channel), best first.

    The source's own channel weights are estimated in two inner rounds from all its words,
    so a word that is ambiguous alone follows its neighbours.
    """
    lists = [scored(w, model, memo) for w in words]
    if all(len(found) == 1 for found in lists):
        return [[(1.0, w, SAME)] for w in words]
    own: dict[tuple[str, str], float] = {}
    out: list = []
    for _ in range(3):
        seen, out = defaultdict(float), []
        for found in lists:
            logs = [f[0] + math.log(own.get(f[2]) or model.prior.get(f[2], 1e-6)) for f in found]
            top = max(logs)
            weights = [math.exp(max(-60.0, x - top)) for x in logs]
            total = sum(weights)
            out.append(sorted(((w / total, f[1], f[2]) for w, f in zip(weights, found)), key=lambda x: (-x[0], x[1])))
            for w, f in zip(weights, found):
                seen[f[2]] += w / total
        own = {c: (v + 2 * model.prior.get(c, 1e-6)) / (len(words) + 2) for c, v in seen.items()}
    return out


def expected(found: list[tuple[float, str, tuple[str, str]]], word: str, n: float, model: Model, out: dict) -> None:
    """Adds the expected counts of a word seen ``n`` times: bigrams, channels, symbol-letter pairs."""
    logs = [f[0] + math.log(model.prior.get(f[2], 1e-6)) for f in found]
    top = max(logs)
    weights = [math.exp(max(-60.0, x - top)) for x in logs]
    total = sum(weights)
    for weight, (_, true, channel) in zip(weights, found):
        p = weight / total
        if p < 1e-3:
            continue
        w = shape(true)
        for i in range(len(w) - 1):
            if (w[i] > "\x7f" or w[i + 1] > "\x7f") and Model.unknown not in w[i : i + 2]:
                out["b", w[i : i + 2], ""] += p * n
        out["c", channel[0], channel[1]] += p * n
        if channel[1] == UTF8:
            for s, z in aligned(word, true, channel[0]):
                out["s", channel[0] + "|" + UTF8, s + "|" + z] += p * n
        elif channel[1]:
            for s, z in zip(word, true):
                if s > "\x7f":
                    out["s", channel[0] + "|" + channel[1], s + "|" + z] += p * n
                    for alt, share in letters_for(true, z, model):
                        out["s", channel[0] + "|" + channel[1], s + "|" + alt] += p * n * share


def letters_for(true: str, z: str, model: Model) -> list[tuple[str, float]]:
    """Other letters for a symbol whose page value no bigram supports."""
    i = true.find(z)
    left, right = (true[i - 1] if i else "\x02"), (true[i + 1] if i + 1 < len(true) else "\x03")
    if model.pair.get(left + z, 0) + model.pair.get(z + right, 0) > 0:
        return []
    best, a = max((model.log(left + a) + model.log(a + right), a) for a in ALPHABET if a != z)
    return [(a, 2.0)] if best > model.log(left + z) + model.log(z + right) + 3 else []


ALPHABET = tuple(sorted({c for p in ("cp1252", "cp1250", "iso8859-15") for c in CHARS[p][128:] if c.isalpha()}))


def update(model: Model, counts: dict[tuple[str, str, str], float]) -> Model:
    """The M-step: bigrams, channel priors and symbol tables from summed expected counts."""
    new = Model()
    new.fill({k[1]: v for k, v in counts.items() if k[0] == "b"})
    channels = {(k[1], k[2]): v for k, v in counts.items() if k[0] == "c"}
    total = sum(channels.values()) + 1.0
    new.prior = {c: max(1e-6, v / total) for c, v in channels.items()}
    best: dict = defaultdict(list)
    for (kind, channel, sz), v in counts.items():
        if kind == "s":
            best[channel, sz[:-2]].append((v, sz[-1]))
    for (channel, s), found in best.items():
        wrong, _, true = channel.partition("|")
        usual = page_letter(s, wrong, true)
        # What the pages say counts as so many sightings; the bigrams may outweigh it.
        v, z = max((v if z == usual else min(v, v - USUAL) / 3, z) for v, z in found)
        if v > 0.5:
            new.learned.setdefault((wrong, true), {})[s] = z
    return new


#: Sightings of another letter that the pages' own letter of a symbol is worth.
USUAL = 20.0


def page_letter(symbol: str, wrong: str, true: str) -> str | None:
    """The letter that the two pages suggest for a symbol."""
    b = to_bytes(symbol, wrong)
    try:
        return b.decode(UTF8) if b is not None and true == UTF8 else CHARS[true][b[0]] if b else None
    except UnicodeDecodeError:
        return None


def first_model(counts: dict[str, float]) -> Model:
    model = Model()
    model.fill(counts)
    model.prior = {SAME: 0.9, ALIKE: 0.01} | {(p, UTF8): 0.004 for p in PAGES} | {c: 0.00015 for c in SINGLE}
    return model


def plain_start(word: str) -> bool:
    """Whether a word may count as clean before anything is learned."""
    if LOST in word or CONTROL.search(word):
        return False
    return all(undo_utf8(word, page) is None for page in PAGES)
