"""Problem 3: personal information inside free text.

Literal anchors (signs, digits, cue words) are found first; around each, a pattern proposes a
span, a validator (Luhn, weighted mod 11, mod 97, digit counts) confirms or doubts it, and the
words before it raise or lower its score. Spans that reach the threshold are reported, and
replaced by a typed placeholder. The texts are read once, without a shuffle.

Stand-in characters (wide digits, look-alike letters, invisible signs) are folded for the search
only; values are cut from the text as stored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import lookalike
from lexmill.llm.common import spread

KINDS = ("email", "id_number", "phone", "address", "name")
THRESHOLD = 0.5
#: Characters of an e-mail address before its sign: the standard allows no more.
LOCAL_MOST = 64
# A letter, or a sign that a wrong decoding has put in the place of one.
L = r"[^\x00-@\[-`{-\x7f\xa0×‐-⁞\u2000-\u200f\u2028-\u202f\u3000]"
WORD = rf"{L}+(?:['’]{L}+)?"

# --- Fixed values: the patterns and cue words ---------------------------------------------
LOCAL = r"[a-z0-9](?:[\w.+\-]*[a-z0-9])?"
HOST = r"[a-z0-9][a-z0-9\-]*"
SIGN = r"\s*@\s*|\s*[\[({]\s*at\s*[\])}]\s*"
POINT = r"\s*\.\s*|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+"
EMAIL = re.compile(
    rf"{LOCAL}(?:{SIGN}){HOST}(?:(?:{POINT}){HOST})*(?:(?:\.|\s+\.\s+|\s*[\[({{]\s*dot\s*[\])}}]\s*|\s+dot\s+)[a-z]{{2,}})(?![\w@])"
    rf"|{LOCAL}\s+at\s+{HOST}(?:\.{HOST})*(?:\s+dot\s+{HOST})+(?![\w@])",
    re.I,
)
EMAIL_ANCHORS = ("@", "(at)", "[at]", "{at}", " at ", "\tat ", " at\t", "\tat\t", "\nat ", " at\n")
LOCAL_BACK = re.compile(r"[\w.+\-]*$", re.I)

NUMBER = re.compile(r"[+(]?\d[\d ().\-/‐‑–\t]*\d")
EXTENSION = re.compile(r"[ ,;\t]*(?:ext\.?|extension|x)[ \t]*\d{1,5}(?!\d)", re.I)
S = r"[ \t]{1,3}"
PHONES = [
    (re.compile(rf"(?:\+|00)\d{{1,3}}(?:[ \-./\t]{{0,3}}\(\d{{1,4}}\))?(?:[ \-./\t]{{0,3}}\d{{1,6}}){{2,6}}"), 0.9, 8, 15),
    (re.compile(rf"\(0?\d{{2,4}}\)(?:{S}|-)?\d{{3,4}}(?:-|{S}|\.)\d{{3,4}}"), 0.8, 10, 11),
    (re.compile(rf"[2-9]\d\d(?:-|\.)\d{{3}}(?:-|\.)\d{{4}}"), 0.7, 10, 10),
    (re.compile(rf"[2-9]\d\d{S}\d{{3}}{S}\d{{4}}"), 0.5, 10, 10),
    (re.compile(rf"0[1-9](?:(?:[.\-]|{S})\d\d){{4}}"), 0.8, 10, 10),
    (re.compile(rf"0\d{{2,4}}/\d{{3,8}}(?:{S}\d{{2,5}})?"), 0.7, 8, 13),
    (re.compile(rf"0\d{{2,4}}(?:{S}\d{{3,6}}){{1,3}}"), 0.7, 10, 11),
    (re.compile(r"[2-9]\d\d[2-9]\d{6}|0[1-9]\d{8,9}"), 0.5, 10, 11),
]
LINE = re.compile(r"[\n|]| / ")
PHONE_CUE = re.compile(r"(?:phone|mobile|mob\.?|tel\.?|telephone|call|cell|fax|desk under|contact|\bm|on|reach me(?: on)?)\W*$", re.I)
NOT_PHONE = re.compile(r"(?<![^\W_])(?:order|batch|pallet|room|release|version|standard|code|grid|ratio|invoice|ticket|item|below|saving|no\.?|number|#)(?![^\W_])\W*[\w./\-]*\W*$", re.I)

ID_ANCHORS = ("passport", "ssn", "social", "personnummer", "tax", "national", "identity", "insurance", "id", "steuer",
              "nino", "cpf", "personal", "identification", "iban", "account", "card")
ID_LABEL = re.compile(
    r"(?:passport|ssn|social\s+security|personnummer|tax\s+(?=n|id)|national\s+id\w*|national\s+insurance|identity\s+(?:no|n[ru]|card)|insurance\s+(?=n)|iban|"
    r"id\s+(?:card|no)|steuer\w*|nino|cpf|personal\s+number|identification\s+n\w*)",
    re.I,
)
ID_AFTER = re.compile(r"[ \t]*(?:number|no\.?|nr\.?|num\.?|id|card|code)?[ \t]*[.:#=]?\s{0,3}", re.I)
IDS = [
    (re.compile(r"[a-z]{2}\s?\d{7}(?![\w])", re.I), "letters"),
    (re.compile(r"[a-z]{2}[ \t]{0,3}\d\d[ \t]{0,3}\d\d[ \t]{0,3}\d\d[ \t]{0,3}[a-d](?!\w)", re.I), "letters"),
    (re.compile(r"\d{3}\.\d{3}\.\d{2,3}-\d{1,2}(?!\d)"), "dotted"),
    (re.compile(r"\d{3}/\d{2,3}/\d{4,6}(?!\d)"), "slashed"),
    (re.compile(r"\d{6}(?:\d\d)?[-+]\d{4}(?!\d)"), "luhn"),
    (re.compile(r"\d{3}([- \t]?)[ \t]{0,2}\d{2}\1[ \t]{0,2}\d{4}(?!\d)"), "ssn"),
    (re.compile(r"[a-z]{2}\d{2}(?:[ ]?[a-z0-9]{4}){3,7}(?:[ ]?[a-z0-9]{1,3})?(?!\w)", re.I), "iban"),
    (re.compile(r"[a-z]{0,3}\d[\d.\-/ ]{4,14}\d[a-z]?(?!\w)", re.I), "other"),
]
IBAN = re.compile(r"(?<![\w])[a-z]{2}\d{2}(?:[ ]?[a-z0-9]{4}){2,7}(?:[ ]?[a-z0-9]{1,3})?(?!\w)", re.I)
CARD = re.compile(r"(?<![\w.+/\-])[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w\-/])")
FREE_IDS = re.compile(r"(?<![\w.+/\-])(?:\d{6}-\d{4}|\d{3}\.\d{3}\.\d{2}-\d)(?![\w\-/])")

TOWN = rf"(?:(?:neu|bad|sankt|saint|st\.?|new|great|little|upper|lower|north|south|east|west)\s+)?{L}+(?:[-'’]{L}+)*"
WAY = (
    r"(?:street|st\.|st|road|rd\.?|lane|ln\.?|avenue|ave\.?|crescent|cres\.?|terrace|terr\.?|close|drive|dr\.?|court|ct\.?|"
    r"way|place|pl\.?|square|sq\.?|gardens|grove|hill|mews|row|walk|boulevard|blvd\.?|parade|quay)(?![^\W_])"
)
CODE = r"[a-z]{1,2}\d{1,2}[a-z]?\s+\d[a-z]{2}(?!\w)|[a-z]{2}\s+\d{5}(?:-\d{4})?(?!\d)"
GAP = r"(?:\s*[,;]\s*|\s*\n\s*|\s*\r\n\s*|\s+/\s+)"
UNIT = r"(?:flat|apt\.?|apartment|unit|suite)\s+\w{1,5}"
STREET = re.compile(
    rf"\d{{1,5}}[a-z]?,?\s+(?:{L}++(?:['’\-]{L}++)*+\s++){{1,4}}?{WAY}(?:{GAP}{UNIT}(?!\w))?"
    rf"(?:{GAP}{TOWN}(?:(?:{GAP}|\s+)(?:{CODE}))?|(?:{GAP}|\s+){TOWN}(?:{GAP}|\s+)(?:{CODE}))",
    re.I,
)
FLAT_BACK = re.compile(r"(?:flat|apt\.?|apartment|unit|suite)\s+\w{1,5}\s*[,;]?\s*$", re.I)
FRENCH = re.compile(
    rf"\d{{1,4}}(?:\s+(?:bis|ter))?\s*[,;]?\s+(?:rue|avenue|impasse|chemin|boulevard|place|all[ée]e|quai|route|cours|passage)\s+"
    rf"(?:{L}[^\s,;]*\s+){{0,4}}{L}[^\s,;]*{GAP}\d{{5}}\s+{TOWN}",
    re.I,
)
#: The way first, then the house: Italian, Spanish, Portuguese; and Dutch ways that end in their kind.
ROMANCE = re.compile(
    rf"(?<![^\W_])(?:via|viale|piazza|corso|vicolo|calle|avenida|avda\.|plaza|paseo|camino|rua|travessa|pra[çc]a|largo)\s+"
    rf"(?:{L}[^\s,;]*\s+){{0,4}}{L}[^\s,;]*[ ,]+\d{{1,4}}(?:\s?[a-z])?{GAP}\d{{4,5}}(?:-\d{{3}})?\s+{TOWN}",
    re.I,
)
DUTCH = re.compile(rf"(?<![^\W_]){L}+(?:straat|laan|plein|gracht|kade|dijk)\s+\d{{1,4}}(?:\s?[a-z])?{GAP}\d{{4}}\s?[a-z]{{2}}\s+{TOWN}", re.I)
ROMANCE_ANCHORS = ("via ", "viale ", "piazza ", "corso ", "vicolo ", "calle ", "avenida ", "avda. ", "plaza ", "paseo ", "camino ", "rua ", "travessa ", "praça ", "praca ", "largo ")
DUTCH_ANCHORS = ("straat ", "laan ", "plein ", "gracht ", "kade ", "dijk ")
GERMAN_TAIL = re.compile(rf"\d{{1,4}}(?:\s?[a-z])?{GAP}\d{{5}}\s+{TOWN}", re.I)
GERMAN_BACK = re.compile(
    rf"(?:(?:am|an|auf|im|in|zum|zur|unter)(?:\s+(?:der|dem|den))?\s+)?{L}+"
    r"(?:gasse|stra\S{1,4}e|strasse|str\.|allee|weg|steig|platz|ring|damm|ufer|hof|markt|graben)\s+$"
    rf"|(?:am|an|auf|im|zum|zur|unter)(?:\s+(?:der|dem|den))?\s+{L}+\s+$",
    re.I,
)
BOX = re.compile(
    rf"(?:p\.?\s?o\.?\s+box|postbox|post\s+box|postfach|bo[iî]te\s+postale)\s+\d{{1,6}}{GAP}{TOWN}(?:(?:{GAP}|\s+)(?:{CODE}))?", re.I
)

TITLES = r"(?:dr|prof|ms|mrs|mr|miss|mx|herr|frau|sir)\b\.?"
CUES = (
    "supervised by", "reported to", "reports to", "line manager was", "line manager is", "manager was", "reference from",
    "referee", "ask", "took over the round from", "round from", "referred by", "recommended by", "contact person",
    "managed by", "mentored by", "led by", "interviewed by", "hired by", "on behalf of", "care of", "attn", "signed by",
)
CUE_ENDS: dict[str, tuple[str, ...]] = {}
for _cue in CUES:
    CUE_ENDS[_cue.split()[-1]] = (*CUE_ENDS.get(_cue.split()[-1], ()), _cue)
SKIP = re.compile(rf"\s+(?:{TITLES}\s+){{0,2}}", re.I)
TITLED = re.compile(rf"(?:{TITLES}\s+)+", re.I)
NAME = re.compile(
    rf"(?P<last>{WORD}(?:-{WORD})*)\s*,\s*(?P<first>{WORD}(?:-{WORD})?)(?:\s+{L}\.)*(?![\w@+\-]|\.\w)"
    rf"|(?:{L}\.|{WORD}(?:-{WORD})?)\s+(?:{L}\.\s*)*(?:(?:van|von|de|der|den|da|di|del|la|le|al|bin|ibn)\s+)*{WORD}(?:-{WORD})*",
    re.I,
)
NAME_FIELD = re.compile(rf"(?:^|[\n|])[ \t]*(?:##|==)?[ \t]*name[ \t]*(?:==[ \t]*(?=\n)|:|(?=\r?\n))\s*(?:[•*>\-]\s+)?(?:{TITLES}\s+)*", re.I)
NO_NAME = frozenset(
    "the a an our my his her their all both two three four five six seven eight nine ten this that these those it me us them "
    "you works head heads staff board team teams clients customers at in on of to for with contact profile skills experience "
    "projects education languages references name and by from new several many".split()
)
#: Words of firms and places: what has one is no person.
FIRM = frozenset(
    "ltd limited inc llc plc gmbh ag sa group partners associates surveyors logistics services systems solutions council university school "
    "college hospital clinic bank trust foundation institute department team office company agency committee ministry centre center "
    "street road lane avenue park house".split()
)
#: Roles that a colon, or the end of the line before, makes a label of the name after them.
LABEL = re.compile(
    r"(?<![^\W_])(?:signed|signature|author|manager|supervisor|mentor|tutor|coach|witness|contact person|contact name|full name|prepared (?:by|for)|attention|attn)[ \t]*$"
)
AFTER_LABEL = re.compile(rf"[ \t]*(?:{TITLES}[ \t]+){{0,2}}", re.I)
DONE = re.compile(r"(?<![^\W_])(?:[^\W\d_]+ed|led|taught|written|overseen|run|driven|chosen|known)\s+$")
CAPITAL = re.compile(r"[^\W\d_a-zß-öø-ÿ][^\W\d_]*(?:['’\-][^\W\d_]+)*")
LOWER_WORDS = frozenset("on for since at in and with from to".split())
# -------------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod11(digits: str) -> bool:
    """The weighted check of nine-digit identity numbers whose last digit (two for eleven) is the check."""
    body, check = digits[:-1], int(digits[-1])
    return sum(int(c) * w for c, w in zip(body, range(len(body) + 1, 1, -1))) * 10 % 11 % 10 == check


def mod97(value: str) -> bool:
    v = re.sub(r"\s", "", value).upper()
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text with stand-in characters folded, and each kept character's place in the original."""
    if text.isascii() or not _SUSPECT.search(text):
        return text, None
    t = lookalike.Tables.get()
    out, at = [], []
    for i, c in enumerate(text):
        cp = ord(c)
        if cp >= 0x80:
            if t.mark[cp]:
                continue
            if t.kind[cp] == lookalike.ALIKE:
                c = chr(t.latin[cp])
            elif t.length[cp] == 0:
                continue
            elif t.fold[cp] != cp:
                c = chr(t.fold[cp]) if t.length[cp] == 1 else t.more[cp]
        for x in c:
            out.append(x)
            at.append(i)
    return "".join(out), at


_SUSPECT = re.compile(lookalike.SUSPECT)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal values of a text, without overlaps, by place."""
    plain, at = folded(text)
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    taken: list[tuple[int, int, str]] = []  # in order of place, without overlaps

    def take(i: int, j: int, kind: str) -> None:
        k = bisect_left(taken, (i, j, kind))
        if (not k or taken[k - 1][1] <= i) and (k == len(taken) or taken[k][0] >= j):
            insort(taken, (i, j, kind))

    spans = [m.span() for m in NUMBER.finditer(plain)]
    _emails(plain, low, take)
    _ids(plain, low, spans, take)
    _addresses(plain, low, take)
    _phones(plain, spans, take)
    _names(plain, low, take)
    if at is None:
        return taken
    out = []
    for i, j, kind in taken:
        a, b = at[i], at[j - 1] + 1
        while b < len(text) and lookalike.Tables.get().mark[ord(text[b])]:
            b += 1
        out.append((a, b, kind))
    return out


def _all(low: str, anchor: str) -> Iterator[int]:
    i = low.find(anchor)
    while i >= 0:
        yield i
        i = low.find(anchor, i + 1)


def _emails(text: str, low: str, take) -> None:
    for anchor in EMAIL_ANCHORS:
        for i in _all(low, anchor):
            k = i
            while k and low[k - 1].isspace():
                k -= 1
            start = LOCAL_BACK.search(text, max(0, k - LOCAL_MOST), k).start()
            while start < k and text[start] in ".+-_":
                start += 1
            m = EMAIL.match(text, start) if start < k else None
            if m and m.end() > i + len(anchor):
                take(m.start(), m.end(), "email")


def _ids(text: str, low: str, spans: list[tuple[int, int]], take) -> None:
    for anchor in ID_ANCHORS:
        for i in _all(low, anchor):
            if i and low[i - 1].isalnum() or not (label := ID_LABEL.match(text, i)):
                continue
            begin = ID_AFTER.match(text, label.end()).end()
            for pattern, check in IDS:
                m = pattern.match(text, begin)
                if m:
                    if LABELLED + _checked(m[0], check) >= THRESHOLD:
                        take(m.start(), m.end(), "id_number")
                    break
    free = [(m, "luhn" if m[0][6] == "-" else "dotted") for m in FREE_IDS.finditer(text)]
    for i, j in spans:
        if j - i >= 13 and (m := CARD.match(text, i)):
            free.append((m, "card"))
        if i > 1 and text[i - 2 : i].isalpha() and (m := IBAN.match(text, i - 2)):
            free.append((m, "iban"))
    for m, check in free:  # without a label only a right check digit counts
        before = text[max(0, m.start() - 24) : m.start()]
        score = FREE + _checked(m[0], check) - (0.5 if NOT_PHONE.search(before) else 0.0)
        if score >= THRESHOLD:
            take(m.start(), m.end(), "id_number")


#: Scores before the check digits: after a label, and without one.
LABELLED, FREE = 0.7, 0.3


def _checked(value: str, check: str) -> float:
    """What the validator of a format adds to the score of a value.

    International account numbers always have a right check, so a wrong one rejects; the other formats are
    also written with typing errors or made-up digits, so there a wrong one only lowers the score, which a
    label outweighs. One digit repeated is no number of anyone.
    """
    digits = re.sub(r"\D", "", value)
    if len(set(digits)) == 1:
        return -0.5
    if check == "luhn":
        return 0.3 if luhn(digits[-10:]) else -0.15
    if check == "card":
        return 0.3 if 13 <= len(digits) <= 19 and luhn(digits) else -0.5
    if check == "dotted":
        return 0.3 if mod11(digits) else -0.15
    if check == "iban":
        return 0.3 if 15 <= len(re.sub(r"\s", "", value)) <= 34 and mod97(value) else -0.5
    if check == "other":
        return -0.1 if 6 <= len(digits) <= 14 else -0.5
    return 0.0


def _addresses(text: str, low: str, take) -> None:
    for i in _all(low, "box"):
        for k in range(max(0, i - 9), i + 1):
            m = None if k and text[k - 1].isalnum() else BOX.match(text, k)
            if m and m.end() > i:
                take(m.start(), m.end(), "address")
                break
    for i in _all(low, "postfach"):
        m = BOX.match(text, i)
        if m:
            take(m.start(), m.end(), "address")
    for anchor in ROMANCE_ANCHORS:
        for i in _all(low, anchor):
            if m := ROMANCE.match(text, i):
                take(m.start(), m.end(), "address")
    for anchor in DUTCH_ANCHORS:
        for i in _all(low, anchor):
            k = i
            while k and low[k - 1].isalpha():
                k -= 1
            if m := DUTCH.match(text, k):
                take(m.start(), m.end(), "address")
    for m in _HOUSE.finditer(text):
        i = m.start()
        found = STREET.match(text, i) or FRENCH.match(text, i)
        if found:
            back = FLAT_BACK.search(text, max(0, i - 24), i)
            take(back.start() if back else i, found.end(), "address")
            continue
        tail = GERMAN_TAIL.match(text, i)
        if tail:
            back = GERMAN_BACK.search(text, max(0, i - 60), i)
            if back:
                take(back.start(), tail.end(), "address")


_HOUSE = re.compile(r"(?<![\w.,/+\-])\d{1,5}(?=[a-z]?\s*[,;]?\s+[^\W_]|\s?[a-z]?\s*[,;])", re.I)


def _phones(text: str, spans: list[tuple[int, int]], take) -> None:
    for i, j in spans:
        if j - i < 8 or i and (text[i - 1].isalnum() or text[i - 1] in "_#"):
            continue
        before = LINE.split(text[max(0, i - 28) : i])[-1]
        alone = not before.strip(" \t•*>-=#") and (j == len(text) or text[j] in "\r\n|" or text[j : j + 3] in (" / ", " | "))
        for pattern, score, least, most in PHONES:
            m = pattern.match(text, i)
            if not m or m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] in "-/" and text[m.end() + 1 : m.end() + 2].isdigit()):
                continue
            digits = re.sub(r"\D", "", m[0])
            if not least <= len(digits) <= most:
                continue
            if alone or PHONE_CUE.search(before):
                score += 0.3
            elif NOT_PHONE.search(before):
                score -= 0.5
            if score >= THRESHOLD:
                more = EXTENSION.match(text, m.end())
                take(i, more.end() if more else m.end(), "phone")
                break


def _names(text: str, low: str, take) -> None:
    """Each place where a name may begin has the score of its context; what stands there adds to it or takes from it."""
    starts: dict[int, float] = {}

    def offer(i: int, score: float) -> None:
        starts[i] = max(score, starts.get(i, 0.0))

    if "name" in low:
        for m in NAME_FIELD.finditer(text):
            offer(m.end(), 0.8)
    for anchor, cues in CUE_ENDS.items():
        n = len(anchor)
        for i in _all(low, anchor):
            if i and low[i - 1].isalpha() or not low[i + n : i + n + 1].isspace():
                continue
            if " ".join(low[max(0, i - 32) : i + n].split()).endswith(cues) and (m := SKIP.match(text, i + n)):
                offer(m.end(), 0.8)
    for title in ("dr", "prof", "ms", "mr", "mrs", "miss", "herr", "frau"):
        n = len(title)
        for i in _all(low, title):
            if not (i and low[i - 1].isalpha()) and low[i + n : i + n + 1] in (".", " ", "\t", "\n") and (m := TITLED.match(text, i)):
                offer(m.end(), 0.8)
    for i in _all(low, "by"):
        if low[i + 2 : i + 3].isspace() and i and low[i - 1].isspace() and DONE.search(low, max(0, i - 24), i) and (m := SKIP.match(text, i + 2)):
            offer(m.end(), 0.4)
    for i in _all(low, ":"):
        if LABEL.search(low, max(0, i - 24), i) and (m := AFTER_LABEL.match(text, i + 1)):
            offer(m.end(), 0.4)
    for i, score in sorted(starts.items()):
        m = NAME.match(text, i)
        if m and (got := _name_end(m[0])) and score + _person(text, i, got) >= THRESHOLD:
            take(i, i + got, "name")


def _person(text: str, i: int, n: int) -> float:
    """What speaks for a person: words that begin with capitals, two or three of them, and none of a firm or place."""
    words = re.findall(r"[^\s,]+", text[i : i + n])
    after = re.match(r"[ \t]+(?:&[ \t]*)?([^\W_]+)", text[i + n : i + n + 24])
    score = 0.2 if 2 <= len(words) <= 4 and CAPITAL.match(words[0]) and CAPITAL.match(words[-1]) and not words[-1].isupper() else -0.2
    if {w.lower().rstrip(".") for w in words} & FIRM or after and (after[1].lower() in FIRM or after[1][:1].isupper() and not text[i : i + n].isupper()):
        score -= 0.3
    return score


def _name_end(value: str) -> int:
    """Length of the name in a proposed span; 0 if it is none."""
    words = re.findall(r"[^\s,]+", value.lower())
    if words[0] in NO_NAME or words[0] in LOWER_WORDS:
        return 0
    if words[-1] in LOWER_WORDS or words[-1] in NO_NAME or len(words) < 2:
        return 0
    return len(value)


def findings(df: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, kind, value, start_pos, end_pos) of every personal value; offsets in code points.

    Null and empty texts give no row; repeated rows give their own. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, kind, t[i:j], i, j) for k, t in zip(batch["k"], batch["t"]) for i, j, kind in find(t)]
            yield pd.DataFrame(rows, columns=["k", "kind", "value", "start_pos", "end_pos"])

    kind = dict(df.dtypes)[key]
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = spread(rows).mapInPandas(run, f"k {kind}, kind string, value string, start_pos int, end_pos int")
    return out.withColumnRenamed("k", key)


def redacted(df: DataFrame, key: str = "resume_id", text: str = "text") -> DataFrame:
    """(key, text, n_values): every row's text with a typed placeholder for each personal value.

    A null text stays null. The rest of the text is unchanged.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, counts = [], []
            for t in batch["t"]:
                spans = find(t) if isinstance(t, str) else []
                for i, j, kind in reversed(spans):
                    t = t[:i] + f"[{kind.upper()}]" + t[j:]
                texts.append(t)
                counts.append(len(spans))
            yield pd.DataFrame({"k": batch["k"], "t": texts, "n_values": counts})

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = spread(rows).mapInPandas(run, f"k {kind}, t string, n_values int")
    return out.withColumnsRenamed({"k": key, "t": text})
