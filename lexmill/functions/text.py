"""Text columns: matches with offsets, line spans, tokens, repair of wrongly decoded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<start:int,end:int,kind:string,value:string>>"
# What ends a line, and what is trimmed from it.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
#: A token: an address or link, a word with inner full stops or signs, or any other single sign;
#: a line end and a run of blanks are tokens too, so no phrase goes across them.
TOKEN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|https?://[^\s]+|[\p{L}\p{N}_]+(?:[.'+#][\p{L}\p{N}_]+)*|\n|  +|[^\s\p{L}\p{N}_]"
)


#: Signs that no text has; a match is put between them.
OPEN, SHUT = "\ufdd0", "\ufdd1"


def matches(text: Column, pattern: str, kind: str | Column) -> Column:
    """All matches of ``pattern`` as (start, end, kind, value), offsets in code points, end exclusive.

    One pass of the pattern over the text: matches are marked in it, and the marked text is cut at the
    marks. The pattern must not match nothing.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = F.lit(kind) if isinstance(kind, str) else kind
    own = F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(SHUT)), F.translate(text, OPEN + SHUT, "\ufffd\ufffd")).otherwise(text)
    parts = F.split(F.regexp_replace(own, rx, F.lit(f"{OPEN}$0{SHUT}")), f"[{OPEN}{SHUT}]")
    step = lambda acc, x: F.struct(  # noqa: E731  every other part is a match
        (~acc["inside"]).alias("inside"), (acc["at"] + F.length(x)).cast("int").alias("at"),
        F.when(acc["inside"], F.concat(acc["out"], F.array(F.struct(
            acc["at"].alias("start"), (acc["at"] + F.length(x)).cast("int").alias("end"), kind.alias("kind"), x.alias("value"))))).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))
    return F.coalesce(F.aggregate(parts, start, step)["out"], F.array().cast(MATCH))


def first_come(found: Column) -> Column:
    """Matches without overlap: each is kept unless it overlaps one kept before it; sorted by start."""
    keep = lambda acc, m: F.when(
        F.exists(acc, lambda k: (m["start"] < k["end"]) & (m["end"] > k["start"])), acc
    ).otherwise(F.concat(acc, F.array(m)))
    return F.array_sort(F.aggregate(found, F.array().cast(MATCH), keep))


def replace_spans(text: Column, spans: Column, placeholder) -> Column:
    """The text with each span (sorted, not overlapping) replaced by ``placeholder(span)``."""
    step = lambda acc, m: F.struct(
        m["end"].alias("at"),
        F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), placeholder(m)
        ).alias("out"),
    )
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def line_spans(text: Column, least: int = 15) -> Column:
    """The trimmed lines of at least ``least`` characters, in order."""
    lines = F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(x, BLANKS, ""))
    return F.filter(lines, lambda x: F.length(x) >= least)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


# The characters of code page 1252 for the bytes 80 to 9F that it defines.
HIGH = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
HIGH_BYTES = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def repair_once(text: Column) -> Column:
    """The text read as UTF-8 from its code page 1252 bytes, where that is possible; else unchanged."""
    page = f"^[\\x00-\\x7f\\u00a0-\\u00ff{HIGH}]*$"
    shown = F.encode(F.translate(text, HIGH, HIGH_BYTES), "ISO-8859-1")
    fixed = F.try_validate_utf8(shown.cast("string"))
    return F.when(text.rlike(r"[^\x00-\x7f]") & text.rlike(page), F.coalesce(fixed, text)).otherwise(text)


def repair(text: Column, passes: int = 4) -> Column:
    """``repair_once`` until nothing changes, ``passes`` times at most."""
    for _ in range(passes):
        text = repair_once(text)
    return text


def escape(text: Column) -> Column:
    """The text as a literal of a regular expression."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\$1")
