"""Problem 7: encoding of the whole corpus with a public tokenizer.

No merge of a byte-pair encoding can cross two bytes that stand side by side in no vocabulary
entry, so such a place is a certain cut. A batch's bytes are cut there with one table lookup,
every distinct fragment is encoded once per worker, and the ids are concatenated. Cuts that
could change how the pattern splits the text into words (after white space, inside a character,
before an apostrophe that does not follow a letter or digit) are not used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import spread

#: Fragments of up to this many bytes are remembered, so many of them at most.
REMEMBERED_BYTES, REMEMBERED = 48, 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Encodes batches of text with the vocabulary at ``path``; ``split`` is its word pattern."""

    _made: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def get(cls, path: str, split: str) -> Encoder:
        if (path, split) not in cls._made:
            cls._made[path, split] = cls(path, split)
        return cls._made[path, split]

    def __init__(self, path: str, split: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros(65536, dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            self.inside[b[:-1] << 8 | b[1:]] = True
        b = np.arange(256)
        blank = (b <= 32) | (b == 0x85) | (b == 0xA0) | (b == 0x7F)
        plain = ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
        left, right = np.divmod(np.arange(65536), 256)
        # A byte of 0x80 and over may end a blank of several bytes, so only ASCII ends a fragment.
        safe = (left < 128) & ~blank[left] & ((right & 0xC0) != 0x80) & ((right != 39) | plain[left])
        self.cut = ~self.inside & safe
        self.known: dict[bytes, list[int]] = {}

    def fragment(self, b: bytes) -> list[int]:
        ids = self.known.get(b)
        if ids is None:
            ids = self.encoding.encode_ordinary(b.decode("utf-8"))
            if len(b) <= REMEMBERED_BYTES:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[b] = ids
        return ids

    def encode(self, column: pa.Array) -> pa.Array:
        """The ids of each text; an empty or null text has none."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data else b""
        ends = offsets - offsets[0]
        b = np.frombuffer(raw, dtype=np.uint8)
        if not len(b):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(column) + 1, np.int32)), pa.array([], pa.int32()))
        places = np.flatnonzero(self.cut[b[:-1].astype(np.int32) << 8 | b[1:]]) + 1
        places = np.union1d(places, ends)
        known, fragment = self.known.get, self.fragment
        bounds = places.tolist()
        parts = [known(raw[i:j]) or fragment(raw[i:j]) for i, j in zip(bounds, bounds[1:])]
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(sizes[-1]))
        at = sizes[np.searchsorted(places, ends)]
        return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))


def encoded(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
            split: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list, blank ones are encoded as they are. Each row gives
    one row, repeated rows and keys included; other columns are not read, nothing is shuffled.
    """
    path, split = path or vocabulary_path(), split or pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path, split)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1))], ["k", "ids"])

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(rows).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
