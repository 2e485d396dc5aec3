"""What the corpus operators share with the core: tables, durable results, size checks; and a test for ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.runtime import shared_dir, small, spread, table, take_bounded, written

__all__ = ["beyond_ascii", "shared_dir", "small", "spread", "table", "take_bounded", "written"]


def beyond_ascii(text: Column) -> Column:
    """Whether a text has more than ASCII, from its bytes: the JVM's patterns take many times as long.

    Bytes that are no UTF-8 count, so they are not passed over; a null text gives null.
    """
    return (F.octet_length(text) > F.length(text)) | ~F.is_valid_utf8(text)
