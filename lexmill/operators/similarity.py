"""Vector extraction: each span takes its nearest skill, if that is near enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexmill.runtime import take_bounded

#: Skill vectors are a short list that every executor gets; scores that a task holds at a time.
SKILL_ROWS, CELLS = 200_000, 4_000_000


def nearest(spans: DataFrame, skills: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, label, score) of the most similar skill of each span; equal scores by label.

    The skills are a list whose size is checked; each task has their unit vectors as one matrix and
    scores a batch of spans by one product of matrices, a bounded part at a time. Nothing is shuffled.
    A null vector has no label and no score; a zero one scores 0 with all.
    """
    rows = take_bounded(skills.select(label, F.col(vector).cast("array<double>").alias("v")).dropna().orderBy(label), SKILL_ROWS, "the skill vectors")
    kinds = dict(spans.dtypes)[key], dict(skills.dtypes)[label]
    if not rows:
        return spans.select(key, F.lit(None).cast(kinds[1]).alias(label), F.lit(None).cast("double").alias("score")).limit(0)
    labels = pa.array([r[0] for r in rows], to_arrow_type(skills.schema[label].dataType))
    known = _units(np.array([r.v for r in rows], dtype=np.float64)).T
    part = max(1, CELLS // len(labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                own = batch.slice(at, part)
                valid = own.filter(own.column(1).is_valid())
                mine = np.array(valid.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(valid.num_rows, known.shape[0])
                best, score = np.zeros(own.num_rows, np.int64), np.zeros(own.num_rows)
                there = own.column(1).is_valid().to_numpy(zero_copy_only=False)
                if valid.num_rows:
                    found = np.round(_units(mine) @ known, 12)  # the order of sums must not decide between equal scores
                    best[there] = found.argmax(axis=1)
                    score[there] = found.max(axis=1)
                named = labels.take(pa.array(best, mask=~there))
                yield pa.RecordBatch.from_arrays([own.column(0), named, pa.array(score, mask=~there)], [key, label, "score"])

    rows = spans.select(key, F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{key} {kinds[0]}, {label} {kinds[1]}, score double")


def _units(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def above(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    return found.where(F.col("score") > threshold)
