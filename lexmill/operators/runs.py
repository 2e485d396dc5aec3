"""Redaction of text that is stored as runs: a match may lie across several of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import replace_spans


def offsets(runs: DataFrame, par: str = "par_id", run: str = "run_ix", text: str = "text") -> DataFrame:
    """``runs`` with their (start, end) in the joined text of the paragraph."""
    before = Window.partitionBy(par).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0)).cast("int")
    return runs.withColumn("start", start).withColumn("end", (start + F.length(text)).cast("int"))


def overlaps(placed: DataFrame, found: DataFrame, par: str = "par_id", run: str = "run_ix") -> DataFrame:
    """(par, run, m_start, m_end, kind, a, b, first): each match's part in each run that it touches.

    The join is on the paragraph, so the range condition is only tried within one.
    """
    m = found.select(par, F.col("start").alias("m_start"), F.col("end").alias("m_end"), "kind")
    both = placed.join(m, par).where((F.col("end") > F.col("m_start")) & (F.col("start") < F.col("m_end")))
    order = Window.partitionBy(par, "m_start").orderBy(run)
    return both.select(
        par, run, "m_start", "m_end", "kind",
        (F.greatest("start", "m_start") - F.col("start")).alias("a"), (F.least("end", "m_end") - F.col("start")).alias("b"),
        (F.row_number().over(order) == 1).alias("first"),
    )


def redact(placed: DataFrame, found: DataFrame, labels: dict[str, str], par: str = "par_id", run: str = "run_ix",
           text: str = "text") -> DataFrame:
    """The runs with the placeholder in the first run of each match and the other parts removed."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    cut = overlaps(placed, found, par, run).groupBy(par, run).agg(F.array_sort(F.collect_list(F.struct(
        F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"),
        F.when(F.col("first"), names[F.col("kind")]).otherwise("").alias("put")))).alias("cut"))
    joined = placed.join(cut, [par, run], "left")
    done = replace_spans(F.col(text), F.col("cut"), lambda x: x["put"])
    return joined.select(par, run, F.when(F.col("cut").isNull(), F.col(text)).otherwise(done).alias(text))
