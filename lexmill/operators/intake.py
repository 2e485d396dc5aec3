"""Intake of files: hashes, provenance, format dispatch, image statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_hashes(files: DataFrame) -> DataFrame:
    """(resume_id, file_name, sha256) of the supported files of a binary listing, by id."""
    kept = files.where(extension(F.col("path")).isin("pdf", "docx"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return kept.select(stem(F.col("path")).alias("resume_id"), name.alias("file_name"), F.sha2("content", 256).alias("sha256")).orderBy("resume_id")


def provenance(files: DataFrame) -> DataFrame:
    """Provenance rows that only know the file; the rest is filled in by hand."""
    blank = F.lit("")
    return files.where(extension(F.col("path")).isin("pdf", "docx")).select(
        stem(F.col("path")).alias("resume_id"), blank.alias("source_url"), blank.alias("retrieved_at"),
        extension(F.col("path")).alias("format"), blank.alias("layout_bin"), blank.alias("anonymised"), blank.alias("notes"),
    ).orderBy("resume_id")


def insufficient(df: DataFrame, least: int = 100, text: str = "text", fmt: str = "file_format") -> DataFrame:
    """``df`` with ``insufficient_text``: a page format whose text has fewer than ``least`` characters."""
    page = F.regexp_replace(F.lower(F.trim(fmt)), r"^\.", "") == "pdf"
    short = F.length(F.coalesce(text, F.lit(""))) < least
    return df.withColumn("insufficient_text", F.coalesce(page, F.lit(False)) & short)


def image_audit(images: DataFrame, ext: str = "ext", count: str = "image_count", area: str = "area_frac", large: float = 0.9) -> DataFrame:
    """Counts by extension and in total (null extension), in one pass of grouping sets."""
    return images.groupingSets([[F.col(ext)], []], F.col(ext)).agg(
        F.count("*").alias("n_files"), F.count(F.when(F.col(count) > 0, 1)).alias("n_with_images"),
        F.sum(count).alias("n_images"), F.count(F.when(F.col(area) >= large, 1)).alias("n_large"),
    )


def strip_summary(files: DataFrame) -> DataFrame:
    """What removing the images did: files, images, texts that are blank without them."""
    blank = (F.col("text_chars") == 0) & (F.col("image_count") > 0)
    return files.agg(
        F.count("*").alias("n_processed"), F.sum("image_count").alias("n_removed"),
        F.count(F.when(blank, 1)).alias("n_blank"), F.coalesce(F.bool_or(blank), F.lit(False)).alias("any_blank"),
    )
