"""Files as tables. Text formats are read by Spark; DOCX is unpacked in Arrow batches with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import taxonomy as checks
from lexmill.operators.intake import extension, stem
from lexmill.operators.taxonomy import BUCKETS
from lexmill.runtime import take_bounded

# Names of the word-processing markup.
WML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NAME_LINE = r"^\s*([^:]+?)\s*:\s*(.+?)\s*$"
CORPUS = "Category string, Resume string"


def corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """(category, text) of a quoted multi-line CSV with a header, UTF-8."""
    df = spark.read.schema(CORPUS).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return df.select(F.col("Category").alias("category"), F.col("Resume").alias("text"))


def binary(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of all files below a folder, in order of path when listed."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def listing(files: DataFrame) -> DataFrame:
    kept = files.where(extension(F.col("path")).isin("pdf", "docx"))
    return kept.select(stem(F.col("path")).alias("resume_id"), extension(F.col("path")).alias("format"), "path").orderBy("resume_id")


def docx_paragraphs(content: bytes) -> list[str]:
    """The text of body paragraphs, then of every table cell, as one string each."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WML}body")

    def text(p) -> str:
        return "".join(n.text or "" if n.tag == f"{WML}t" else "\t" if n.tag == f"{WML}tab" else "\n" if n.tag == f"{WML}br" else "" for n in p.iter())

    out = [text(p) for p in body.findall(f"{WML}p")]
    for table in body.findall(f"{WML}tbl"):
        for cell in table.findall(f"{WML}tr/{WML}tc"):
            out.append("\n".join(text(p) for p in cell.findall(f"{WML}p")))
    return out


def texts(files: DataFrame) -> DataFrame:
    """(resume_id, text, failure) of the files that can be read; other formats have the reason why not.

    Page formats need a reader that isn't here, so each of them is a failure and none is an empty text.
    """
    other = files.where(extension(F.col("path")) != "docx").select(
        stem(F.col("path")).alias("resume_id"), F.lit(None).cast("string").alias("text"),
        F.concat(F.lit("no reader for ."), extension(F.col("path"))).alias("failure"))
    return docx_texts(files).unionAll(other)


def docx_texts(files: DataFrame) -> DataFrame:
    """(resume_id, text, failure): a file that can't be read has a failure, not an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, content in zip(batch["resume_id"], batch["content"]):
                try:
                    rows.append((k, "\n".join(docx_paragraphs(content)), None))
                except Exception as e:  # noqa: BLE001  the reason is the result
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["resume_id", "text", "failure"])

    docx = files.where(extension(F.col("path")) == "docx").select(stem(F.col("path")).alias("resume_id"), "content")
    return docx.mapInPandas(run, "resume_id string, text string, failure string")


def docx_media(files: DataFrame) -> DataFrame:
    """(resume_id, name, size) of the images stored in each DOCX file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, content in zip(batch["resume_id"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(k, i.filename, i.file_size) for i in z.infolist() if i.filename.startswith("word/media/")]
            yield pd.DataFrame(rows, columns=["resume_id", "name", "size"])

    docx = files.where(extension(F.col("path")) == "docx").select(stem(F.col("path")).alias("resume_id"), "content")
    return docx.mapInPandas(run, "resume_id string, name string, size long")


def names(spark: SparkSession, path: str, ids: str = ".+") -> tuple[DataFrame, DataFrame]:
    """``id: name`` lines as (resume_id, name), and the violations (line_no, problem, line).

    ``ids`` is the form of an id; a line with another one is malformed. Blank lines and lines that begin with # are skipped; the first colon splits; an id that was
    given before is a violation. The list is kept by hand, so it is one partition.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    lines = lines.select((F.col("i") + 1).alias("line_no"), "line").where("trim(line) <> '' and not startswith(trim(line), '#')")
    fits = F.col("line").rlike(NAME_LINE) & F.regexp_extract("line", NAME_LINE, 1).rlike(f"^(?:{ids})$")
    good = lines.where(fits).select("line_no", "line", F.regexp_extract("line", NAME_LINE, 1).alias("resume_id"), F.regexp_extract("line", NAME_LINE, 2).alias("name"))
    first = good.groupBy("resume_id").agg(F.min("line_no").alias("line_no"))
    twice = good.join(first, ["resume_id", "line_no"], "left_anti")
    bad = lines.where(~fits).select("line_no", F.lit("malformed").alias("problem"), "line").unionAll(
        twice.select("line_no", F.lit("duplicate id"), "line"))
    return good.join(first, ["resume_id", "line_no"], "left_semi").select("resume_id", "name"), bad


def yaml_file(path: str) -> dict:
    """A small YAML file of the driver; an empty one is an empty mapping, one that is no YAML a ``ValueError``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        try:
            return yaml.safe_load(f) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"{path}: {e}") from e


def _rows(rows: list[dict], known: set[str]) -> list[dict]:
    if extra := {k for r in rows for k in r} - known:
        raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
    return rows


def taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(skills, aliases) of a taxonomy file; unknown fields are an error."""
    rows = _rows(yaml_file(path).get("skills", []), {"id", "display_name", "family", "aliases", "description"})
    skills = [(r["id"], r["display_name"], r["family"], r.get("description")) for r in rows]
    aliases = [(a, r["id"]) for r in rows for a in r.get("aliases", [])]
    return (spark.createDataFrame(skills, "skill_id string, display_name string, family string, description string"),
            spark.createDataFrame(aliases, "alias string, skill_id string"))


def roles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(role_id, display_name) of each role as listed, and a row for each role, bucket and skill; unknown fields are an error."""
    listed = _rows(yaml_file(path).get("roles", []), {"id", "display_name", "min_core_ratio", *BUCKETS})
    rows = [(r["id"], b, k, w, float(r["min_core_ratio"])) for r in listed for b in BUCKETS for k, w in (r.get(b) or {}).items()]
    return (spark.createDataFrame([(r["id"], r["display_name"]) for r in listed], "role_id string, display_name string"),
            spark.createDataFrame(rows, "role_id string, bucket string, skill_id string, weight int, min_core_ratio double"))


@dataclass
class Taxonomy:
    """A loaded taxonomy: its tables and version."""

    skills: DataFrame
    aliases: DataFrame
    role_names: DataFrame
    roles: DataFrame
    version: str


def load_taxonomy(spark: SparkSession, skills_path: str, roles_path: str) -> Taxonomy:
    """Both files with all checks; every violation is in the one error that is raised."""
    skills, aliases = taxonomy(spark, skills_path)
    names, rows = roles(spark, roles_path)
    s, r = yaml_file(skills_path), yaml_file(roles_path)
    versions = str(r.get("taxonomy_version")), str(s.get("version")), str(r.get("version"))
    bad = [x.line for x in checks.report(checks.violations(skills, aliases, rows, versions, names)).collect()]
    if bad:
        raise ValueError("\n".join(bad))
    return Taxonomy(skills, aliases, names, rows, versions[0])


def labels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Labels of all YAML files below a folder, in the given schema, with the file's name as ``label_file``.

    Missing fields are null; a file that is no YAML has only nulls, so that it fails the checks of its fields.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fieldNames()

    def read(content: bytes) -> dict:
        import yaml

        try:
            found = yaml.safe_load(content)
        except yaml.YAMLError:
            return {}
        return found if isinstance(found, dict) else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [read(c) for c in batch["content"]]
            out = pd.DataFrame([[str(r[f]) if f == "labelled_at" and r.get(f) else r.get(f) for f in fields] for r in rows], columns=fields)
            yield out.assign(label_file=[p.rsplit("/", 1)[-1] for p in batch["path"]])

    return binary(spark, folder, "*.yaml").select("path", "content").mapInPandas(run, f"{schema}, label_file string")


def proposals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "resume_id string, skill_id string, quoted_phrase string, model string, batch_index int, suggested_name string"
    ).json(path, multiLine=True)


def write_json(path: str, data: object) -> None:
    """Writes a file of the driver as a whole or not at all: beside it first, then in its place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=target.parent, suffix=".part")
    try:
        with open(handle, "w", encoding="utf-8") as f:
            json.dump(data, f, indent=2, sort_keys=True)
        os.replace(part, target)
    except BaseException:
        Path(part).unlink(missing_ok=True)
        raise


def write_stubs(stubs: DataFrame, folder: str, most: int = 100_000) -> list[str]:
    """One YAML file for each stub; nothing is written if one of them is there already. Stubs are filled in by hand, so they are few."""
    import yaml

    rows = take_bounded(stubs, most, "the stubs")
    paths = {f"{folder}/{r.resume_id}.yaml": r.asDict() for r in rows}
    if there := sorted(p for p in paths if Path(p).exists()):
        raise FileExistsError(there)
    Path(folder).mkdir(parents=True, exist_ok=True)
    for path, row in paths.items():
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(row, f, sort_keys=False)
    return sorted(paths)


def append_proposals(df: DataFrame, path: str) -> None:
    """Appends proposals as JSON lines; a null name is left out of its line."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def slug(model: str) -> str:
    return re.sub(r"[:/]", "-", model)
