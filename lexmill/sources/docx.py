"""DOCX files as tables of runs, and back: paragraphs, tables, headers, footers, links, images.

A file is unpacked and packed again in Arrow batches with the standard library; what lies between,
finding and replacing, is done on the table of runs by the operators.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import pii, runs
from lexmill.operators.intake import extension, stem
from lexmill.sources.files import WML

# Names of the package format.
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MEDIA = "word/media/"
RUNS = "resume_id string, par_id int, run_ix int, text string, failure string"
LINKS = "resume_id string, part string, rel_id string, target string"


def stories(names: list[str]) -> list[str]:
    """The parts with text: the body, then headers and footers, each once however many sections use it."""
    heads = sorted(n for n in names if n.startswith(("word/header", "word/footer")) and n.endswith(".xml"))
    return ["word/document.xml", *heads]


def paragraphs(root) -> Iterator:
    """The paragraphs of a story: its own first, then those of its tables, cell by cell, nested tables after the cell's own."""
    story = root.find(f"{WML}body")
    story = root if story is None else story
    yield from _paragraphs(story)


def _paragraphs(box) -> Iterator:
    yield from box.findall(f"{WML}p")
    for table in box.findall(f"{WML}tbl"):
        for cell in table.findall(f"{WML}tr/{WML}tc"):
            yield from _paragraphs(cell)


def atoms(paragraph) -> list:
    """The runs of a paragraph in order, those of links included."""
    out = []
    for node in paragraph:
        if node.tag == f"{WML}r":
            out.append(node)
        elif node.tag == f"{WML}hyperlink":
            out += node.findall(f"{WML}r")
    return out


def run_text(run) -> str:
    signs = {f"{WML}tab": "\t", f"{WML}br": "\n", f"{WML}cr": "\n"}
    return "".join(n.text or "" if n.tag == f"{WML}t" else signs.get(n.tag, "") for n in run)


def set_text(run, text: str) -> None:
    """The run with ``text`` as its only content; its format stays."""
    for n in [n for n in run if n.tag in (f"{WML}t", f"{WML}tab", f"{WML}br", f"{WML}cr")]:
        run.remove(n)
    for k, line in enumerate(text.split("\n")):
        if k:
            ET.SubElement(run, f"{WML}br")
        for i, part in enumerate(line.split("\t")):
            if i:
                ET.SubElement(run, f"{WML}tab")
            if part:
                t = ET.SubElement(run, f"{WML}t")
                t.text = part
                t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def parse(data: bytes):
    """The tree of a part, its prefixes remembered so that it is written with the same ones."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), events=["start-ns"]):
        if not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(data)


def pack(root) -> bytes:
    return ET.tostring(root, xml_declaration=True, encoding="UTF-8")


def edited(content: bytes, change: Callable[[str, bytes], bytes | None]) -> bytes:
    """The file with each part given by ``change``; None leaves a part out."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            data = change(info.filename, old.read(info.filename))
            if data is not None:
                new.writestr(info, data)
    return out.getvalue()


def numbered(content: bytes) -> Iterator[tuple[int, int, str]]:
    """(par_id, run_ix, text) of all stories."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        par = 0
        for part in stories(z.namelist()):
            for p in paragraphs(ET.fromstring(z.read(part))):
                yield from ((par, i, run_text(r)) for i, r in enumerate(atoms(p)))
                par += 1


def links(content: bytes) -> list[tuple[str, str, str]]:
    """(part, rel_id, target) of the links that paragraphs use."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        for part in stories(z.namelist()):
            rels = f"word/_rels/{part.split('/')[-1]}.rels"
            if rels in names:
                used = {h.get(LINK) for p in paragraphs(ET.fromstring(z.read(part))) for h in p.iter(f"{WML}hyperlink")}
                out += [(rels, r.get("Id"), r.get("Target")) for r in ET.fromstring(z.read(rels)) if r.get("Id") in used and r.get("Target")]
    return out


def rewritten(content: bytes, texts: dict[tuple[int, int], str], targets: dict[tuple[str, str], str]) -> bytes:
    """The file with new texts of some runs and new targets of some links."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = {n: z.read(n) for n in stories(z.namelist())}
    par, changed = 0, {}
    for name, data in parts.items():
        root = parse(data)
        for p in paragraphs(root):
            for i, r in enumerate(atoms(p)):
                if (par, i) in texts:
                    set_text(r, texts[par, i])
                    changed[name] = root
            par += 1

    def change(name: str, data: bytes) -> bytes:
        if name in changed:
            return pack(changed[name])
        own = {rel: t for (part, rel), t in targets.items() if part == name}
        if own:
            root = parse(data)
            for r in root:
                if r.get("Id") in own:
                    r.set("Target", own[r.get("Id")])
            return pack(root)
        return data

    return edited(content, change)


def without_images(content: bytes) -> tuple[bytes, int, int, int]:
    """(file without images and the relations to them, images before, after, characters of text)."""

    def change(name: str, data: bytes) -> bytes | None:
        if name.startswith(MEDIA):
            return None
        if name.endswith(".rels") and b"media/" in data:
            root = parse(data)
            for r in [r for r in root if r.get("Target", "").startswith("media/")]:
                root.remove(r)
            return pack(root)
        return data

    images = lambda c: sum(n.startswith(MEDIA) for n in zipfile.ZipFile(io.BytesIO(c)).namelist())
    new = edited(content, change)
    return new, images(content), images(new), sum(len(t) for *_, t in numbered(new))


def _docx(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")) == "docx").select(stem(F.col("path")).alias("resume_id"), "content")


def _each(files: DataFrame, rows: Callable[[bytes], list[tuple]], blank: tuple, schema: str) -> DataFrame:
    """Rows of each file with its id; a file that can't be read gives one row with the reason in the last column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, content in zip(batch["resume_id"], batch["content"]):
                try:
                    out += [(k, *r) for r in rows(content)]
                except Exception as e:  # noqa: BLE001  the reason is the result
                    out.append((k, *blank, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return _docx(files).mapInPandas(run, schema)


def run_table(files: DataFrame) -> DataFrame:
    """(resume_id, par_id, run_ix, text, failure) of every run of every story."""
    return _each(files, lambda c: [(*r, None) for r in numbered(c)], (None, None, None), RUNS)


def link_table(files: DataFrame) -> DataFrame:
    """(resume_id, part, rel_id, target, failure) of the links of every file."""
    return _each(files, lambda c: [(*r, None) for r in links(c)], (None, None, None), LINKS + ", failure string")


def _scanned(table: DataFrame, key: str, text: str, names: DataFrame | None) -> DataFrame:
    """Matches of a column of texts, each with the names of its own file."""
    if names is None:
        return pii.scan(table, key=key, text=text)
    own = table.join(names.select("resume_id", "name"), "resume_id").select(key, "name")
    return pii.scan(table, own, key=key, text=text)


def found(files: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Contact data in paragraphs (resume_id, par, kind, value, start, end) and in link targets, ``found`` arrays."""
    whole = run_table(files).where("failure is null").groupBy("resume_id", "par_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ix", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = whole.withColumn("par", F.struct("resume_id", "par_id")).select("resume_id", "par", "text")
    marks = _scanned(whole, "par", "text", names)
    marks = marks.select("resume_id", "par", F.explode("found").alias("m")).select("resume_id", "par", "m.*")
    hrefs = link_table(files).where("failure is null").withColumn("par", F.struct("resume_id", "part", "rel_id"))
    return marks, _scanned(hrefs.select("resume_id", "part", "rel_id", "par", "target"), "par", "target", names)


def counts(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(resume_id, kind, n) of the contact data in each file, links included."""
    marks, hrefs = found(files, names)
    both = marks.select("resume_id", "kind").unionAll(hrefs.select("resume_id", F.explode("found.kind").alias("kind")))
    return both.groupBy("resume_id", "kind").agg(F.count("*").alias("n"))


def redacted(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(resume_id, content): each DOCX file with placeholders for the contact data in its runs and link targets."""
    marks, hrefs = found(files, names)
    table = run_table(files).where("failure is null").withColumn("par_id", F.struct("resume_id", "par_id"))
    placed = runs.offsets(table.select("par_id", "run_ix", "text"))
    done = runs.redact(placed, marks.select(F.col("par").alias("par_id"), "kind", "start", "end"), pii.PLACEHOLDER)
    old = placed.select("par_id", "run_ix", F.col("text").alias("old"))
    new = done.join(old, ["par_id", "run_ix"]).where("text <> old")
    new = new.groupBy(F.col("par_id.resume_id").alias("resume_id")).agg(F.collect_list(F.struct(F.col("par_id.par_id").alias("p"), "run_ix", "text")).alias("runs"))
    to = hrefs.where(F.size("found") > 0).groupBy("resume_id").agg(
        F.collect_list(F.struct("part", "rel_id", pii.redact(F.col("target"), F.col("found")).alias("target"))).alias("targets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, r, t in zip(batch["content"], batch["runs"], batch["targets"]):
                texts = {} if r is None else {(x["p"], x["run_ix"]): x["text"] for x in r}
                targets = {} if t is None else {(x["part"], x["rel_id"]): x["target"] for x in t}
                out.append(rewritten(content, texts, targets) if texts or targets else content)
            yield pd.DataFrame({"resume_id": batch["resume_id"], "content": out})

    joined = _docx(files).join(new, "resume_id", "left").join(to, "resume_id", "left")
    return joined.select("resume_id", "content", "runs", "targets").mapInPandas(run, "resume_id string, content binary")


def stripped(files: DataFrame) -> DataFrame:
    """(resume_id, content, image_count, images_after, text_chars, failure) of each DOCX file without its images."""
    schema = "resume_id string, content binary, image_count int, images_after int, text_chars int, failure string"
    return _each(files, lambda c: [(*without_images(c), None)], (None, None, None, None), schema)


def save(files: DataFrame, folder: str, ending: str = ".docx") -> int:
    """Writes (resume_id, content) rows as one file each into a folder that all executors share; the number of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for k, content in zip(batch["resume_id"], batch["content"]):
                with open(f"{folder}/.{k}{ending}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{folder}/.{k}{ending}.part", f"{folder}/{k}{ending}")
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("resume_id", "content").mapInPandas(run, "n int").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
