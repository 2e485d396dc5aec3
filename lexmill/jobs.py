"""Command-line jobs. Each gives an exit code: 0, or 1 where its gate fails; ``python -m lexmill.jobs NAME --help``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import settings
from lexmill.operators import agreement, contracts, corpus, gazetteer, intake, labels, ladder, pii, responses, scoring, taxonomy
from lexmill.runtime import session, written
from lexmill.sources import docx, files

IDS = r"(?:prac|exam)_[0-9]{3}"
JOBS: dict[str, tuple[Callable, list[tuple]]] = {}


def job(*arguments: tuple):
    def add(f):
        JOBS[f.__name__.replace("_", "-")] = f, list(arguments)
        return f

    return add


def arg(*names: str, **kw) -> tuple:
    return names, kw


TAXONOMY = (arg("--skills", required=True), arg("--roles", required=True))
FOLDER = arg("folder")
NAMES = arg("--names-file")


def say(lines: Iterable[str]) -> None:
    """Lines of a report, one at a time from the executors, so that its length doesn't matter here."""
    for line in lines:
        print(line)


def lines(df: DataFrame) -> Iterable[str]:
    return (r[0] for r in df.toLocalIterator())


def complain(text: str) -> int:
    print(f"error: {text}", file=sys.stderr)
    return 1


def _names(spark: SparkSession, path: str | None, known: DataFrame | None = None) -> DataFrame | None:
    """The names of a file kept by hand; a bad one is an error, ids without a file are warnings."""
    if path is None:
        return None
    if not Path(path).exists():
        raise ValueError(f"names file not found: {path}")
    good, bad = files.names(spark, path, IDS)
    first = bad.orderBy("line_no").first()
    if first:
        raise ValueError(f"names file, line {first.line_no}: {first.problem}")
    if known is not None:
        for r in good.join(known.select("resume_id"), "resume_id", "left_anti").orderBy("resume_id").toLocalIterator():
            print(f"warning: no file for the named id {r.resume_id}", file=sys.stderr)
    return good


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return files.binary(spark, folder)


def _same(a: str, b: str) -> bool:
    return Path(a).resolve() == Path(b).resolve()


@job(*TAXONOMY)
def validate_taxonomy(spark, a) -> int:
    """All checks on both files; the counts if there is nothing to report."""
    try:
        t = files.load_taxonomy(spark, a.skills, a.roles)
    except ValueError as e:
        return complain(f"taxonomy\n{e}")
    n = taxonomy.counts(t.skills, t.aliases, t.role_names).first()
    print(f"taxonomy {t.version}: {n.n_skills} skills, {n.n_roles} roles, {n.n_aliases} aliases")
    return 0


@job(*TAXONOMY)
def report_orphan_skills(spark, a) -> int:
    """Skills that no role uses, by family."""
    t = files.load_taxonomy(spark, a.skills, a.roles)
    rows = taxonomy.orphans(t.skills, t.roles).orderBy("family").collect()
    print(f"skills in no role: {sum(r.n for r in rows)}")
    say(f"  {r.family} ({r.n}): {r.skills}" for r in rows)
    return 0


@job(FOLDER, NAMES)
def scan_pii(spark, a) -> int:
    """Contact data in the files' text by kind and offset; values are not printed."""
    own = _listed(spark, a.folder)
    found = files.texts(own)
    scanned = pii.scan(found.select("resume_id", F.coalesce("text", F.lit("")).alias("text")), _names(spark, a.names_file, files.listing(own)))
    say(lines(pii.detail(scanned).orderBy("resume_id").select(F.format_string("%s: %d match(es): %s", "resume_id", "n", "detail"))))
    say(lines(pii.exploded(scanned).orderBy("resume_id", "start").select(F.format_string("  %s %-9s offset=%d", "resume_id", "kind", "start"))))
    say(lines(found.where("failure is not null").orderBy("resume_id").select(F.format_string("%s: not read: %s", "resume_id", "failure"))))
    return 0


@job(arg("--input-dir", required=True), arg("--output-dir", required=True), NAMES, arg("--write", action="store_true"))
def redact_resumes(spark, a) -> int:
    """What redaction finds, and with ``--write`` the redacted files; files of other formats stop it before anything is written."""
    if _same(a.input_dir, a.output_dir):
        return complain("--output-dir must not be --input-dir")
    own = _listed(spark, a.input_dir)
    names = _names(spark, a.names_file, files.listing(own))
    bad = files.texts(own).where("failure is not null").orderBy("resume_id").select(F.format_string("%s: %s", "resume_id", "failure"))
    if a.write and (first := bad.first()):
        return complain(first[0])
    say(lines(docx.counts(own, names).orderBy("resume_id", "kind").select(F.format_string("%s %s=%d", "resume_id", "kind", "n"))))
    if a.write:
        print(f"files written: {docx.save(docx.redacted(own, names), a.output_dir)}")
    return 0


@job(arg("--original-dir", required=True), arg("--redacted-dir", required=True), NAMES)
def verify_redaction(spark, a) -> int:
    """Gate: as many files as before, nothing found in them any more, no image left."""
    old, new = _listed(spark, a.original_dir), _listed(spark, a.redacted_dir)
    names = _names(spark, a.names_file, files.listing(new))
    bad = [f"{a.original_dir} has {n} files, {a.redacted_dir} {m}"] if (n := files.listing(old).count()) != (m := files.listing(new).count()) else []
    left = docx.counts(new, names).groupBy("resume_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", "n"))), ", ").alias("d"))
    rows = left.select(F.format_string("%s: still found: %s", "resume_id", "d").alias("line"))
    images = files.docx_media(new).groupBy("resume_id").count().select(F.format_string("%s: %d image(s) left", "resume_id", "count"))
    unread = files.texts(new).where("failure is not null").select(F.format_string("%s: %s", "resume_id", "failure"))
    bad += list(lines(rows.unionAll(images).unionAll(unread).orderBy("line")))
    for line in bad:
        complain(line)
    if not bad:
        print("nothing is left")
    return int(bool(bad))


@job(FOLDER)
def audit_images(spark, a) -> int:
    """Images stored in each file and their sizes, then the sums."""
    own = _listed(spark, a.folder)
    media = files.docx_media(own)
    say(lines(media.orderBy("resume_id", "name").select(F.format_string("%s %s %d bytes", "resume_id", "name", "size"))))
    listed = files.listing(own)
    n = listed.join(media.groupBy("resume_id").count(), "resume_id", "left")
    n = n.agg(F.count("*").alias("files"), F.count("count").alias("some"), F.coalesce(F.sum("count"), F.lit(0)).alias("images")).first()
    by = ", ".join(f".{r.format}: {r['count']}" for r in listed.groupBy("format").count().orderBy("format").collect())
    print(f"files: {n.files} ({by})\nfiles with an image: {n.some}\nimages: {n.images}")
    return 0


@job(arg("--in-dir", required=True), arg("--out-dir", required=True))
def strip_images(spark, a) -> int:
    """Copies of the files without images; fails where one is left or a file can't be read."""
    if _same(a.in_dir, a.out_dir):
        return complain("--in-dir and --out-dir are the same folder")
    done = written(docx.stripped(_listed(spark, a.in_dir)), "stripped")
    docx.save(done.where("failure is null"), a.out_dir)
    say(lines(done.orderBy("resume_id").select(F.format_string("%s: removed=%d remaining=%d text_chars=%d", "resume_id", F.col("image_count") - F.col("images_after"), "images_after", "text_chars"))))
    n = intake.strip_summary(done.where("failure is null")).first()
    bad = done.where("failure is not null or images_after > 0").count()
    print(f"files: {n.n_processed}, images removed: {n.n_removed or 0}, blank without them: {n.n_blank}, failed: {bad}")
    return int(bad > 0)


@job(arg("--names-file", required=True), *TAXONOMY)
def check_name_collisions(spark, a) -> int:
    """Words of names that are, or stand in, an alias; the words themselves are not printed."""
    t = files.load_taxonomy(spark, a.skills, a.roles)
    found = pii.name_collisions(_names(spark, a.names_file), t.aliases).orderBy("resume_id", "skill_id", "token_length")
    n = 0
    for r in found.toLocalIterator():
        n += 1
        print(f"{r.resume_id}: a word of {r.token_length} letters collides with {r.skill_id}")
    print(f"collisions: {n}")
    return int(n > 0)


@job(FOLDER, arg("--output", required=True))
def hash_resumes(spark, a) -> int:
    files.write_csv(intake.file_hashes(_listed(spark, a.folder)).coalesce(1), a.output)
    return 0


@job(FOLDER, arg("--output", required=True))
def make_provenance(spark, a) -> int:
    """Rows that only know the file; an output that is there already is kept and is an error."""
    if Path(a.output).exists():
        return complain(f"{a.output} is there already")
    files.write_csv(intake.provenance(_listed(spark, a.folder)).coalesce(1), a.output)
    return 0


@job(FOLDER, arg("--labels-dir", required=True), *TAXONOMY)
def make_label_stubs(spark, a) -> int:
    t = files.load_taxonomy(spark, a.skills, a.roles)
    try:
        made = files.write_stubs(labels.stubs(intake.file_hashes(_listed(spark, a.folder)), t.version), a.labels_dir)
    except FileExistsError as e:
        return complain("labels are there already: " + ", ".join(e.args[0]))
    print(f"labels written: {len(made)}")
    return 0


@job(FOLDER, arg("--labels-dir", required=True))
def verify_label_hashes(spark, a) -> int:
    """Labels that can't be read, or whose file is missing or another one."""
    own = _listed(spark, a.folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("resume_id"), F.sha2("content", 256).alias("sha256"))
    made = files.labels(spark, a.labels_dir, labels.SCHEMA).select(F.coalesce("file_name", "label_file").alias("resume_id"), "file_sha256")
    n = 0
    for r in labels.hash_check(made, own).orderBy("resume_id").toLocalIterator():
        n += 1
        complain(f"{r.resume_id}: {r.problem}")
    return int(n > 0)


@job(arg("--labels-dir", required=True), *TAXONOMY, arg("--require-final", action="store_true"))
def validate_labels(spark, a) -> int:
    t = files.load_taxonomy(spark, a.skills, a.roles)
    found = labels.violations(files.labels(spark, a.labels_dir, labels.SCHEMA), t.skills, t.role_names, t.version, a.require_final)
    n = 0
    for r in labels.report(found).toLocalIterator():
        n += 1
        print(f"- {r.check_id} {r.resume_id}: {r.detail}")
    return int(n > 0)


@job(arg("--output-dir", required=True))
def export_schema(spark, a) -> int:
    say(f"wrote {p}" for p in contracts.export(a.output_dir))
    return 0


@job(FOLDER, *TAXONOMY, arg("--top", type=int, default=5), arg("--least", type=int, default=100))
def run_thin_slice(spark, a) -> int:
    """From files to skills to roles; fails where a file can't be read or has too little text."""
    t = files.load_taxonomy(spark, a.skills, a.roles)
    own = written(files.texts(_listed(spark, a.folder)).withColumn("short", F.coalesce(F.length("text"), F.lit(0)) < a.least), "texts")
    good = own.where("failure is null and not short")
    found = written(gazetteer.skills(good, t.aliases), "skills")
    say(lines(found.groupBy("resume_id").agg(F.array_join(F.sort_array(F.collect_set("skill_id")), ", ").alias("s")).orderBy("resume_id").select(F.format_string("%s skills: %s", "resume_id", "s"))))
    best = scoring.best_roles(found, t.roles, a.top)
    say(lines(best.orderBy("resume_id", "rank").select(F.format_string("%s %d. %s score=%.3f", "resume_id", "rank", "role_id", "score"))))
    out = scoring.excluded(scoring.coverage(found, t.roles)).orderBy("resume_id", "role_id")
    say(lines(out.select(F.format_string("%s excluded %s reason=%s", "resume_id", "role_id", "reason"))))
    bad = own.where("failure is not null or short").orderBy("resume_id").select(F.format_string("%s: %s", "resume_id", F.coalesce("failure", F.lit("too little text"))))
    n = [complain(x) for x in lines(bad)]
    return int(bool(n))


def table_lines(total: DataFrame, file: str = "file") -> Iterable[str]:
    """Agreement as a table of fixed width, the sums last."""
    row = F.format_string("  %-12s %9d %9d %6d %7.2f", F.coalesce(file, F.lit("all")), "candidate_count", "reference_count", "agreed_count", "jaccard")
    yield "  " + "file".ljust(12) + " candidate reference agreed jaccard"
    yield from lines(total.orderBy(F.col(file).isNull(), file).select(row))


@job(FOLDER, *TAXONOMY, arg("--reference", required=True), arg("--rungs", default="1"), arg("--model"), arg("--vectors"), arg("--skill-vectors"),
     arg("--config"), arg("--results-dir", default="results"), arg("--recorded", help="found,reference,agreed,jaccard of rung 1"))
def rung_compare(spark, a) -> int:
    """Agreement of the rungs with a reference (JSON lines of file, skill_id); 1 if rung 1 doesn't reproduce recorded figures."""
    rungs = ladder.selected(a.rungs, a.model)
    t = files.load_taxonomy(spark, a.skills, a.roles)
    config = settings.load(a.config)
    docs = written(files.texts(_listed(spark, a.folder)).where("failure is null"), "texts")
    reference = spark.read.schema("file string, skill_id string").json(a.reference)
    as_file = lambda df: df.withColumnRenamed("resume_id", "file")
    found = {}
    if "1" in rungs:
        found["1"] = as_file(ladder.by_gazetteer(t.aliases)(docs))
        if a.recorded:
            n = [float(x) for x in a.recorded.split(",")]
            ok = agreement.canary(agreement.micro(agreement.paired(found["1"], reference)), *map(int, n[:3]), n[3]).first()
            if not all(ok):
                return complain("rung 1 doesn't reproduce the recorded figures: " + ", ".join(k for k, v in ok.asDict().items() if not v))
    if "2" in rungs:
        vectors = spark.read.parquet(a.vectors), spark.read.parquet(a.skill_vectors)
        found["2"] = as_file(ladder.by_vectors(*vectors, config["extract"]["embedding_threshold"])(docs))
    for name, x in found.items():
        print(f"rung {name}")
        say(table_lines(agreement.rolled_up(agreement.paired(x, reference))))
    if "3" in rungs:
        rung3 = config["extract"]["rung3"] | ({"model": a.model} if a.model else {})
        done = written(as_file(ladder.by_model(ollama(rung3, _answer_schema(t)), t.skills)(docs)), "rung3")
        mine = done.select("file", F.explode("skills").alias("skill_id"))
        pairs = agreement.paired(mine, ladder.restricted(reference, done))
        print(f"rung 3 ({rung3['model']})")
        say(table_lines(agreement.rolled_up(pairs)))
        about = {"model": rung3["model"], "prompt_version": rung3["prompt_version"], "taxonomy_version": t.version, "server_version": server_version(rung3["host"]) or ""}
        body = ladder.record(done, agreement.micro(pairs), about).first().body
        stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
        path = f"{a.results_dir}/rung3_{files.slug(rung3['model'])}_{stamp}.json"
        import json

        files.write_json(path, json.loads(body))
        print(f"written: {path}")
    return 0


@job(FOLDER, *TAXONOMY, arg("--threshold", type=float, default=0.5))
def rung_grounding(spark, a) -> int:
    """Share of the found skills whose name stands in the text; another scorer is any expression, see ``agreement.grounding``."""
    t = files.load_taxonomy(spark, a.skills, a.roles)
    docs = files.texts(_listed(spark, a.folder)).where("failure is null")
    score = F.when(F.contains(F.lower("text"), F.replace("skill_id", F.lit("_"), F.lit(" "))), 1.0).otherwise(0.0)
    got = agreement.grounding(gazetteer.skills(docs, t.aliases), docs, score, a.threshold).orderBy(F.col("resume_id").isNull(), "resume_id")
    say(lines(got.select(F.format_string("  %-12s %6d %8d %9.2f", F.coalesce("resume_id", F.lit("all")), "skill_count", "grounded_count", "pass_rate"))))
    return 0


def mine(corpus_rows: DataFrame, t: files.Taxonomy, client, model: str, budget: int, batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(checked replies, prompts) of one mining run: repaired and deduplicated rows, batches, prompts, calls, checks.

    A call that fails, and a reply that breaks a rule, is an error of its batch; the other batches go on.
    """
    rows = written(corpus.deduplicated(corpus.repaired(corpus_rows), "resume_id"), "mined")
    packed = corpus.batches(rows, "resume_id", budget)
    packed = packed if batches is None else packed.where(F.col("batch_index") < batches)
    asked = written(responses.ask(corpus.mining_prompts(rows, packed, t.skills, t.aliases), client), "replies")
    done = responses.checked(asked, t.skills).join(asked.select("batch_index", "failure"), "batch_index")
    return done.withColumn("error", F.coalesce(F.when(F.col("failure").isNotNull(), F.lit("failed")), "error")).withColumn(
        "items", F.when(F.col("error").isNull(), F.col("items"))), packed


@job(arg("corpus"), *TAXONOMY, arg("--output", required=True), arg("--model"), arg("--char-budget", type=int), arg("--limit-batches", type=int), arg("--config"))
def mine_aliases(spark, a, client=None) -> int:
    """Proposals of a model for a corpus; 1 if a batch failed. The manifest is written however the run ends."""
    config = settings.load(a.config)
    rung3 = config["extract"]["rung3"] | {"num_predict": config["mining"]["num_predict"]} | ({"model": a.model} if a.model else {})
    budget = a.char_budget or config["mining"]["char_budget"]
    t = files.load_taxonomy(spark, a.skills, a.roles)
    rows = corpus.row_ids(files.corpus_csv(spark, a.corpus).withColumn("__order", F.monotonically_increasing_id()), "__order", "resume_id").drop("__order")
    rows = written(rows, "corpus")
    about = {"model": rung3["model"], "config": {"char_budget": budget} | {k: rung3[k] for k in ("num_predict", "num_ctx", "temperature", "seed")},
             "started_at": datetime.now(UTC).isoformat(), "corpus": {"rows_total": rows.count()}, "batches_total": 0, "batches_ok": 0, "batches_failed": 0,
             "proposals_count": 0, "failures": []}
    try:
        done, packed = mine(rows, t, client or ollama(rung3), rung3["model"], budget, a.limit_batches)
        done = written(done, "checked")
        files.append_proposals(responses.proposals(done, rung3["model"]), a.output)
        n = responses.manifest(done).first()
        about["corpus"]["rows_in_batches"] = packed.count()
        about |= {"batches_total": n.n_batches, "batches_ok": n.n_ok, "batches_failed": n.n_failed, "proposals_count": n.n_proposals}
        about["failures"] = [r.asDict() for r in done.where("error is not null").groupBy("error").agg(F.count("*").alias("batches"), F.min("batch_index").alias("first")).orderBy("error").collect()]
    finally:
        about["finished_at"] = datetime.now(UTC).isoformat()
        files.write_json(f"{a.output.rstrip('/')}.manifest.json", about)
    print(f"batches: {about['batches_ok']} ok, {about['batches_failed']} failed, {about['batches_total']} in all")
    return int(about["batches_failed"] > 0)


def _answer_schema(t: files.Taxonomy) -> dict:
    """The form of an answer, in which only the listed ids are allowed."""
    ids = [r[0] for r in t.skills.select("skill_id").orderBy("skill_id").limit(ladder.IDS).collect()]
    return {"type": "object", "properties": {"skills_present": {"type": "array", "items": {"type": "string", "enum": ids}}}, "required": ["skills_present"]}


def ollama(rung3: dict, form: dict | None = None) -> Callable[[str], tuple[str | None, str]]:
    """A client of a model server's chat interface over HTTP, as ``responses.ask`` takes it."""
    host, seconds, model = rung3["host"].rstrip("/"), rung3["timeout_seconds"], rung3["model"]
    options = {k: rung3[k] for k in ("temperature", "seed", "num_ctx", "num_predict")}

    def call(prompt: str) -> tuple[str | None, str]:
        import json
        import urllib.request

        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False, "think": False, "options": options}
        body |= {"format": form} if form else {}
        request = urllib.request.Request(f"{host}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as f:
            got = json.load(f)
        return got["message"]["content"], got.get("done_reason", "stop")

    return call


def server_version(host: str, seconds: float = 5.0) -> str | None:
    """The version that a model server reports; None if it can't be reached."""
    import json
    import urllib.request

    try:
        with urllib.request.urlopen(f"{host.rstrip('/')}/api/version", timeout=seconds) as f:
            return json.load(f).get("version")
    except (OSError, ValueError):
        return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None, **given) -> int:
    parser = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    names = parser.add_subparsers(dest="job", required=True)
    for name, (f, arguments) in JOBS.items():
        own = names.add_parser(name, help=f.__doc__)
        for flags, kw in arguments:
            own.add_argument(*flags, **kw)
    a = parser.parse_args(argv)
    try:
        return JOBS[a.job][0](spark or session(f"lexmill {a.job}"), a, **given)
    except ValueError as e:
        return complain(str(e))


if __name__ == "__main__":
    raise SystemExit(main())
