"""Contracts, prompts, rungs, DOCX rewriting and the jobs with their exit codes."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill import jobs, settings
from lexmill.operators import agreement, contracts, corpus, gazetteer, ladder, scoring
from lexmill.sources import docx, files

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def run(*texts):
    return "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>' for t in texts)


def document(body, header="", target="mailto:jo@example.org", image=True):
    wrap = lambda root, x: f'<w:{root} xmlns:w="{NS}" xmlns:r="{REL}">{x}</w:{root}>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", wrap("document", f"<w:body>{body}</w:body>"))
        z.writestr("word/header1.xml", wrap("hdr", header))
        rels = f'<Relationship Id="r1" Type="h" Target="{target}" TargetMode="External"/><Relationship Id="r2" Type="i" Target="media/a.png"/>'
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{PKG}">{rels}</Relationships>')
        if image:
            z.writestr("word/media/a.png", b"123")
    return out.getvalue()


BODY = (
    f"<w:p>{run('Mail jo', '@exam', 'ple.org now', ' Docker and rest')}</w:p>"
    f"<w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('+49 30 1234567')}</w:p></w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    f"<w:p>{run('see ')}<w:hyperlink r:id='r1'>{run('Nick')}</w:hyperlink></w:p>"
)
SKILLS = """version: "1"
skills:
- {id: docker, display_name: Docker, family: ops, aliases: [docker], description: Packs a service with all that it needs.}
- {id: rest_api, display_name: REST, family: web, aliases: [rest_api, rest], description: Serves and calls interfaces over HTTP.}
"""
ROLES = """version: "1"
taxonomy_version: "1"
roles:
- {id: ops, display_name: Operations, core: {docker: 3}, supporting: {rest_api: 2}, min_core_ratio: 1.0}
- {id: web, display_name: Web, core: {rest_api: 3}, min_core_ratio: 0.5}
"""


@pytest.fixture()
def box(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/prac_001.docx").write_bytes(document(BODY, f"<w:p>{run('Nick Miller')}</w:p>"))
    (tmp_path / "skills.yaml").write_text(SKILLS)
    (tmp_path / "roles.yaml").write_text(ROLES)
    (tmp_path / "names.txt").write_text("prac_001: Nick Miller\n")
    return tmp_path


def call(spark, box, name, *argv, **given):
    return jobs.main([name, *[str(x).replace("@", f"{box}/") for x in argv]], spark, **given)


TAX = ("--skills", "@skills.yaml", "--roles", "@roles.yaml")


def test_runs_of_all_stories(spark, box):
    content = (box / "in/prac_001.docx").read_bytes()
    got = {}
    for p, _, t in docx.numbered(content):
        got.setdefault(p, []).append(t)
    assert ["".join(x) for x in got.values()] == ["Mail jo@example.org now Docker and rest", "see Nick", "cell", "+49 30 1234567", "Nick Miller"]
    assert docx.links(content) == [("word/_rels/document.xml.rels", "r1", "mailto:jo@example.org")]
    new, before, after, chars = docx.without_images(content)
    assert (before, after) == (1, 0) and chars == sum(len(t) for *_, t in docx.numbered(content))
    assert b"media/" not in zipfile.ZipFile(io.BytesIO(new)).read("word/_rels/document.xml.rels")


def test_redaction_job_and_its_gate(spark, box, capsys):
    both = ("--original-dir", "@in", "--redacted-dir", "@out", "--names-file", "@names.txt")
    assert call(spark, box, "redact-resumes", "--input-dir", "@in", "--output-dir", "@in") == 1
    assert call(spark, box, "redact-resumes", "--input-dir", "@in", "--output-dir", "@out", "--names-file", "@names.txt") == 0
    assert not (box / "out").exists() and "email=1" in capsys.readouterr().out
    assert call(spark, box, "redact-resumes", "--input-dir", "@in", "--output-dir", "@mid", "--names-file", "@names.txt", "--write") == 0
    content = (box / "mid/prac_001.docx").read_bytes()
    texts = [t for *_, t in docx.numbered(content)]
    assert texts == ["Mail [EMAIL]", "", " now", " Docker and rest", "see ", "[NAME]", "cell", "[PHONE]", "[NAME]"]
    assert docx.links(content)[0][2] == "[EMAIL]" and b"<w:b" in zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")
    assert call(spark, box, "strip-images", "--in-dir", "@mid", "--out-dir", "@mid") == 1
    assert call(spark, box, "verify-redaction", "--original-dir", "@in", "--redacted-dir", "@mid") == 1  # an image is left
    assert call(spark, box, "strip-images", "--in-dir", "@mid", "--out-dir", "@out") == 0
    assert call(spark, box, "verify-redaction", *both) == 0
    assert call(spark, box, "verify-redaction", "--original-dir", "@in", "--redacted-dir", "@in") == 1
    (box / "in/prac_002.pdf").write_bytes(b"%PDF")
    assert call(spark, box, "verify-redaction", *both) == 1  # counts differ
    assert call(spark, box, "redact-resumes", "--input-dir", "@in", "--output-dir", "@new", "--write") == 1 and not (box / "new").exists()


def test_reports(spark, box, capsys):
    assert call(spark, box, "scan-pii", "@in", "--names-file", "@names.txt") == 0
    out = capsys.readouterr().out
    assert "jo@" not in out and "email     offset=5" in out
    (box / "bad.txt").write_text("prac_001 Nick\n")
    assert call(spark, box, "scan-pii", "@in", "--names-file", "@bad.txt") == 1
    assert call(spark, box, "scan-pii", "@in", "--names-file", "@none.txt") == 1
    assert call(spark, box, "audit-images", "@in") == 0 and "images: 1" in capsys.readouterr().out
    assert call(spark, box, "check-name-collisions", "--names-file", "@names.txt", *TAX) == 0
    (box / "names.txt").write_text("prac_001: Ann Rest\n")
    assert call(spark, box, "check-name-collisions", "--names-file", "@names.txt", *TAX) == 1 and "Rest" not in capsys.readouterr().out


def test_taxonomy_jobs(spark, box, capsys):
    assert call(spark, box, "validate-taxonomy", *TAX) == 0 and "2 skills, 2 roles, 3 aliases" in capsys.readouterr().out
    assert call(spark, box, "report-orphan-skills", *TAX) == 0
    (box / "roles.yaml").write_text(ROLES.replace("id: web", "id: ops").replace("docker: 3", "nothing: 9"))
    assert call(spark, box, "validate-taxonomy", *TAX) == 1
    said = capsys.readouterr().err
    assert all(f"- {v} ops" in said for v in ("V02", "V07", "V11"))
    (box / "roles.yaml").write_text(ROLES + "  extra: 1\n")
    assert call(spark, box, "validate-taxonomy", *TAX) == 1


def test_label_jobs(spark, box):
    assert call(spark, box, "make-label-stubs", "@in", "--labels-dir", "@labels", *TAX) == 0
    assert call(spark, box, "make-label-stubs", "@in", "--labels-dir", "@labels", *TAX) == 1  # refuses what is there
    assert call(spark, box, "verify-label-hashes", "@in", "--labels-dir", "@labels") == 0
    assert call(spark, box, "validate-labels", "--labels-dir", "@labels", *TAX) == 0
    assert call(spark, box, "validate-labels", "--labels-dir", "@labels", *TAX, "--require-final") == 1
    (box / "labels/b.yaml").write_text("a: [")
    assert call(spark, box, "verify-label-hashes", "@in", "--labels-dir", "@labels") == 1
    assert call(spark, box, "hash-resumes", "@in", "--output", "@h") == 0 and call(spark, box, "make-provenance", "@in", "--output", "@h") == 1


def test_thin_slice_and_comparison(spark, box, capsys):
    assert call(spark, box, "run-thin-slice", "@in", *TAX, "--least", "10") == 0
    out = capsys.readouterr().out
    assert "skills: docker, rest_api" in out and "1. ops score=1.000" in out and "2. web score=1.000" in out
    assert call(spark, box, "run-thin-slice", "@in", *TAX, "--least", "1000") == 1
    (box / "ref.json").write_text('{"file": "prac_001", "skill_id": "docker"}\n')
    compare = ("rung-compare", "@in", *TAX, "--reference", "@ref.json")
    assert call(spark, box, *compare, "--recorded", "2,1,1,0.5") == 0 and "0.50" in capsys.readouterr().out
    assert call(spark, box, *compare, "--recorded", "2,1,1,0.9") == 1
    assert call(spark, box, *compare, "--rungs", "4") == 1 and call(spark, box, *compare, "--model", "m") == 1
    assert call(spark, box, "rung-grounding", "@in", *TAX) == 0


def test_mining_job(spark, box):
    (box / "c.csv").write_text('Category,Resume\nA,knows containers\nA,knows containers\nB,other\nC,' + "x" * 50 + "\n")

    def client(prompt):
        if "xxx" in prompt:
            raise RuntimeError("down")
        return json.dumps([{"resume_id": "0000", "skill_id": "docker", "quoted_phrase": "containers"}]), "stop"

    base = ("mine-aliases", "@c.csv", *TAX, "--output", "@prop", "--char-budget", "30")
    assert call(spark, box, *base, client=client) == 1
    about = json.loads((box / "prop.manifest.json").read_text())
    assert (about["batches_total"], about["batches_ok"], about["batches_failed"], about["proposals_count"]) == (2, 1, 1, 1)
    assert about["corpus"]["rows_total"] == 4 and about["failures"][0]["error"] == "failed"
    assert call(spark, box, *base, "--limit-batches", "1", client=client) == 0
    assert files.proposals(spark, f"{box}/prop").count() in (0, 2) or spark.read.json(f"{box}/prop").count() == 2


def test_prompts(spark):
    skills = spark.createDataFrame([("b",), ("a",)], "skill_id string")
    docs = spark.createDataFrame([("1", "text {x}"), ("2", None)], "resume_id string, text string")
    got = ladder.extraction_prompts(docs, skills, "{N} of {\"k\": 1}\n{SKILL_LIST}\n").collect()
    assert [tuple(r) for r in got] == [("1", '2 of {"k": 1}\na\nb\n\nRESUME:\ntext {x}')]
    aliases = spark.createDataFrame([("b", "b"), ("bee", "b"), ("a b", "b")], "alias string, skill_id string")
    assert corpus.vocabulary(skills, aliases) == (2, "a: \nb: a b, bee")


def test_answers(spark):
    cases = [
        ('{"skills_present": ["b", "a", "b"]}', "stop", None, None), ('{"skills_present": []}', "stop", None, None), ('{"skills_present": ["zz"]}', "stop", None, "unknown_id"),
        ("[]", "stop", None, "missing_key"), ('{"x": 1}', "stop", None, "missing_key"), ('{"skills_present": "a"}', "stop", None, "not_list"), ("oops", "stop", None, "not_json"),
        ("", "stop", None, "empty"), (None, None, "RuntimeError: x", "failed"), ('{"skills_present": []}', "length", None, "length"),
    ]
    skills = spark.createDataFrame([("a",), ("b",)], "skill_id string")
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "resume_id int, content string, done_reason string, failure string")
    got = {r.resume_id: (r.error, r.skills) for r in ladder.answers(df, skills).collect()}
    assert [got[i][0] for i in range(len(cases))] == [c[3] for c in cases]
    assert got[0][1] == ["a", "b"] and got[1][1] == [] and all(x is None for e, x in got.values() if e)


def test_model_run_and_its_record(spark):
    skills = spark.createDataFrame([("a",), ("b",)], "skill_id string")
    docs = spark.createDataFrame([("1", "good"), ("2", "bad")], "resume_id string, text string").coalesce(1)
    client = lambda p: ('{"skills_present": ["a"]}', "stop") if p.endswith("good") else ("oops", "stop")
    done = ladder.by_model(client, skills)(docs).withColumnRenamed("resume_id", "file").cache()
    reference = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "file string, skill_id string")
    kept = ladder.restricted(reference, done)
    assert {r.file for r in kept.collect()} == {"1"}
    total = agreement.micro(agreement.paired(done.select("file", F.explode("skills").alias("skill_id")), kept))
    body = json.loads(ladder.record(done, total, {"model": "m"}).first().body)
    assert body["per_resume"]["1"]["skills"] == ["a"] and body["failures"] == {"2": "not_json"} and body["aggregate"]["micro_jaccard"] == 0.5
    assert "good" not in json.dumps(body)


REQUEST = {"schema_version": "v1", "request_id": "r", "user_id": "u", "input": {"kind": "file", "content_base64": "aGk=", "mime_type": "application/pdf", "filename": "a.pdf"}}


def test_requests(spark):
    cases = [
        ({}, None), ({"options": {"max_roles": 10, "backend": None}}, None), ({"extra": 1}, "unknown field"), ({"user_id": None}, "missing field"), ({"schema_version": "v2"}, "schema_version"),
        ({"options": {"max_roles": 0}}, "max_roles"), ({"options": {"max_roles": 11}}, "max_roles"), ({"options": {"max_roles": 2.5}}, "max_roles"), ({"options": {"other": 1}}, "unknown field"),
        ({"input": REQUEST["input"] | {"mime_type": "text/plain"}}, "mime_type"), ({"input": REQUEST["input"] | {"kind": "url"}}, "kind"),
        ({"input": REQUEST["input"] | {"content_base64": "%%%"}}, "content_base64"), ({"input": {"kind": "file"}}, "missing field"), (None, "not an object"),
    ]
    bodies = ["no json" if c is None else json.dumps(REQUEST | c) for c, _ in cases]
    got = contracts.parsed(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).cache()
    assert [r.problem for r in got.orderBy("i").collect()] == [p for _, p in cases]
    rows = contracts.files(got).collect()
    assert [(bytes(r.content), r.path) for r in rows] == [(b"hi", "r.pdf")] * 2 and sorted(r.max_roles for r in rows) == [5, 10]
    errors = [json.loads(r.body)["error"] for r in contracts.errors(got).collect()]
    assert {e["code"] for e in errors if e["detail"] == "mime_type"} == {"UNSUPPORTED_MIME"} and {e["code"] for e in errors if e["detail"] != "mime_type"} == {"PARSE_FAILED"}


def test_responses_and_schemas(spark, tmp_path):
    docs = spark.createDataFrame([("r1", "Uses Docker, Rest"), ("r2", "none")], "request_id string, text string")
    aliases = spark.createDataFrame([("docker", "docker"), ("rest", "rest_api")], "alias string, skill_id string")
    roles = spark.createDataFrame([("ops", "core", "docker", 3, 1.0), ("ops", "supporting", "git", 1, 1.0), ("web", "core", "css", 1, 0.5)], "role_id string, bucket string, skill_id string, weight int, min_core_ratio double")
    mentions = gazetteer.mentions(docs, aliases, "request_id")
    covered = scoring.coverage(mentions, roles, "request_id")
    names = spark.createDataFrame([("ops", "Operations")], "role_id string, display_name string")
    people = docs.select("request_id", F.lit("u").alias("user_id"), F.lit(5).alias("max_roles"))
    got = {r.request_id: json.loads(r.body) for r in contracts.responses(people, mentions, covered, names, "1", "e").collect()}
    r1 = got["r1"]
    assert r1["extracted_skills"] == [{"skill_id": "docker", "matched_alias": "Docker", "span": [5, 11]}, {"skill_id": "rest_api", "matched_alias": "Rest", "span": [13, 17]}]
    assert r1["matches"] == [{"role_id": "ops", "display_name": "Operations", "score": 0.75, "core_ratio": 1.0, "matched_skills": ["docker"], "missing_skills": ["git"]}]
    assert r1["excluded_roles"] == [{"role_id": "web", "reason": "CORE_GATE_FAILED", "core_ratio": 0.0}]
    assert got["r2"]["matches"] == [] and got["r2"]["warnings"] == ["no skill was found"]
    assert len(contracts.export(str(tmp_path))) == 3
    request, response = (json.loads((tmp_path / f"{n}.schema.json").read_text()) for n in ("request", "response"))
    assert request["additionalProperties"] is False and "options" not in request["required"] and request["properties"]["options"]["properties"]["max_roles"]["maximum"] == 10
    assert set(response["properties"]) == set(r1) and response["properties"]["matches"]["items"]["properties"]["score"]["minimum"] == 0
    bad = spark.createDataFrame([("a", 1.5, "v1"), ("b", 0.5, "v9")], "request_id string, score double, schema_version string")
    assert {tuple(r) for r in contracts.out_of_range(bad, "request_id").collect()} == {("a", "score", "1.5"), ("b", "schema_version", "v9")}


def test_settings(tmp_path, monkeypatch):
    assert settings.load(f"{tmp_path}/none.yaml") == settings.DEFAULTS
    (tmp_path / "c.yaml").write_text("extract: {rung3: {model: m}}\nmore: 1\n")
    got = settings.load(f"{tmp_path}/c.yaml")
    assert got["extract"]["rung3"]["model"] == "m" and got["extract"]["rung3"]["seed"] == 42 and got["more"] == 1
    (tmp_path / "e").write_text("# x\nLEXMILL_LOG_LEVEL=DEBUG\nLEXMILL_OTHER=1\nLEXMILL_ENVIRONMENT=file\n")
    monkeypatch.setenv("LEXMILL_ENVIRONMENT", "shell")
    got = settings.Environment.read(f"{tmp_path}/e")
    assert (got.log_level, got.environment, got.openai_api_key) == ("DEBUG", "shell", None)
