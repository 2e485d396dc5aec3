"""Core operators: stated cases, and brute force where SQL can't ask the question."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import agreement, corpus, gazetteer, pii, responses, runs, scoring, similarity, taxonomy
from lexmill.runtime import with_index
from lexmill.sources import files
from lexmill.streaming import streams


def texts(spark, values):
    return spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(values)], "resume_id string, text string")


ALIASES = [("docker", "docker"), ("github actions", "ci_cd"), ("azure devops", "ci_cd"), ("azure", "azure"), ("git", "git"), ("spark sql", "spark"), ("sql server", "mssql"),
           ("power bi", "power_bi"), ("node.js", "javascript"), ("rest", "rest_api")]


@pytest.mark.parametrize("text,skills", [
    ("GitHub Actions and Azure DevOps", {"ci_cd"}), ("Spark SQL Server", {"spark"}), ("power\nbi and power  bi", set()), ("Node.js, REST", {"javascript", "rest_api"}),
    ("see github.com/janedoe", set()), ("", set()), (None, set()), ("Dockerised", set()), ("azure", {"azure"}),
])
def test_gazetteer(spark, text, skills):
    aliases = spark.createDataFrame(ALIASES + [(None, "x"), ("y", None)], "alias string, skill_id string")
    assert {r.skill_id for r in gazetteer.skills(texts(spark, [text]), aliases).collect()} == skills


def test_aliases_of_any_length(spark):
    listed = [("post incident write-ups", "incident_review"), ("incident", "incident"), ("a b c d e f g", "seven"), ("b c d e f", "five"), ("ups", "ups")]
    aliases = spark.createDataFrame(listed, "alias string, skill_id string")
    docs = texts(spark, ["Post incident write-ups daily", "post incident write", "A b c d e f G", "z b c d e f", "write-ups"])
    got = {(r.resume_id, r.first, r.n, r.skill_id) for r in gazetteer.spans(docs, aliases).collect()}
    assert got == {("000", 0, 5, "incident_review"), ("001", 1, 1, "incident"), ("002", 0, 7, "seven"), ("003", 1, 5, "five"), ("004", 2, 1, "ups")}


PII = [
    ("Contact: jane.doe@shop.example.com for", ["email"]), ("Mobile: 9876543210 or 98765 43210", ["phone", "phone"]), ("Office: (415) 555-2671", ["phone"]),
    ("linkedin.com/in/janedoe-123", ["linkedin"]), ("https://github.com/janedoe", ["github"]), ("https://janedoe.dev/portfolio", ["url"]),
    ("mailto:jane.doe@example.com", ["mailto"]), ("in/jane-doe123", ["linkedin_shorthand"]), ("specializing in/around cloud, report.pdf, python 3.11", []),
    ("janedoe.dev", ["domain"]), ("github/janedoe", ["github_shorthand"]), ("", []), (None, []),
]


def test_contact_patterns(spark):
    got = pii.scan(texts(spark, [t for t, _ in PII]))
    rows = {r.resume_id: r for r in got.collect()}
    for i, (text, kinds) in enumerate(PII):
        found = rows[f"{i:03d}"].found or []
        assert [m.kind for m in found] == kinds
        assert all(text[m.start : m.end] == m.value for m in found)
    assert pii.rescan_gate(got.where("text is not null")).where("not clean").count() == 0


def test_priority_against_brute_force(spark):
    values = ["a@b.co 9876543210 x@y.org linkedin.com/in/zed https://q.io/a@b.co me.dev", "𝗐 é jo@x.in — +91 98765 43210, www.github.com/k", "no"]
    got = {r.resume_id: [(m.start, m.end, m.kind) for m in r.found] for r in pii.scan(texts(spark, values)).collect()}
    for i, t in enumerate(values):
        taken = []
        for kind, pattern in pii.PATTERNS:
            flags = re.I if pattern.startswith("(?iU)") else 0
            for m in re.finditer(re.sub(r"^\(\?i?U\)", "", pattern), t, flags):
                if not any(m.start() < b and m.end() > a for a, b, _ in taken):
                    taken.append((m.start(), m.end(), kind))
        assert got[f"{i:03d}"] == sorted(taken)


def test_names_hold_for_their_own_text(spark):
    docs = texts(spark, ["Samsung and Sam, Nick Miller's", "Black Friday", "Nick   Black"])
    names = spark.createDataFrame([("000", "Sam"), ("000", "Nick Miller"), ("002", "Nick Black"), ("001", None)], "resume_id string, name string")
    got = {r.resume_id: r.t for r in pii.scan(docs, names).select("resume_id", pii.redact(F.col("text"), F.col("found")).alias("t")).collect()}
    assert got == {"000": "Samsung and [NAME], [NAME]'s", "001": "Black Friday", "002": "[NAME]"}


def test_runs_redact_as_the_joined_text(spark):
    parts = ["Mail jo", "@x.exam", "ple and", " go"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(parts)], "par_id int, run_ix int, text string")
    whole = spark.createDataFrame([(1, "".join(parts))], "par_id int, text string")
    found = pii.exploded(pii.scan(whole, key="par_id"), "par_id")
    out = [r.text for r in runs.redact(runs.offsets(df), found, pii.PLACEHOLDER).orderBy("run_ix").collect()]
    assert out == ["Mail [EMAIL]", "", " and", " go"]


@pytest.mark.parametrize("text,fixed", [
    ("NaÃ¯ve", "Naïve"), ("NaÃƒÂ¯ve", "Naïve"), ("Naïve", "Naïve"), ("plain", "plain"), ("x�y", "x�y"), ("", ""), (None, None), ("Ã\x81", "Ã\x81"), ("â€™", "’"),
])
def test_repair(spark, text, fixed):
    assert corpus.repaired(texts(spark, [text])).first().text == fixed


def test_line_spans(spark):
    df = texts(spark, ["a" * 15 + "\r\n" + "b" * 14 + " \u2028" + "  " + "c" * 16 + "  "]).select(T.line_spans(F.col("text")).alias("x"))
    assert df.first().x == ["a" * 15, "c" * 16]


@pytest.mark.parametrize("sizes,budget,want", [
    ([4000] * 5, 10000, [0, 0, 1, 1, 2]), ([100, 20000, 100], 15000, [0, 1, 2]), ([5, 5], 1, [0, 1]), ([], 10, []),
])
def test_batches(spark, sizes, budget, want):
    df = texts(spark, ["x" * n for n in sizes])
    assert [r.batch_index for r in corpus.batches(df, "resume_id", budget).orderBy("resume_id").collect()] == want


@pytest.mark.parametrize("group", [1, 2, 3, 7, 1000])
def test_batches_are_one_fold_whatever_the_groups(spark, group):
    rng = random.Random(group)
    sizes = [rng.choice([0, 0, 1, 3, 9, 10, 11, 25, rng.randint(0, 12)]) for _ in range(120)]
    used, batch, want = None, -1, []
    for n in sizes:
        if used is not None and used + n <= 10:
            used += n
        else:
            used, batch = n, batch + 1
        want.append(batch)
    got = corpus.batches(texts(spark, ["x" * n for n in sizes]), "resume_id", 10, group_rows=group).orderBy("resume_id").collect()
    assert [(r.n_chars, r.batch_index) for r in got] == list(zip(sizes, want))


def test_long_lists_of_aliases_are_joined(spark, monkeypatch):
    aliases = spark.createDataFrame(ALIASES, "alias string, skill_id string")
    docs = texts(spark, ["GitHub Actions and Azure DevOps git", "Spark SQL Server, node.js", None, ""])
    want = [{tuple(r) for r in f(docs, aliases).collect()} for f in (gazetteer.candidates, gazetteer.spans)]
    monkeypatch.setattr(gazetteer, "ALIAS_ROWS", 3)
    assert [{tuple(r) for r in f(docs, aliases).collect()} for f in (gazetteer.candidates, gazetteer.spans)] == want
    assert all(want)


def test_tokens_are_the_same_in_python(spark):
    rng = random.Random(3)
    letters = "aZé9_.'+# \t\n\r@:/-x²½Ⅷ中ß\xa0\u2028é𝗐ﬁ%"
    values = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(300)] + ["x@y.z https://a.b/c?d", "http://"]
    got = {r.resume_id: r.t for r in texts(spark, values).select("resume_id", T.tokens(F.col("text")).alias("t")).collect()}
    assert [got[f"{i:03d}"] for i in range(len(values))] == [gazetteer.PYTHON_TOKEN.findall(t) for t in values]


def test_nearest_skill(spark):
    skills = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [0.0, 2.0]), ("c", [1.0, 0.0]), ("n", None)], "label string, embedding array<double>")
    df = spark.createDataFrame([(1, [0.0, 3.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.label, r.score) for r in similarity.nearest(df, skills).collect()}
    assert got[1] == ("a", 1.0) and got[2][0] == "c" and got[3] == (None, None) and got[4] == ("a", 0.0)
    assert similarity.nearest(df, skills.limit(0)).count() == 0


def test_taxonomy_checks(spark):
    skills = spark.createDataFrame([("a", "A", "f", "x" * 20), ("a", "A", "f", "x" * 20), ("b", "B", "f", "x" * 30)], "skill_id string, display_name string, family string, description string")
    aliases = spark.createDataFrame([("a", "a"), ("bee", "b")], "alias string, skill_id string")
    roles = spark.createDataFrame([("r", "core", "a", 3, 0.5), ("r", "differentiator", "a", 1, 0.5)], "role_id string, bucket string, skill_id string, weight int, min_core_ratio double")
    ids = spark.createDataFrame([("r",), ("r",), ("empty",)], "role_id string")
    got = {(r.check_id, r.subject) for r in taxonomy.violations(skills, aliases, roles, ("1", "1", "1"), ids).collect()}
    assert got == {("V01", "a"), ("V02", "r"), ("V05", "b"), ("V08", "r"), ("V09", "empty")}
    found = spark.createDataFrame([("1", "a")], "resume_id string, skill_id string")
    assert scoring.coverage(found, roles).first().score == 1.0 and scoring.requirements(roles).first().total == 1


def test_labels_of_one_file(spark):
    from lexmill.operators import labels

    base = (1, "prac_001", "practice", "s", "draft", "x.pdf", "a" * 64, "pdf", "one", "0.7", "me", "2026-01-31", ["a"], [], ["r"], [], "")
    change = lambda **kw: tuple(kw.get(f.split()[0], v) for f, v in zip(labels.SCHEMA.split(", "), base))
    rows = [base, change(file_name="y.pdf"), change(resume_id="prac_002", status="final", skills_present=[], roles_fit=["zz"]), change(resume_id="exam_003", skills_present=["zz", "zz"], file_sha256="b" * 64), change(format="txt")]
    df = spark.createDataFrame(rows, labels.SCHEMA)
    skills, roles = spark.createDataFrame([("a",)], "skill_id string"), spark.createDataFrame([("r",)], "role_id string")
    got = sorted(tuple(r) for r in labels.violations(df, skills, roles, "0.7").collect())
    sha = "a" * 64
    assert got == [("V12", "prac_001", "format"), ("V13", "prac_002", "skills_present"), ("V15", "exam_003", "skills_present: zz"), ("V17", "exam_003", "practice"),
                   ("V19", "prac_001", "x.pdf"), ("V19", "prac_001", "y.pdf"), ("V20", "prac_001", f"{sha}: x.pdf"), ("V20", "prac_001", f"{sha}: y.pdf")]


def test_index_and_first_copies(spark):
    df = texts(spark, ["a", "b", "a", None, "a"]).repartition(4)
    assert {r.resume_id: r.ix for r in with_index(df, "resume_id").collect()} == {f"{i:03d}": i for i in range(5)}
    assert {r.resume_id for r in corpus.deduplicated(df, "resume_id").collect()} == {"000", "001"}
    assert {r.row_id for r in corpus.row_ids(df, "resume_id").collect()} == {f"{i:04d}" for i in range(5)}


def test_scoring_gate_and_cap(spark):
    roles = [("high", "core", x, 1, 1.0) for x in "abc"] + [("low", "core", "a", 3, 0.5), ("low", "supporting", "b", 2, 0.5), ("low", "differentiator", "c", 1, 0.5)]
    df = spark.createDataFrame(roles, "role_id string, bucket string, skill_id string, weight int, min_core_ratio double")
    found = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "zzz")], "resume_id string, skill_id string")
    cover = scoring.coverage(found, df)
    assert [(r.resume_id, r.role_id, r.score, r.rank) for r in scoring.top_roles(cover).collect()] == [("1", "low", 0.5, 1)]
    assert {(r.resume_id, r.role_id) for r in scoring.excluded(cover).collect()} == {("1", "high"), ("2", "high"), ("2", "low")}
    assert {r.skill_id: r.weight for r in taxonomy.merged_weights(df.where("role_id = 'low'")).collect()} == {"a": 3, "b": 2, "c": 1}


def test_orphans_are_in_no_role(spark, tmp_path):
    from lexmill.plans import catalog

    skills = [("a", "A", "one", None), ("b", "B", "one", None), ("d", "D", None, None), ("c", "C", None, None)]
    df = spark.createDataFrame(skills, "skill_id string, display_name string, family string, description string")
    df.write.parquet(f"{tmp_path}/skill.parquet")
    named = spark.createDataFrame([("c", "heron-large", 0), ("a", "owl-mini-4", 1)], "skill_id string, model string, batch_index int")
    named.write.parquet(f"{tmp_path}/proposal.parquet")
    assert [tuple(r) for r in catalog.tax_orphans(spark, str(tmp_path)).collect()] == [(None, 2, "c, d")]
    roles = taxonomy.family_roles(df).where("skill_id <> 'b'")
    assert {tuple(r) for r in taxonomy.orphans(df, roles).collect()} == {(None, 2, "c, d"), ("one", 1, "b")}


def test_agreement_guards_zero(spark):
    none = spark.createDataFrame([], "file string, skill_id string")
    one = spark.createDataFrame([("f", "s")], "file string, skill_id string")
    assert agreement.micro(agreement.paired(none, none)).first().micro_jaccard == 0.0
    assert agreement.per_file(agreement.paired(none, one)).first().jaccard == 0.0
    assert [tuple(r) for r in agreement.key_mismatch(none, one).collect()] == [("f", "reference")]


REPLY = '[{"resume_id": "1", "skill_id": "NEW", "quoted_phrase": "q", "suggested_name": "n"}]'


@pytest.mark.parametrize("content,reason,error", [
    (REPLY, "stop", None), ("[]", "stop", None), (REPLY, "length", "length"), (None, "stop", "empty"), ("  ", "stop", "empty"), ("oops", "stop", "not_json"),
    ('{"a": 1}', "stop", "not_list"), ('[{"skill_id": "NEW"}]', "stop", "missing_key"), (REPLY.replace("NEW", "other"), "stop", "unknown_id"),
])
def test_reply_checks(spark, content, reason, error):
    skills = spark.createDataFrame([("known",)], "skill_id string")
    df = spark.createDataFrame([(0, content, reason)], "batch_index int, content string, done_reason string")
    done = responses.checked(df, skills)
    assert done.first().error == error
    assert responses.manifest(done).first().n_failed == int(error is not None)


def test_replies_of_every_model(spark, tmp_path):
    from lexmill.plans import catalog

    spark.createDataFrame([("known",)], "skill_id string").write.parquet(f"{tmp_path}/skill.parquet")
    rows = [("m1", 0, "known"), ("m1", 5, None), ("m2", 0, "other"), ("m2", 0, "known"), ("m2", 1, "known"), ("m3", None, "other"), (None, 0, "NEW")]
    df = spark.createDataFrame([(i, f"r{i}", *r, "q", None) for i, r in enumerate(rows)],
                               "proposal_id long, resume_id string, model string, batch_index int, skill_id string, quoted_phrase string, suggested_name string")
    df.write.parquet(f"{tmp_path}/proposal.parquet")
    got = {tuple(r) for r in catalog.llm_response_checks(spark, str(tmp_path)).collect()}
    assert got == {("m1", 0, None), ("m1", 5, None), ("m2", 0, "unknown_id"), ("m2", 1, "not_json"), (None, 0, None)}
    runs_ = {tuple(r) for r in catalog.mining_manifest(spark, str(tmp_path)).collect()}
    assert runs_ == {("m1", 2, 2, 0, 2), ("m2", 2, 0, 2, 0), (None, 1, 1, 0, 1)}


def test_model_failures_are_recorded(spark):
    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return "[]", "stop"

    df = spark.createDataFrame([(0, "good"), (1, "bad")], "batch_index int, prompt string").coalesce(1)
    got = {r.batch_index: (r.content, r.failure) for r in responses.ask(df, client).collect()}
    assert got == {0: ("[]", None), 1: (None, "RuntimeError: down")}


def test_files(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    xml = f'<w:document xmlns:w="{ns}"><w:body>{p.format("one")}<w:tbl><w:tr><w:tc>{p.format("cell")}</w:tc></w:tr></w:tbl>{p.format("two")}</w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/image1.png", b"123")
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    docs = files.binary(spark, str(tmp_path), "*.docx")
    got = {r.resume_id: (r.text, r.failure is None) for r in files.docx_texts(docs).collect()}
    assert got == {"a": ("one\ntwo\ncell", True), "b": (None, False)}
    assert files.docx_media(docs.where("path like '%a.docx'")).first().size == 3
    (tmp_path / "n.txt").write_text("# x\na: Ann B: C\n\nbad line\na: Again\n")
    names, bad = files.names(spark, str(tmp_path / "n.txt"))
    assert [tuple(r) for r in names.collect()] == [("a", "Ann B: C")]
    assert {(r.line_no, r.problem) for r in bad.collect()} == {(4, "malformed"), (5, "duplicate id")}
    (tmp_path / "c.csv").write_text('Category,Resume\nA,"x ""q""\ny"\n')
    assert [tuple(r) for r in files.corpus_csv(spark, str(tmp_path / "c.csv")).collect()] == [("A", 'x "q"\ny')]


def test_streams(spark, tmp_path):
    texts(spark, ["mail a@b.org", "mail a@b.org", "x"]).withColumn("at", F.lit("2026-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("resume_id string, text string, at timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("r", streams.redacted(stream)), ("f", streams.first_copies(stream, "at", "1 hour"))):
        q = df.writeStream.format("memory").queryName(f"q_{name}").outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert {r.text for r in spark.table("q_r").collect()} == {"mail [EMAIL]", "x"}
    assert spark.table("q_f").count() == 2


def test_entry_without_the_corpus_package(monkeypatch):
    import sys

    import __spark_entry__ as entry
    from lexmill.plans import catalog

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setitem(sys.modules, "lexmill.llm", None)  # as if it could not be imported
    monkeypatch.delitem(sys.modules, "lexmill.llm.queries", raising=False)
    assert entry.queries() == catalog.QUERIES and entry.oracle_sql() == catalog.SQL


def test_spread(spark, tmp_path):
    from lexmill.runtime import spread

    texts(spark, ["a", "b", None]).coalesce(1).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    assert spread(scan).rdd.getNumPartitions() == 4 and sorted(map(str, spread(scan).collect())) == sorted(map(str, scan.collect()))
    many = spark.range(10).repartition(3)
    assert spread(many) is many and spread(spark.range(10)).count() == 10


def test_shared_folder(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from lexmill import runtime

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        runtime.shared_dir(cluster)
    runtime.forget(spark)
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}")
    assert runtime.written(spark.range(3), "x").count() == 3 and len(list(tmp_path.iterdir())) == 1
    assert runtime.forget(spark) == 1 and not list(tmp_path.iterdir())
