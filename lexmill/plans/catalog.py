"""The queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import agreement, contracts, corpus, gazetteer, intake, labels, ladder, pii, responses, runs, scoring, similarity, taxonomy
from lexmill.runtime import small, table, take_bounded, with_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- Taxonomy -----------------------------------------------------------------------------
ROLES = """role_skill AS (
 SELECT 'role_' || family AS role_id,
  CASE WHEN r <= 3 THEN 'core' WHEN r <= 6 THEN 'supporting' ELSE 'differentiator' END AS bucket, skill_id,
  CASE WHEN r <= 3 THEN 3 WHEN r <= 6 THEN 2 ELSE 1 END AS weight,
  CASE WHEN n % 2 = 0 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS min_core_ratio
 FROM (SELECT family, skill_id, row_number() OVER (PARTITION BY family ORDER BY skill_id) AS r,
  count(*) OVER (PARTITION BY family) AS n FROM skill WHERE family IS NOT NULL AND skill_id IS NOT NULL))"""


def _skills(s, d):
    return table(s, d, "skill")


def _aliases(s, d):
    return table(s, d, "skill_alias")


def _roles(s, d):
    return taxonomy.family_roles(_skills(s, d))


def _found(s, d):
    return table(s, d, "extracted_skill").where("skill_id is not null and resume_id is not null").select("resume_id", "skill_id").distinct()


@query("""SELECT family, count(*) AS n_skills, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_aliases
FROM skill LEFT JOIN (SELECT skill_id, count(*) AS n FROM skill_alias GROUP BY 1) USING (skill_id) GROUP BY family""")
def tax_skill_by_family(s, d):
    return taxonomy.by_family(_skills(s, d), _aliases(s, d))


@query("""SELECT alias, string_agg(skill_id, ', ' ORDER BY skill_id) AS owners FROM
(SELECT DISTINCT split_part(alias, ' ', 1) AS alias, skill_id FROM skill_alias) GROUP BY alias HAVING count(*) > 1""")
def tax_alias_owner(s, d):
    heads = _aliases(s, d).select(F.split_part("alias", F.lit(" "), F.lit(1)).alias("alias"), "skill_id")
    return taxonomy.owners(heads)


@query(f"""WITH {ROLES} SELECT family, count(*) AS n, string_agg(skill_id, ', ' ORDER BY skill_id) AS skills FROM skill
WHERE skill_id NOT IN (SELECT skill_id FROM role_skill) GROUP BY family""")
def tax_orphans(s, d):
    return taxonomy.orphans(_skills(s, d), _roles(s, d))


@query(f"""WITH {ROLES} SELECT role_id, CAST(sum(CASE WHEN bucket = 'core' THEN 1 ELSE 0 END) AS BIGINT) AS n_core,
count(*) AS n_skills, CAST(sum(weight) AS BIGINT) AS total_weight FROM role_skill GROUP BY role_id""")
def tax_role_totals(s, d):
    return taxonomy.role_totals(_roles(s, d))


@query(f"""WITH {ROLES}, two AS (SELECT role_id, bucket, skill_id FROM role_skill UNION ALL
SELECT role_id, 'differentiator', skill_id FROM role_skill WHERE bucket = 'core')
SELECT role_id, skill_id, string_agg(bucket, ', ' ORDER BY CASE bucket WHEN 'core' THEN 1 WHEN 'supporting' THEN 2 ELSE 3 END) AS buckets
FROM two GROUP BY role_id, skill_id HAVING count(*) > 1""")
def tax_bucket_overlap(s, d):
    roles = _roles(s, d)
    again = roles.where("bucket = 'core'").withColumn("bucket", F.lit("differentiator"))
    return taxonomy.bucket_overlap(roles.unionByName(again))


@query("""SELECT b.alias, a.alias AS inside, b.skill_id FROM skill_alias a JOIN skill_alias b
ON contains(b.alias, a.alias) AND a.skill_id <> b.skill_id WHERE contains(b.alias, ' ')""")
def tax_alias_contains(s, d):
    return taxonomy.contained(_aliases(s, d))


VIOLATIONS = """
SELECT 'V01' AS check_id, skill_id AS subject, CAST(count(*) AS VARCHAR) AS detail FROM sk GROUP BY skill_id HAVING count(*) > 1
UNION ALL SELECT 'V02', role_id, CAST(count(*) AS VARCHAR) FROM ri GROUP BY role_id HAVING count(*) > 1
UNION ALL SELECT 'V03', alias, skill_id FROM al WHERE alias <> trim(lower(alias))
UNION ALL SELECT 'V04', alias, string_agg(DISTINCT skill_id, ', ' ORDER BY skill_id) FROM al GROUP BY alias HAVING count(DISTINCT skill_id) > 1
UNION ALL SELECT 'V05', skill_id, '' FROM sk WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.skill_id = sk.skill_id AND al.alias = sk.skill_id)
UNION ALL SELECT 'V06', skill_id, coalesce(CAST(length(description) AS VARCHAR), 'missing') FROM sk WHERE description IS NULL OR length(description) NOT BETWEEN 20 AND 200
UNION ALL SELECT 'V07', role_id, bucket || ': ' || skill_id FROM ro WHERE skill_id NOT IN (SELECT skill_id FROM sk)
UNION ALL SELECT 'V08', role_id, skill_id || ': ' || string_agg(bucket, ', ' ORDER BY CASE bucket WHEN 'core' THEN 1 WHEN 'supporting' THEN 2 ELSE 3 END) FROM ro GROUP BY role_id, skill_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'V09', role_id, '' FROM ri WHERE role_id NOT IN (SELECT role_id FROM ro WHERE bucket = 'core')
UNION ALL SELECT 'V11', skill_id, family FROM sk WHERE NOT regexp_matches(skill_id, '^[a-z0-9_]+$') OR NOT regexp_matches(family, '^[a-z0-9_]+$')
UNION ALL SELECT 'V11', skill_id, 'no alias' FROM sk WHERE skill_id NOT IN (SELECT skill_id FROM al)
UNION ALL SELECT DISTINCT 'V11', role_id, 'id' FROM ri WHERE NOT regexp_matches(role_id, '^[a-z0-9_]+$')
UNION ALL SELECT 'V11', role_id, skill_id FROM ro WHERE weight NOT BETWEEN 1 AND 5 OR min_core_ratio <= 0 OR min_core_ratio > 1"""


@query(f"""WITH {ROLES}, sk AS (SELECT * FROM skill), al AS (SELECT * FROM skill_alias), ro AS (SELECT * FROM role_skill),
ri AS (SELECT DISTINCT role_id FROM ro){VIOLATIONS}""")
def tax_violations_clean(s, d):
    return taxonomy.violations(_skills(s, d), _aliases(s, d), _roles(s, d), ("1", "1", "1"))


@query(f"""WITH {ROLES},
sk AS (SELECT * FROM skill UNION ALL SELECT 'quillon', 'Quillon', 'language', 'too short' UNION ALL SELECT 'Bad-Id', 'Bad', 'field', NULL),
al AS (SELECT * FROM skill_alias UNION ALL SELECT 'Quillon ', 'quillon' UNION ALL SELECT 'brindle', 'brindle_stream'),
ro AS (SELECT * FROM role_skill UNION ALL SELECT 'role_care', 'supporting', 'no_such_skill', 9, CAST(0.6 AS DOUBLE)
 UNION ALL SELECT 'role_hollow', 'supporting', 'quillon', 2, CAST(0.6 AS DOUBLE)
 UNION ALL SELECT role_id, 'differentiator', skill_id, 1, min_core_ratio FROM role_skill WHERE skill_id = 'wound_dressing'),
ri AS (SELECT DISTINCT role_id FROM ro UNION ALL SELECT 'role_hollow' UNION ALL SELECT 'Role-Empty'){VIOLATIONS}
UNION ALL SELECT 'V10', 'roles', '2 vs 1'""")
def tax_violations_dirty(s, d):
    sk = _skills(s, d).unionAll(s.createDataFrame(
        [("quillon", "Quillon", "language", "too short"), ("Bad-Id", "Bad", "field", None)], _skills(s, d).schema))
    al = _aliases(s, d).unionAll(s.createDataFrame([("Quillon ", "quillon"), ("brindle", "brindle_stream")], _aliases(s, d).schema))
    roles = _roles(s, d)
    more = s.createDataFrame([("role_care", "supporting", "no_such_skill", 9, 0.6), ("role_hollow", "supporting", "quillon", 2, 0.6)], roles.schema)
    twice = roles.where("skill_id = 'wound_dressing'").withColumn("bucket", F.lit("differentiator")).withColumn("weight", F.lit(1))
    every = roles.unionAll(more).unionAll(twice)
    ids = every.select("role_id").distinct().unionAll(s.createDataFrame([("role_hollow",), ("Role-Empty",)], "role_id string"))
    return taxonomy.violations(sk, al, every, ("2", "2", "1"), ids)


# --- Scoring ------------------------------------------------------------------------------
COV = """tot AS (SELECT role_id, sum(CASE WHEN bucket = 'core' THEN 1 ELSE 0 END) AS n_core, sum(weight) AS total, max(min_core_ratio) AS need FROM role_skill GROUP BY 1),
cand_of AS (SELECT DISTINCT resume_id FROM found),
cov AS (SELECT c.resume_id, t.role_id,
 CAST(count(*) FILTER (WHERE r.bucket = 'core' AND f.skill_id IS NOT NULL) AS DOUBLE) / any_value(t.n_core) AS core_ratio,
 CAST(coalesce(sum(r.weight) FILTER (WHERE f.skill_id IS NOT NULL), 0) AS DOUBLE) / any_value(t.total) AS score, any_value(t.need) AS need,
 coalesce(string_agg(r.skill_id, ',' ORDER BY r.skill_id) FILTER (WHERE f.skill_id IS NOT NULL), '') AS matched,
 coalesce(string_agg(r.skill_id, ',' ORDER BY r.skill_id) FILTER (WHERE f.skill_id IS NULL), '') AS missing
 FROM cand_of c CROSS JOIN tot t JOIN role_skill r ON r.role_id = t.role_id
 LEFT JOIN found f ON f.resume_id = c.resume_id AND f.skill_id = r.skill_id GROUP BY 1, 2)"""
COVER = f"""WITH {ROLES}, found AS (SELECT DISTINCT resume_id, skill_id FROM extracted_skill WHERE skill_id IS NOT NULL AND resume_id IS NOT NULL),
{COV}"""


def _mentions(s, d):
    return table(s, d, "extracted_skill").where("skill_id is not null and resume_id is not null").select("resume_id", "skill_id")


def _cover(s, d):
    return scoring.coverage(_mentions(s, d), _roles(s, d))


def _passed(s, d):
    return scoring.passed(_mentions(s, d), _roles(s, d))


@query(COVER + " SELECT resume_id, role_id, core_ratio FROM cov")
def role_core_ratio(s, d):
    return _cover(s, d).select("resume_id", "role_id", "core_ratio")


@query(COVER + " SELECT resume_id, role_id FROM cov WHERE core_ratio >= need")
def role_gate(s, d):
    return _passed(s, d).select("resume_id", "role_id")


@query(COVER + " SELECT resume_id, role_id, score FROM cov WHERE core_ratio >= need")
def role_score(s, d):
    return _passed(s, d).select("resume_id", "role_id", "score")


TOP = """ SELECT resume_id, role_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY resume_id
ORDER BY score DESC, role_id) AS rank FROM cov WHERE core_ratio >= need) WHERE rank <= 5"""


@query(COVER + TOP)
def role_top5(s, d):
    return scoring.best_roles(_mentions(s, d), _roles(s, d)).select("resume_id", "role_id", "score", "rank")


@query(COVER + " SELECT resume_id, role_id, 'core_gate_failed' AS reason, core_ratio FROM cov WHERE core_ratio < need")
def role_excluded(s, d):
    return scoring.excluded(_cover(s, d))


@query(COVER + " SELECT resume_id, role_id, matched, missing FROM cov WHERE core_ratio >= need")
def role_matched_missing(s, d):
    got = _passed(s, d)
    return got.select("resume_id", "role_id", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing"))


@query(COVER + """ SELECT role_id, count(*) AS n, CAST(sum(CASE WHEN core_ratio >= need THEN 1 ELSE 0 END) AS BIGINT) AS n_passed,
avg(CASE WHEN core_ratio >= need THEN 1 ELSE 0 END) AS pass_rate FROM cov GROUP BY role_id""")
def role_pass_rate(s, d):
    return scoring.pass_rate(_cover(s, d))


@query(COVER + " SELECT resume_id, role_id, upper('core_gate_failed') AS reason, core_ratio, core_ratio BETWEEN 0 AND 1 AS in_range FROM cov WHERE core_ratio < need")
def role_contract_projection(s, d):
    got = scoring.excluded(_cover(s, d))
    return got.withColumn("reason", F.upper("reason")).withColumn("in_range", F.col("core_ratio").between(0, 1))


# --- Gazetteer ----------------------------------------------------------------------------
TOK = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|https?://[^\s]+|[\pL\pN_]+(?:[.''+#][\pL\pN_]+)*|\n|  +|[^\s\pL\pN_]"


def _resumes(s, d):
    return table(s, d, "corpus_resume")


TOKENS = f"""doc AS MATERIALIZED (SELECT resume_id, list_transform(regexp_extract_all(text, '{TOK}'), lambda x: lower(x)) AS t FROM corpus_resume WHERE text IS NOT NULL),
al AS MATERIALIZED (SELECT skill_id, alias, list_transform(regexp_extract_all(lower(alias), '{TOK}'), lambda x: lower(x)) AS a FROM skill_alias),
tok AS MATERIALIZED (SELECT resume_id, unnest(range(len(t))) AS i, unnest(t) AS x FROM doc),
cand AS MATERIALIZED (SELECT tok.resume_id, CAST(i AS INT) AS "first", CAST(len(a) AS INT) AS n, alias, skill_id FROM tok JOIN al ON al.a[1] = tok.x JOIN doc USING (resume_id)
 WHERE t[i + 1 : i + len(a)] = a)"""
SPANS = f"""{TOKENS}, one AS (SELECT resume_id, list([{{'f': "first", 'n': n, 'alias': alias, 'skill_id': skill_id}}] ORDER BY n DESC, "first", alias, skill_id) AS c FROM cand GROUP BY resume_id),
kept AS (SELECT resume_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: x[1].f < k.f + k.n AND x[1].f + x[1].n > k.f)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM one),
span AS MATERIALIZED (SELECT resume_id, k.f AS "first", k.n AS n, k.alias AS alias, k.skill_id AS skill_id FROM kept)"""


@query(f"SELECT resume_id, CAST(len(regexp_extract_all(text, '{TOK}')) AS INT) AS n_tokens FROM corpus_resume WHERE text IS NOT NULL")
def gaz_tokens(s, d):
    return _resumes(s, d).where("text is not null").select("resume_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))


@query(f"WITH {TOKENS} SELECT skill_id, alias, count(*) AS n FROM cand GROUP BY 1, 2")
def gaz_candidates(s, d):
    got = gazetteer.candidates(_resumes(s, d), _aliases(s, d))
    return got.groupBy("skill_id", "alias").agg(F.count("*").alias("n"))


@query(f"WITH {SPANS} SELECT * FROM span")
def gaz_spans(s, d):
    return gazetteer.spans(_resumes(s, d), _aliases(s, d))


@query(f"WITH {SPANS} SELECT DISTINCT resume_id, skill_id FROM span")
def gaz_found(s, d):
    return gazetteer.skills(_resumes(s, d), _aliases(s, d))


@query(f"WITH {SPANS} SELECT skill_id, count(DISTINCT resume_id) AS n_resumes FROM span GROUP BY skill_id")
def gaz_skill_df(s, d):
    return gaz_found(s, d).groupBy("skill_id").agg(F.count("*").alias("n_resumes"))


@query(f"WITH {ROLES}, {SPANS}, found AS (SELECT DISTINCT resume_id, skill_id FROM span), {COV}{TOP}")
def e2e_text_to_roles(s, d):
    """The flagship: texts to skills to the five best roles of each résumé."""
    found = gazetteer.spans(_resumes(s, d), _aliases(s, d)).select("resume_id", "skill_id")
    return scoring.best_roles(found, _roles(s, d)).select("resume_id", "role_id", "score", "rank")


@query(f"""WITH {SPANS}, c AS (SELECT DISTINCT resume_id AS file, skill_id, 1 AS c FROM span),
r AS (SELECT DISTINCT resume_id AS file, skill_id, 1 AS r FROM extracted_skill WHERE skill_id IS NOT NULL AND resume_id IS NOT NULL),
p AS (SELECT file, skill_id, coalesce(c, 0) AS c, coalesce(r, 0) AS r FROM c FULL JOIN r USING (file, skill_id))
SELECT file, CAST(sum(c) AS BIGINT) AS candidate_count, CAST(sum(r) AS BIGINT) AS reference_count, CAST(sum(c * r) AS BIGINT) AS agreed_count,
CASE WHEN sum(c) + sum(r) - sum(c * r) = 0 THEN 0 ELSE CAST(sum(c * r) AS DOUBLE) / CAST(sum(c) + sum(r) - sum(c * r) AS DOUBLE) END AS jaccard FROM p GROUP BY ROLLUP (file)""")
def extractor_agreement(s, d):
    """Agreement of the gazetteer with the mentions that an earlier run found, per text and in total."""
    a = gaz_found(s, d).withColumnRenamed("resume_id", "file")
    b = _found(s, d).withColumnRenamed("resume_id", "file")
    return agreement.rolled_up(agreement.paired(a, b))


# --- Spans and vectors --------------------------------------------------------------------
@query(r"""SELECT doc_id, count(*) AS n_spans, CAST(sum(length(x)) AS BIGINT) AS n_chars FROM (SELECT doc_id,
unnest(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
 lambda x: regexp_replace(regexp_replace(x, '^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ''),
 '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', ''))) AS x FROM documents WHERE text IS NOT NULL)
WHERE length(x) >= 15 GROUP BY doc_id""")
def span_lines(s, d):
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(T.line_spans(F.col("text"))).alias("x"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_spans"), F.sum(F.length("x")).alias("n_chars"))


VEC = """WITH sk AS (SELECT label, embedding FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
top AS (SELECT * FROM (SELECT e.vec_id, sk.label, list_cosine_similarity(e.embedding::DOUBLE[], sk.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], sk.embedding::DOUBLE[]) DESC, sk.label) AS r
 FROM embeddings e CROSS JOIN sk WHERE e.vec_id NOT IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) WHERE r = 1)"""


def _nearest(s, d):
    e = table(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    skills = e.join(F.broadcast(first), "vec_id", "left_semi")
    return similarity.nearest(e.join(F.broadcast(first), "vec_id", "left_anti"), skills)


@query(VEC + " SELECT vec_id, label, round(score, 6) AS score FROM top")
def vec_cosine_top1(s, d):
    return _nearest(s, d).withColumn("score", F.round("score", 6))


@query(VEC + " SELECT vec_id, label FROM top WHERE score > 0.2")
def vec_threshold(s, d):
    return similarity.above(_nearest(s, d), 0.2).select("vec_id", "label")


@query(VEC + " SELECT DISTINCT label FROM top WHERE score > 0.2")
def vec_found(s, d):
    return similarity.above(_nearest(s, d), 0.2).select("label").distinct()


# --- Contact data -------------------------------------------------------------------------
def _matched(s, d, kind):
    hit = F.explode(pii.kind_matches(F.col("text"), kind)).alias("m")
    return _resumes(s, d).select("resume_id", hit).select("resume_id", "m.value", "m.start", "m.end")


@query(r"""SELECT resume_id, value, count(*) AS n FROM (SELECT resume_id, unnest(regexp_extract_all(text,
'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS value FROM corpus_resume) GROUP BY 1, 2""")
def pii_email(s, d):
    return _matched(s, d, "email").groupBy("resume_id", "value").agg(F.count("*").alias("n"))


@query(r"""SELECT resume_id, value, count(*) AS n FROM (SELECT resume_id, unnest(regexp_extract_all(source_url,
'(?i)https?://[^\s)>\]]+')) AS value FROM provenance) GROUP BY 1, 2""")
def pii_url(s, d):
    p = table(s, d, "provenance")
    hit = F.explode(pii.kind_matches(F.col("source_url"), "url")).alias("m")
    return p.select("resume_id", hit).groupBy("resume_id", F.col("m.value").alias("value")).agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT resume_id, coalesce(text, '') || ' https://www.linkedin.com/in/' || resume_id || ' ' || coalesce(source_url, '') || ' github.com/' || resume_id AS t
FROM corpus_resume JOIN provenance USING (resume_id))
SELECT resume_id, 'linkedin' AS kind, unnest(regexp_extract_all(t, '(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?')) AS value FROM t
UNION ALL SELECT resume_id, 'github', unnest(regexp_extract_all(t, '(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_-]+/?')) FROM t""")
def pii_social(s, d):
    """Profile addresses in texts and sources, with one of each made of the id, as the tables have none."""
    both = _resumes(s, d).select("resume_id", "text").join(table(s, d, "provenance").select("resume_id", "source_url"), "resume_id")
    blank = F.lit("")
    t = both.select("resume_id", F.concat(F.coalesce("text", blank), F.lit(" https://www.linkedin.com/in/"), "resume_id", F.lit(" "), F.coalesce("source_url", blank),
                                          F.lit(" github.com/"), "resume_id").alias("t"))
    two = F.concat(*[pii.kind_matches(F.col("t"), k) for k in ("linkedin", "github")])
    return t.select("resume_id", F.explode(two).alias("m")).select("resume_id", "m.kind", "m.value")


def _scan(s, d):
    return pii.scan(_resumes(s, d).select("resume_id", "text"))


def _named_scan(s, d):
    return pii.scan(_resumes(s, d).select("resume_id", "text"), table(s, d, "resume_name"))


@query()
def pii_all_matches(s, d):
    return pii.exploded(_scan(s, d))


@query()
def pii_counts(s, d):
    return pii.counts(_scan(s, d))


@query()
def pii_detail(s, d):
    return pii.detail(_scan(s, d))


@query()
def pii_redact(s, d):
    return _named_scan(s, d).select("resume_id", pii.redact(F.col("text"), F.col("found")).alias("text"))


@query()
def pii_rescan_gate(s, d):
    return pii.rescan_gate(_scan(s, d))


@query()
def pii_names(s, d):
    return pii.exploded(_named_scan(s, d)).where("kind = 'name'")


@query(r"SELECT resume_id, translate(substring(text, 1, 200), chr(10), ' ') AS header FROM corpus_resume")
def pii_header(s, d):
    return _resumes(s, d).select("resume_id", F.translate(F.substring("text", 1, 200), "\n", " ").alias("header"))


@query()
def pii_overmatch(s, d):
    """Texts in which the found values occur more than twice; the limit of a real run is that of the operator."""
    return pii.overmatched(_scan(s, d), limit=2)


@query()
def pii_report_lines(s, d):
    """Fixed-width report lines: kind and offset, never a value."""
    return pii.exploded(_scan(s, d)).select("resume_id", F.format_string("  %-9s offset=%-6d", "kind", "start").alias("line"))


# --- Runs ---------------------------------------------------------------------------------
def _runs(s, d):
    """Names of customers cut into runs of seven characters, as paragraphs of their key."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("par_id"), F.concat_ws("", F.lit("Mail "), F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")),
        F.lit("@shop.example or +49 30 123456"), F.substring("c_custkey", -1, 1)).alias("t"))
    n = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 7).cast("int"))
    return c.select("par_id", F.posexplode(F.transform(n, lambda i: F.substring(F.col("t"), i * 7 + 1, F.lit(7)))).alias("run_ix", "text"))


RUNS = r"""WITH p AS (SELECT c_custkey AS par_id, 'Mail ' || lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || '@shop.example or +49 30 123456' ||
 right(CAST(c_custkey AS VARCHAR), 1) AS t FROM customer),
r AS (SELECT par_id, CAST(i AS INT) AS run_ix, substring(t, i * 7 + 1, 7) AS text, i * 7 AS s, least(i * 7 + 7, length(t)) AS e FROM p, unnest(generate_series(0, (length(t) - 1) // 7)) AS g(i)),
m AS (SELECT par_id, position(v IN t) - 1 AS ms, position(v IN t) - 1 + length(v) AS me FROM
 (SELECT par_id, t, regexp_extract(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS v FROM p))"""


@query(RUNS + ' SELECT par_id, run_ix, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end" FROM r')
def run_offsets(s, d):
    return runs.offsets(_runs(s, d)).select("par_id", "run_ix", "start", "end")


def _run_matches(s, d, kinds=None):
    whole = _runs(s, d).groupBy("par_id").agg(F.array_sort(F.collect_list(F.struct("run_ix", "text"))).alias("r"))
    joined = whole.select("par_id", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"))
    got = pii.exploded(pii.scan(joined, key="par_id"), "par_id")
    return got if kinds is None else got.where(F.col("kind").isin(kinds))


@query(RUNS + """ SELECT par_id, run_ix, CAST(greatest(s, ms) - s AS INT) AS a, CAST(least(e, me) - s AS INT) AS b,
row_number() OVER (PARTITION BY par_id ORDER BY run_ix) = 1 AS first FROM r JOIN m USING (par_id) WHERE e > ms AND s < me""")
def run_overlap(s, d):
    got = runs.overlaps(runs.offsets(_runs(s, d)), _run_matches(s, d, ["email"]))
    return got.select("par_id", "run_ix", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "first")


@query(RUNS + r""", two AS (SELECT par_id, ms, me, '[EMAIL]' AS put FROM m UNION ALL SELECT par_id, position(v IN t) - 1, position(v IN t) - 1 + length(v), '[PHONE]'
 FROM (SELECT par_id, t, regexp_extract(t, '\+\d{1,3}(?:[\s().-]?\d){6,12}') AS v FROM p)),
c AS (SELECT par_id, run_ix, s + i AS pos, substring(text, CAST(i AS INT) + 1, 1) AS c FROM r, unnest(range(length(text))) AS g(i))
SELECT c.par_id, run_ix, string_agg(CASE WHEN ms IS NULL THEN c WHEN pos = ms THEN put ELSE '' END, '' ORDER BY pos) AS text
FROM c LEFT JOIN two ON two.par_id = c.par_id AND pos >= ms AND pos < me GROUP BY 1, 2""")
def run_redact(s, d):
    return runs.redact(runs.offsets(_runs(s, d)), _run_matches(s, d), pii.PLACEHOLDER)


# --- Names --------------------------------------------------------------------------------
@query(r"""WITH n AS (SELECT resume_id, name FROM resume_name UNION ALL SELECT resume_id, category FROM corpus_resume),
w AS (SELECT DISTINCT resume_id, token FROM (SELECT resume_id, unnest(string_split_regex(lower(trim(name)), '\s+')) AS token FROM n) WHERE token <> '')
SELECT DISTINCT w.resume_id, a.skill_id, CAST(length(w.token) AS INT) AS token_length FROM w JOIN skill_alias a
ON a.alias = w.token OR (contains(a.alias, ' ') AND contains(a.alias, w.token))""")
def name_collisions(s, d):
    """Words of the listed names, and of the categories, which collide with aliases more often than names do."""
    names = table(s, d, "resume_name").select("resume_id", "name").unionAll(_resumes(s, d).select("resume_id", "category"))
    return pii.name_collisions(names, _aliases(s, d))


@query("SELECT DISTINCT resume_id FROM provenance WHERE resume_id NOT IN (SELECT resume_id FROM resume_name WHERE resume_id IS NOT NULL)")
def name_unknown_ids(s, d):
    return table(s, d, "provenance").join(table(s, d, "resume_name"), "resume_id", "left_anti").select("resume_id").distinct()


# --- Corpus -------------------------------------------------------------------------------
@query("""SELECT doc_id, lpad(CAST(i AS VARCHAR), greatest(4, length(CAST(n - 1 AS VARCHAR)))::INT, '0') AS row_id FROM
(SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)""")
def corpus_row_id(s, d):
    return corpus.row_ids(table(s, d, "documents").select("doc_id"), "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def corpus_dedup(s, d):
    return corpus.deduplicated(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id")


@query("SELECT count(text) - count(DISTINCT text) AS n_duplicates FROM documents")
def corpus_dup_count(s, d):
    hashed = table(s, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return hashed.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


@query()
def corpus_mojibake(s, d):
    return corpus.repaired(_resumes(s, d).select("resume_id", "text"))


BATCH = """WITH RECURSIVE t AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
b AS (SELECT i, doc_id, n, n AS used, 0 AS batch_index FROM t WHERE i = 1 UNION ALL
SELECT t.i, t.doc_id, t.n, CASE WHEN b.used + t.n <= 9000 THEN b.used + t.n ELSE t.n END,
 CASE WHEN b.used + t.n <= 9000 THEN b.batch_index ELSE b.batch_index + 1 END FROM b JOIN t ON t.i = b.i + 1)"""


def _batches(s, d):
    return corpus.batches(table(s, d, "documents").select("doc_id", "text"), "doc_id", budget=9000)


@query(BATCH + " SELECT doc_id, CAST(n AS BIGINT) AS n_chars, CAST(batch_index AS BIGINT) AS batch_index FROM b")
def corpus_batches(s, d):
    return _batches(s, d)


@query(BATCH + " SELECT CAST(batch_index AS BIGINT) AS batch_index, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_chars FROM b GROUP BY 1")
def corpus_batch_stats(s, d):
    return corpus.batch_stats(_batches(s, d))


def _vocabulary(s, d):
    rows = _aliases(s, d).where(F.col("alias") != F.col("skill_id")).groupBy("skill_id").agg(F.sort_array(F.collect_list("alias")).alias("a")).orderBy("skill_id")
    return "\n".join(f"{r.skill_id}: {', '.join(r.a)}" for r in take_bounded(rows, taxonomy.LIST_ROWS, "the vocabulary"))


@query("""WITH v AS (SELECT string_agg(line, chr(10) ORDER BY skill_id) AS v FROM (SELECT skill_id, skill_id || ': ' || string_agg(alias, ', ' ORDER BY alias) AS line
FROM skill_alias WHERE alias <> skill_id GROUP BY skill_id)), """ + BATCH[len("WITH RECURSIVE "):] + """
SELECT CAST(batch_index AS BIGINT) AS batch_index, CAST(any_value(length(v)) + length(chr(10) || chr(10) || 'RESUMES:' || chr(10) || chr(10)) +
sum(length('--- resume_id: ' || b.doc_id || ' (category: ' || coalesce(d.source, 'None') || ') ---' || chr(10)) + b.n) + 2 * (count(*) - 1) AS BIGINT) AS n_chars
FROM b JOIN documents d USING (doc_id) CROSS JOIN v GROUP BY batch_index""")
def mining_prompt_len(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("resume_id"), F.col("source").alias("category"), "text")
    got = corpus.prompts(docs, _batches(s, d).withColumn("resume_id", F.col("doc_id").cast("string")), _vocabulary(s, d))
    return got.select("batch_index", F.length("prompt").cast("long").alias("n_chars"))


SQL["mining_prompt_len"] = SQL["mining_prompt_len"].replace("WITH v AS", "WITH RECURSIVE v AS", 1)


# --- Labels -------------------------------------------------------------------------------
def _labels(s, d):
    """Labels made from provenance and mentions; a rule on the row number breaks one check in each."""
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    k = F.col("doc_id")
    return docs.select(
        F.lit(1).alias("label_version"), F.concat(F.lit("prac_"), F.lpad((k % 1000).cast("string"), 3, "0")).alias("resume_id"),
        F.when(k % 7 == 0, "exam").otherwise("practice").alias("set"), F.when(k % 11 == 0, "open").when(k % 2 == 0, "final").otherwise("draft").alias("status"),
        F.concat(k.cast("string"), F.lit(".pdf")).alias("file_name"), F.col("sha").alias("file_sha256"), F.lit("pdf").alias("format"),
        F.when(k % 5 == 0, "0.6").otherwise("0.7").alias("taxonomy_version"), F.when(k % 13 == 0, "soon").otherwise("2026-01-31").alias("labelled_at"),
        F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("quillon"), F.lit("no_skill"))).alias("skills_present"),
        F.array(F.lit("quillon")).alias("skills_ambiguous"), F.array(F.lit("role_care")).alias("roles_fit"), F.array(F.lit("role_nobody")).alias("roles_should_exclude"),
    )


LABELS = f"""WITH {ROLES}, l AS (SELECT doc_id AS k, 'prac_' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS resume_id, CASE WHEN doc_id % 7 = 0 THEN 'exam' ELSE 'practice' END AS "set",
 CASE WHEN doc_id % 11 = 0 THEN 'open' WHEN doc_id % 2 = 0 THEN 'final' ELSE 'draft' END AS status, sha256(text) AS sha,
 CASE WHEN doc_id % 5 = 0 THEN '0.6' ELSE '0.7' END AS tv FROM documents WHERE text IS NOT NULL),
g AS (SELECT * FROM l WHERE k % 11 <> 0 AND k % 13 <> 0),
ok AS (SELECT * FROM g WHERE status <> 'final' OR k % 3 <> 0),
has AS (SELECT * FROM ok WHERE k % 3 <> 0)"""


@query(LABELS + """
SELECT 'V12' AS check_id, resume_id, 'status' AS detail FROM l WHERE k % 11 = 0
UNION ALL SELECT 'V12', resume_id, 'labelled_at' FROM l WHERE k % 13 = 0
UNION ALL SELECT 'V13', resume_id, 'skills_present' FROM g WHERE status = 'final' AND k % 3 = 0
UNION ALL SELECT 'V15', resume_id, 'skills_present: no_skill' FROM has
UNION ALL SELECT 'V15', resume_id, 'roles_should_exclude: role_nobody' FROM ok
UNION ALL SELECT 'V16', resume_id, 'quillon' FROM has
UNION ALL SELECT 'V17', resume_id, "set" FROM ok WHERE "set" <> 'practice'
UNION ALL SELECT 'V18', resume_id, tv FROM ok WHERE tv <> '0.7'
UNION ALL SELECT 'V19', resume_id, k || '.pdf' FROM ok WHERE resume_id IN (SELECT resume_id FROM ok GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'V20', resume_id, sha || ': ' || k || '.pdf' FROM ok WHERE sha IN (SELECT sha FROM ok GROUP BY 1 HAVING count(*) > 1)""")
def label_violations(s, d):
    return labels.violations(_labels(s, d), _skills(s, d), _roles(s, d), "0.7")


@query(LABELS + " SELECT resume_id, status AS detail FROM ok WHERE status <> 'final'")
def label_require_final(s, d):
    got = labels.violations(_labels(s, d), _skills(s, d), _roles(s, d), "0.7", require_final=True)
    return got.where("check_id = 'V14'").select("resume_id", "detail")


@query("""WITH f AS (SELECT 'prac_' || CAST(doc_id AS VARCHAR) AS resume_id, sha256(text) AS h, sha256(text || CASE WHEN doc_id % 10 = 0 THEN '.' ELSE '' END) AS now, doc_id AS k
FROM documents WHERE text IS NOT NULL)
SELECT resume_id, CASE WHEN k % 9 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM f WHERE k % 9 = 0 OR h <> now""")
def label_hash_verify(s, d):
    docs = table(s, d, "documents").where("text is not null").withColumn("resume_id", F.concat(F.lit("prac_"), F.col("doc_id").cast("string")))
    files = docs.where("doc_id % 9 <> 0").select("resume_id", F.sha2(F.concat("text", F.when(F.expr("doc_id % 10 = 0"), ".").otherwise("")), 256).alias("sha256"))
    return labels.hash_check(docs.select("resume_id", F.sha2("text", 256).alias("file_sha256")), files)


@query("""SELECT h AS file_sha256, doc_id FROM (SELECT doc_id, sha256(text) AS h, count(*) OVER (PARTITION BY sha256(text)) AS n
FROM documents WHERE text IS NOT NULL) WHERE n > 1""")
def label_dup_sha(s, d):
    """The files of each content that several have, a row each: a content may have any number of files."""
    h = table(s, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("file_sha256"), "doc_id")
    shared = h.groupBy("file_sha256").count().where("count > 1").select("file_sha256")
    return h.join(shared, "file_sha256", "left_semi")


@query("""SELECT 1 AS label_version, CAST(doc_id AS VARCHAR) AS resume_id, 'practice' AS "set", 'draft' AS status, CAST(doc_id AS VARCHAR) || '.DOCX' AS file_name,
sha256(text) AS file_sha256, 'docx' AS format, '0.7' AS taxonomy_version, '' AS skills_present FROM documents WHERE text IS NOT NULL""")
def label_stub(s, d):
    k = F.col("doc_id").cast("string")
    files = table(s, d, "documents").where("text is not null").select(k.alias("resume_id"), F.concat(k, F.lit(".DOCX")).alias("file_name"), F.sha2("text", 256).alias("sha256"))
    made = labels.stubs(files, "0.7").withColumn("skills_present", F.array_join("skills_present", ","))
    return made.select("label_version", "resume_id", "set", "status", "file_name", "file_sha256", "format", "taxonomy_version", "skills_present")


# --- Agreement ----------------------------------------------------------------------------
def _sides(s, d):
    e = table(s, d, "extracted_skill").where("skill_id is not null and resume_id is not null").select(F.col("resume_id").alias("file"), "skill_id", "match_id")
    return e.where("match_id % 2 = 0"), e.where("match_id % 2 = 1")


AGREE = """WITH e AS (SELECT resume_id AS file, skill_id, match_id FROM extracted_skill WHERE skill_id IS NOT NULL AND resume_id IS NOT NULL),
p AS (SELECT file, skill_id, max(CASE WHEN match_id % 2 = 0 THEN 1 ELSE 0 END) AS c, max(match_id % 2) AS r FROM e GROUP BY 1, 2)"""
SUMS = "CAST(sum(c) AS BIGINT) AS candidate_count, CAST(sum(r) AS BIGINT) AS reference_count, CAST(sum(c * r) AS BIGINT) AS agreed_count"
JACC = "CASE WHEN sum(c) + sum(r) - sum(c * r) = 0 THEN 0 ELSE CAST(sum(c * r) AS DOUBLE) / CAST(sum(c) + sum(r) - sum(c * r) AS DOUBLE) END"


@query(f"{AGREE} SELECT file, {SUMS}, {JACC} AS jaccard FROM p GROUP BY file")
def agree_per_file(s, d):
    return agreement.per_file(agreement.paired(*_sides(s, d)))


@query(f"""{AGREE} SELECT {SUMS}, CAST(sum(c * r) AS DOUBLE) / CAST(sum(c) AS DOUBLE) AS precision_analogue,
CAST(sum(c * r) AS DOUBLE) / CAST(sum(r) AS DOUBLE) AS recall_analogue, {JACC} AS micro_jaccard FROM p""")
def agree_micro(s, d):
    return agreement.micro(agreement.paired(*_sides(s, d)))


@query(f"{AGREE} SELECT file, {SUMS}, {JACC} AS jaccard FROM p GROUP BY ROLLUP (file)")
def agree_rollup(s, d):
    return agreement.rolled_up(agreement.paired(*_sides(s, d)))


@query(f"""{AGREE} SELECT file, CASE WHEN max(c) = 0 THEN 'reference' ELSE 'candidate' END AS side FROM p GROUP BY file HAVING max(c) = 0 OR max(r) = 0""")
def agree_key_mismatch(s, d):
    return agreement.key_mismatch(*_sides(s, d))


@query(f"""{AGREE} SELECT count(*) FILTER (WHERE c = 1) = sum(c) AS found_ok, count(*) FILTER (WHERE r = 1) = sum(r) AS reference_ok,
count(*) FILTER (WHERE c = 1 AND r = 1) = sum(c * r) AS agreed_ok,
abs({JACC} - CAST(count(*) FILTER (WHERE c = 1 AND r = 1) AS DOUBLE) / count(*)) <= 0.01 AS jaccard_ok FROM p""")
def agree_canary(s, d):
    """The agreement of the two sides against figures of the same table that set operations give."""
    a, b = (x.select("file", "skill_id").distinct() for x in _sides(s, d))
    found, reference, agreed = a.count(), b.count(), a.intersect(b).count()
    recorded = agreed / max(1, found + reference - agreed)
    return agreement.canary(agreement.micro(agreement.paired(*_sides(s, d))), found, reference, agreed, recorded)


@query("""WITH f AS (SELECT DISTINCT e.resume_id, e.skill_id FROM extracted_skill e WHERE skill_id IS NOT NULL),
g AS (SELECT f.resume_id, CASE WHEN contains(lower(c.text), replace(f.skill_id, '_', ' ')) THEN 1 ELSE 0 END AS ok FROM f JOIN corpus_resume c USING (resume_id))
SELECT resume_id, count(*) AS skill_count, CAST(coalesce(sum(ok), 0) AS BIGINT) AS grounded_count, coalesce(avg(ok), 0) AS pass_rate FROM g GROUP BY ROLLUP (resume_id)""")
def ground_report(s, d):
    score = F.when(F.contains(F.lower("text"), F.replace("skill_id", F.lit("_"), F.lit(" "))), 1.0).otherwise(0.0)
    return agreement.grounding(_found(s, d), _resumes(s, d).select("resume_id", "text"), score)


# --- Replies and runs ---------------------------------------------------------------------
def _replies(s, d):
    """Replies of pretended models: the proposals of each model and container as JSON, some of them damaged."""
    p = table(s, d, "proposal").where("batch_index is not null")
    item = F.struct("resume_id", F.coalesce("skill_id", F.lit("NEW")).alias("skill_id"), F.coalesce("quoted_phrase", F.lit("")).alias("quoted_phrase"), "suggested_name")
    body = p.groupBy("model", "batch_index").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("proposal_id"), item.alias("i"))))).alias("j"), F.count("*").alias("n"))
    k = F.col("batch_index")
    listed = F.to_json(F.transform(F.from_json("j", "array<struct<proposal_id:long,i:" + responses.ITEM + ">>"), lambda x: x["i"]))
    content = F.when(k % 5 == 1, F.lit("no json")).when(k % 5 == 2, F.lit('{"a": 1}')).when(k % 5 == 3, F.lit("")).when(k % 7 == 4, F.lit("[]")).otherwise(listed)
    return body.select("model", "batch_index", content.alias("content"), F.when(k % 11 == 6, "length").otherwise("stop").alias("done_reason"), "n")


REPLIES = """WITH p AS (SELECT model, batch_index AS k, count(*) AS n,
 count(*) FILTER (WHERE coalesce(skill_id, 'NEW') <> 'NEW' AND coalesce(skill_id, 'NEW') NOT IN (SELECT skill_id FROM skill)) AS bad
FROM proposal WHERE batch_index IS NOT NULL GROUP BY 1, 2)"""


@query(REPLIES + """ SELECT model, CAST(k AS INT) AS batch_index, CASE WHEN k % 11 = 6 THEN 'length' WHEN k % 5 = 3 THEN 'empty' WHEN k % 5 = 1 THEN 'not_json'
 WHEN k % 5 = 2 THEN 'not_list' WHEN k % 7 = 4 THEN NULL WHEN bad > 0 THEN 'unknown_id' END AS error FROM p""")
def llm_response_checks(s, d):
    return responses.checked(_replies(s, d), _skills(s, d), "model", "batch_index").select("model", "batch_index", "error")


@query("""SELECT DISTINCT skill_id FROM proposal WHERE skill_id IS NOT NULL AND skill_id <> 'NEW' AND skill_id NOT IN (SELECT skill_id FROM skill)""")
def llm_unknown_ids(s, d):
    typed = table(s, d, "proposal").where("skill_id is not null and skill_id <> 'NEW'")
    return typed.join(small(_skills(s, d).select("skill_id"), taxonomy.LIST_ROWS, "skills"), "skill_id", "left_anti").select("skill_id").distinct()


def _calls(s, d):
    return table(s, d, "events").select("event_id", F.col("value").alias("seconds"), F.when(F.col("event_type") == "error", "error").alias("failure"))


@query("SELECT median(value) AS median_s, max(value) AS max_s FROM events WHERE event_type <> 'error'")
def latency_summary(s, d):
    return agreement.latency(_calls(s, d))


@query("SELECT event_id, value AS seconds FROM events WHERE event_type = 'error'")
def failed_seconds(s, d):
    return agreement.failed_seconds(_calls(s, d), "event_id")


@query(REPLIES + """, q AS (SELECT *, (k % 11 <> 6 AND k % 5 NOT IN (1, 2, 3) AND (k % 7 = 4 OR bad = 0)) AS ok FROM p)
SELECT model, count(*) AS n_batches, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed,
CAST(coalesce(sum(CASE WHEN ok AND k % 7 <> 4 THEN n ELSE 0 END), 0) AS BIGINT) AS n_proposals FROM q GROUP BY model""")
def mining_manifest(s, d):
    return responses.manifest(responses.checked(_replies(s, d), _skills(s, d), "model", "batch_index"), "model")


# --- Contracts, prompts and rungs ---------------------------------------------------------
def _requests(s, d):
    """Requests made of the documents; a rule on the row number breaks one rule of the contract in each."""
    k = F.col("doc_id")
    file = F.struct(
        F.when(k % 13 == 0, "url").otherwise("file").alias("kind"), F.when(k % 17 == 0, "%%%").otherwise(F.base64(F.col("text").cast("binary"))).alias("content_base64"),
        F.when(k % 11 == 0, "text/plain").otherwise("application/pdf").alias("mime_type"), F.lit("a.pdf").alias("filename"))
    body = F.struct(
        F.when(k % 7 == 0, "v2").otherwise("v1").alias("schema_version"), k.cast("string").alias("request_id"), F.when(k % 19 != 0, "u").alias("user_id"), file.alias("input"),
        F.struct((k % 12).cast("int").alias("max_roles")).alias("options"), F.when(k % 23 == 0, 1).alias("more"))
    docs = table(s, d, "documents").where("text is not null")
    return contracts.parsed(docs.select("doc_id", F.when(k % 29 == 0, "no json").otherwise(F.to_json(body)).alias("body")))


REQUESTS = """WITH r AS (SELECT doc_id, length(encode(text)) AS size, CASE WHEN k % 29 = 0 THEN 'not an object' WHEN k % 23 = 0 THEN 'unknown field' WHEN k % 19 = 0 THEN 'missing field'
WHEN k % 7 = 0 THEN 'schema_version' WHEN k % 13 = 0 THEN 'kind' WHEN k % 11 = 0 THEN 'mime_type' WHEN k % 12 NOT BETWEEN 1 AND 10 THEN 'max_roles' WHEN k % 17 = 0 THEN 'content_base64' END AS problem
FROM (SELECT *, doc_id AS k FROM documents WHERE text IS NOT NULL))"""


@query(REQUESTS.replace("length(encode(text))", "octet_length(encode(text))") + " SELECT doc_id, problem FROM r")
def contract_requests(s, d):
    return _requests(s, d).select("doc_id", "problem")


@query(REQUESTS.replace("length(encode(text))", "octet_length(encode(text))") + """ SELECT CAST(doc_id AS VARCHAR) AS request_id, CAST(size AS BIGINT) AS n_bytes,
CAST(doc_id % 12 AS INT) AS max_roles FROM r WHERE problem IS NULL""")
def contract_files(s, d):
    return contracts.files(_requests(s, d)).select("request_id", F.octet_length("content").cast("long").alias("n_bytes"), "max_roles")


@query(COVER + """ SELECT resume_id, 'score' AS field FROM cov WHERE score * 1.5 > 1
UNION ALL SELECT resume_id, 'core_ratio' FROM cov WHERE core_ratio - 0.5 < 0""")
def contract_ranges(s, d):
    """Scores and ratios that were moved out of their range on purpose."""
    moved = _cover(s, d).select("resume_id", (F.col("score") * 1.5).alias("score"), (F.col("core_ratio") - 0.5).alias("core_ratio"))
    return contracts.out_of_range(moved, "resume_id").select("resume_id", "field")


@query("""WITH v AS (SELECT count(*) AS n, string_agg(skill_id, chr(10) ORDER BY skill_id) AS list FROM skill)
SELECT resume_id, sha256('' || n || ' ids:' || chr(10) || list || chr(10) || chr(10) || 'RESUME:' || chr(10) || text) AS sha FROM corpus_resume, v WHERE text IS NOT NULL""")
def extraction_prompt(s, d):
    got = ladder.extraction_prompts(_resumes(s, d), _skills(s, d), "{N} ids:\n{SKILL_LIST}\n")
    return got.select("resume_id", F.sha2("prompt", 256).alias("sha"))


def _answers(s, d):
    """Answers of a pretended model: the mentions of each résumé, some of them damaged by a rule on the id."""
    k = F.col("resume_id").cast("long")
    own = _mentions(s, d).groupBy("resume_id").agg(F.array_sort(F.collect_set("skill_id")).alias("skills"))
    good = F.to_json(F.struct(F.col("skills").alias("skills_present")))
    content = F.when(k % 7 == 1, "oops").when(k % 7 == 2, '{"a": 1}').when(k % 7 == 3, "").when(k % 7 == 4, '{"skills_present": 1}').when(
        k % 7 == 5, '{"skills_present": ["no such id"]}').otherwise(good)
    reason, failure = F.when(k % 11 == 1, "length").otherwise("stop"), F.when(k % 13 == 1, "timeout")
    return own.select("resume_id", content.alias("content"), reason.alias("done_reason"), failure.alias("failure"))


ANSWERS = """WITH own AS (SELECT resume_id, CAST(resume_id AS BIGINT) AS k, bool_and(skill_id IN (SELECT skill_id FROM skill)) AS known,
 string_agg(DISTINCT skill_id, ',' ORDER BY skill_id) AS list FROM extracted_skill WHERE skill_id IS NOT NULL AND resume_id IS NOT NULL GROUP BY 1),
a AS (SELECT *, CASE WHEN k % 13 = 1 THEN 'failed' WHEN k % 11 = 1 THEN 'length' WHEN k % 7 = 3 THEN 'empty' WHEN k % 7 = 1 THEN 'not_json' WHEN k % 7 = 2 THEN 'missing_key'
 WHEN k % 7 = 4 THEN 'not_list' WHEN k % 7 = 5 OR NOT known THEN 'unknown_id' END AS error FROM own)"""


@query(ANSWERS + " SELECT resume_id, error, CASE WHEN error IS NULL THEN list END AS skills FROM a")
def rung3_answers(s, d):
    got = ladder.answers(_answers(s, d), _skills(s, d))
    return got.select("resume_id", "error", F.array_join("skills", ",").alias("skills"))


@query(ANSWERS + """, p AS (SELECT e.resume_id AS file, e.skill_id, max(CASE WHEN match_id % 2 = 1 THEN 1 ELSE 0 END) AS r FROM extracted_skill e JOIN a USING (resume_id)
WHERE a.error IS NULL AND e.skill_id IS NOT NULL GROUP BY 1, 2)
SELECT count(*) AS candidate_count, CAST(sum(r) AS BIGINT) AS reference_count, CAST(sum(r) AS BIGINT) AS agreed_count FROM p""")
def rung3_agreement(s, d):
    """Agreement over the texts that were answered; failed ones take no part on either side."""
    done = ladder.answers(_answers(s, d), _skills(s, d)).withColumnRenamed("resume_id", "file")
    found = done.select("file", F.explode("skills").alias("skill_id"))
    total = agreement.micro(agreement.paired(found, ladder.restricted(_sides(s, d)[1], done)))
    return total.select("candidate_count", "reference_count", "agreed_count")


@query(f"""WITH {SPANS}, r AS (SELECT DISTINCT resume_id AS file, skill_id FROM extracted_skill WHERE skill_id IS NOT NULL AND resume_id IS NOT NULL AND match_id % 2 = 1),
c AS (SELECT DISTINCT '1' AS rung, resume_id AS file, skill_id FROM span UNION ALL
 SELECT DISTINCT '2', resume_id, skill_id FROM extracted_skill WHERE skill_id IS NOT NULL AND resume_id IS NOT NULL AND match_id % 2 = 0),
p AS (SELECT rung, file, skill_id, 1 AS c, CASE WHEN (file, skill_id) IN (SELECT (file, skill_id) FROM r) THEN 1 ELSE 0 END AS r FROM c
 UNION ALL SELECT rung, file, skill_id, 0, 1 FROM r, (SELECT unnest(['1', '2']) AS rung) WHERE (rung, file, skill_id) NOT IN (SELECT (rung, file, skill_id) FROM c))
SELECT rung, file, CAST(sum(c) AS BIGINT) AS candidate_count, CAST(sum(r) AS BIGINT) AS reference_count, CAST(sum(c * r) AS BIGINT) AS agreed_count,
CAST(sum(c * r) AS DOUBLE) / (sum(c) + sum(r) - sum(c * r)) AS jaccard FROM p GROUP BY GROUPING SETS ((rung, file), (rung))""")
def rung_agreement(s, d):
    """Two rungs against one reference: the gazetteer, and the mentions of an earlier run."""
    found = {"1": gaz_found(s, d).withColumnRenamed("resume_id", "file"), "2": _sides(s, d)[0]}
    return ladder.compared(found, _sides(s, d)[1])


@query(f"""WITH {ROLES} SELECT (SELECT count(DISTINCT skill_id) FROM skill) AS n_skills, (SELECT count(DISTINCT role_id) FROM role_skill) AS n_roles,
(SELECT count(*) FROM skill_alias) AS n_aliases""")
def tax_counts(s, d):
    return taxonomy.counts(_skills(s, d), _aliases(s, d), _roles(s, d))


# --- Intake -------------------------------------------------------------------------------
@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def hash_docs(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("""SELECT resume_id, '' AS source_url, '' AS retrieved_at, lower(ltrim(file_format, '.')) AS format FROM provenance
WHERE lower(ltrim(file_format, '.')) IN ('pdf', 'docx')""")
def provenance_rows(s, d):
    files = table(s, d, "provenance").where("file_format is not null").select(
        F.concat(F.lit("/in/"), "resume_id", F.lit("."), F.regexp_replace("file_format", r"^\.", "")).alias("path"))
    return intake.provenance(files).select("resume_id", "source_url", "retrieved_at", "format")


@query("""SELECT p.resume_id, p.file_format, coalesce(lower(trim(p.file_format)) IN ('pdf', '.pdf'), false) AND length(coalesce(c.text, '')) < 100 AS insufficient_text
FROM provenance p JOIN corpus_resume c USING (resume_id)""")
def format_dispatch(s, d):
    joined = table(s, d, "provenance").join(_resumes(s, d).select("resume_id", "text"), "resume_id")
    return intake.insufficient(joined).select("resume_id", "file_format", "insufficient_text")


IMAGES = """WITH i AS (SELECT CASE WHEN p_size % 2 = 1 THEN 'pdf' ELSE 'docx' END AS ext, p_size % 4 AS image_count, p_size / 50.0 AS area_frac,
length(p_name) * (p_partkey % 3) AS text_chars FROM part)"""


def _images(s, d):
    return table(s, d, "part").select(
        F.when(F.expr("p_size % 2 = 1"), "pdf").otherwise("docx").alias("ext"), F.expr("p_size % 4").alias("image_count"),
        (F.col("p_size") / 50).alias("area_frac"), (F.length("p_name") * F.expr("p_partkey % 3")).alias("text_chars"),
    )


@query(IMAGES + """ SELECT ext, count(*) AS n_files, count(*) FILTER (WHERE image_count > 0) AS n_with_images, CAST(sum(image_count) AS BIGINT) AS n_images,
count(*) FILTER (WHERE area_frac >= 0.9) AS n_large FROM i GROUP BY GROUPING SETS ((ext), ())""")
def image_audit(s, d):
    return intake.image_audit(_images(s, d))


@query(IMAGES + """ SELECT count(*) AS n_processed, CAST(sum(image_count) AS BIGINT) AS n_removed, count(*) FILTER (WHERE text_chars = 0 AND image_count > 0) AS n_blank,
bool_or(text_chars = 0 AND image_count > 0) AS any_blank FROM i""")
def strip_summary(s, d):
    return intake.strip_summary(_images(s, d))


# --- Sets ---------------------------------------------------------------------------------
def _set_sql(op: str) -> str:
    a = "SELECT DISTINCT resume_id, skill_id FROM extracted_skill WHERE match_id % 2 = 0 AND skill_id IS NOT NULL"
    b = "SELECT DISTINCT resume_id, skill_id FROM extracted_skill WHERE match_id % 2 = 1 AND skill_id IS NOT NULL"
    return {"xor": f"(({a}) EXCEPT ({b})) UNION ALL (({b}) EXCEPT ({a}))"}.get(op, f"({a}) {op} ({b})")


def _two(s, d):
    e = table(s, d, "extracted_skill").where("skill_id is not null")
    return (e.where(f"match_id % 2 = {i}").select("resume_id", "skill_id") for i in (0, 1))


@query(_set_sql("INTERSECT"))
def set_intersect(s, d):
    a, b = _two(s, d)
    return a.intersect(b)


@query(_set_sql("UNION"))
def set_union(s, d):
    a, b = _two(s, d)
    return a.union(b).distinct()


@query(_set_sql("xor"))
def set_symdiff(s, d):
    pairs = agreement.paired(*_two(s, d), file="resume_id")
    return pairs.where("c <> r").select("resume_id", "skill_id")


@query(_set_sql("EXCEPT"))
def set_except(s, d):
    a, b = _two(s, d)
    return a.subtract(b)


@query("SELECT doc_id, i AS ix FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)")
def corpus_index(s, d):
    return with_index(table(s, d, "documents").select("doc_id"), "doc_id")
