"""The pN_ queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import copies, encoding, leakage, lookalike, mapping, packing, personal, reading, tokens
from lexmill.llm.common import table


def p1_found(spark, d):
    return encoding.garbled(table(spark, d, "corpus_resume")).select("resume_id")


def p1_restored(spark, d):
    return encoding.garbled(table(spark, d, "corpus_resume"))


def p2_batches(spark, d):
    return packing.batches(table(spark, d, "corpus_resume"), table(spark, d, "mining_budget"))


def p2_found(spark, d):
    return packing.split(p2_batches(spark, d))


def p2_sums(spark, d):
    return packing.sums(p2_batches(spark, d), table(spark, d, "mining_budget"))


def p3_findings(spark, d):
    return personal.findings(table(spark, d, "corpus_resume"))


def p3_found(spark, d):
    return p3_findings(spark, d).select("resume_id", "kind", "value").distinct()


def p3_redacted(spark, d):
    return personal.redacted(table(spark, d, "corpus_resume"))


def p4_found(spark, d):
    return copies.duplicates(table(spark, d, "corpus_resume"))


def p4_records(spark, d):
    return copies.records(table(spark, d, "corpus_resume"))


def p5_found(spark, d):
    return mapping.mapped(table(spark, d, "proposal"), table(spark, d, "skill"), table(spark, d, "skill_alias"))


def p5_misses(spark, d):
    """The typed names that no entry of the list is near to, with the number of their proposals."""
    missed = p5_found(spark, d).where("skill_id = 'NONE'").select("proposal_id")
    typed = F.lower(F.trim(F.coalesce("suggested_name", "quoted_phrase")))
    rows = table(spark, d, "proposal").join(missed, "proposal_id").groupBy(typed.alias("typed"))
    return rows.agg(F.count("*").alias("n"))


def p6_found(spark, d):
    """Records with stand-in characters; texts that are a case of problem 1 are none here."""
    resumes = table(spark, d, "corpus_resume")
    texts = lookalike.unified(resumes, "resume_id", "text", only_changed=True)
    texts = texts.join(encoding.garbled(resumes).select("resume_id"), "resume_id", "left_anti")
    aliases = lookalike.unified(table(spark, d, "extracted_skill"), "match_id", "matched_alias", only_changed=True)
    return texts.select(F.lit("corpus_resume").alias("table_name"), F.col("resume_id").alias("record_id")).unionAll(
        aliases.select(F.lit("extracted_skill"), F.col("match_id").cast("string"))
    )


def p6_texts(spark, d):
    return lookalike.unified(table(spark, d, "corpus_resume"), "resume_id", "text")


def p6_aliases(spark, d):
    return lookalike.unified(table(spark, d, "extracted_skill"), "match_id", "matched_alias")


def p7_ids(spark, d):
    return tokens.encoded(table(spark, d, "documents"))


def p7_empty(spark, d):
    """The documents without a token."""
    return p7_ids(spark, d).where("size(ids) = 0").select("doc_id")


def p8_leaks(spark, d):
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark, d):
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_found(spark, d):
    return reading.most_demanding(table(spark, d, "documents"), table(spark, d, "reading_sample"))


def p9_levels(spark, d):
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_sample"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


_HEAD = r"(?i)(?:^|\n)[ \t]*(?:##|==)?[ \t]*(" + "|".join(copies.HEADINGS) + r")[ \t]*(?:==[ \t]*(?:\n|$)|:|\n|$)"
_COPIES = rf"""WITH c AS (SELECT resume_id, translate(lower(regexp_replace(coalesce(category, ''), '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')), 'ς', 'σ') || chr(30) ||
 array_to_string(list_sort(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[\r\n|]', chr(10) || chr(10), 'g'), '{_HEAD}', chr(30) || '\1' || chr(31), 'g'), chr(30)),
 lambda f: translate(lower(regexp_replace(f, '[^\p{{L}}\p{{N}}\p{{M}}\x1f]', '', 'g')), 'ς', 'σ')), lambda f: f <> '')), chr(30)) AS canon
 FROM corpus_resume WHERE regexp_matches(text, '[\p{{L}}\p{{N}}]')),
g AS (SELECT resume_id, min(resume_id) OVER (PARTITION BY canon) AS keep_id FROM c)"""


def oracle_sql():
    return {
        "p2_found": "SELECT model, resume_id FROM corpus_resume CROSS JOIN mining_budget WHERE length(text) > char_budget",
        "p2_sums": "SELECT model, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_over FROM corpus_resume CROSS JOIN mining_budget "
        "WHERE text IS NOT NULL GROUP BY model",
        "p7_empty": "SELECT doc_id FROM documents WHERE coalesce(text, '') = ''",
        "p4_found": _COPIES + " SELECT keep_id, resume_id AS dup_id FROM g WHERE resume_id <> keep_id",
        "p4_records": _COPIES + " SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
    }
