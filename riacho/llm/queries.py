"""Queries over training text (p2 to p9), with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from riacho.llm import abuse, boilerplate, budget, encode, garble, leak, refine, scans
from riacho.sources.tables import table


def p2_found(spark, folder):
    return boilerplate.Boilerplate(table(spark, folder, "documents")).lines()


def p2_blocks(spark, folder):
    blocks = boilerplate.Boilerplate(table(spark, folder, "documents")).blocks
    return blocks.select("source", F.size("block").alias("n_lines"), F.xxhash64("block").alias("block_id"), "n_docs", "total")


def p2_clean(spark, folder):
    return boilerplate.Boilerplate(table(spark, folder, "documents")).cleaned().select("doc_id", "text")


def p3_found(spark, folder):
    return scans.ScannedPages(table(spark, folder, "documents")).findings()


def p3_paragraphs(spark, folder):
    return scans.ScannedPages(table(spark, folder, "documents")).paragraphs()


def p3_corrections(spark, folder):
    found = scans.ScannedPages(table(spark, folder, "documents")).fixes
    return found.groupBy("word", "right").agg(F.count(F.lit(1)).alias("n_lines"))


def p4_found(spark, folder):
    return garble.garbled_rows(table(spark, folder, "ipe"), table(spark, folder, "documents")).select("table_name", "row_id")


def p4_restored(spark, folder):
    return garble.garbled_rows(table(spark, folder, "ipe"), table(spark, folder, "documents"))


def p5_found(spark, folder):
    return refine.copies(table(spark, folder, "clean"))


def p5_records(spark, folder):
    clean = table(spark, folder, "clean")
    return refine.collapse(clean, "row_id", "source", "dataset").select("row_id", "sentiment", "source", "dataset", F.col("n_copies").cast("long").alias("n_copies"))


def p6_budget(spark, folder):
    return budget.corpus_budget(table(spark, folder, "documents"))


def p6_labelled(spark, folder):
    return budget.labelled_budget(table(spark, folder, "clean"))


def p6_documents(spark, folder):
    return budget.document_tokens(table(spark, folder, "documents"))


def p7_ids(spark, folder):
    return encode.encode(table(spark, folder, "documents"))


def p8_found(spark, folder):
    return leak.leaked_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_spans(spark, folder):
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p9_found(spark, folder):
    return abuse.toxic_documents(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id")


def p9_scores(spark, folder):
    return abuse.scored_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def p9_rates(spark, folder):
    return abuse.rates(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs, "p3_corrections": p3_corrections, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates, "p2_found": p2_found, "p2_blocks": p2_blocks, "p2_clean": p2_clean, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_records": p5_records, "p6_budget": p6_budget, "p6_labelled": p6_labelled, "p6_documents": p6_documents, "p7_ids": p7_ids, "p8_found": p8_found, "p8_spans": p8_spans}
_WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"

P2 = f"""WITH l AS (SELECT doc_id, coalesce(source, '') AS s, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, s, line_no, trim(regexp_replace(lower(raw), '{_WS}+', ' ', 'g')) AS k FROM l), c AS (SELECT * FROM n WHERE length(regexp_replace(k, '[^\\p{{L}}]', '', 'g')) >= 12),
    t AS (SELECT coalesce(source, '') AS s, count(*) AS total FROM documents GROUP BY 1), f AS (SELECT s, k FROM c JOIN t USING (s) GROUP BY s, k, total HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) * 1000 >= total * 50)
    SELECT doc_id, line_no FROM c JOIN f USING (s, k)"""

P8 = """WITH iw AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM benchmark), dw AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    ip AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, array_to_string(w[p : p + least(12, len(w)) - 1], ' ') AS g FROM iw, unnest(generate_series(1, len(w) - least(12, len(w)) + 1)) u(p) WHERE len(w) > 0),
    ns AS (SELECT DISTINCT n FROM ip), dp AS (SELECT DISTINCT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM dw, ns, unnest(generate_series(1, len(w) - n + 1)) u(p))
    SELECT DISTINCT doc_id, item_id FROM ip JOIN dp USING (n, g)"""

P6_DOCS = """SELECT source, lang, domain, n_docs, n_empty, n_null FROM (SELECT source, coalesce(nullif(lower(trim(lang)), ''), 'und') AS lang, nullif(regexp_replace(lower(trim(domain)), '^(https?://)?(www[0-9]*[.]|m[.])?|[/.]+$', '', 'g'), '') AS domain,
    count(*) AS n_docs, count(*) FILTER (text = '') AS n_empty, count(*) FILTER (text IS NULL) AS n_null FROM documents GROUP BY 1, 2, 3)"""


def p6_slices(spark, folder):
    """Documents of each slice, without tokens, which SQL cannot count."""
    return p6_budget(spark, folder).drop("n_tokens")


QUERIES["p6_slices"] = p6_slices
ORACLES: dict[str, str] = {"p2_found": P2, "p6_slices": P6_DOCS, "p8_found": P8}
