"""Queries of the corpus pipeline over ``ipe``, ``documents``, ``clean`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.operators import corpus, dedup, dsir
from riacho.plans import sqlparts as S
from riacho.sources.tables import table

SIZE, OVERLAP, LEAST = 1000, 100, 200
CATEGORIES = ["fato relevante", "comunicado ao mercado", "aviso aos acionistas", "ata de assembleia"]
BUCKETS, BUDGET = 10_000, 250_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark, folder):
    return table(spark, folder, "documents")


_kept = ", ".join(f"'{c}'" for c in CATEGORIES)
_ipe_key = "concat_ws('|', trim(coalesce(link_download,'')), trim(coalesce(cnpj_companhia,'')), trim(coalesce(data_referencia,'')), trim(coalesce(assunto,'')))"
_name = "concat_ws('_', coalesce(cnpj_companhia,''), coalesce(data_referencia,''), substring(coalesce(assunto,''),1,50))"


@query(f"""SELECT arg_min(ipe_id, (loaded_at, ipe_id)) AS ipe_id, k AS doc_key, substring(sha256(k),1,12) AS document_id,
    arg_min(file_name, (loaded_at, ipe_id)) AS file_name FROM (SELECT *, {_ipe_key} AS k, regexp_replace({_name}, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g') || '.pdf' AS file_name
    FROM ipe WHERE lower(trim(categoria)) IN ({_kept}) AND trim(coalesce(link_download,'')) <> '') GROUP BY k""")
def index_documents(spark, folder):
    rows = corpus.keep_categories(table(spark, folder, "ipe"), CATEGORIES)
    out = corpus.index_documents(rows, "link_download", "cnpj_companhia", "data_referencia", "assunto", F.col("loaded_at"), F.col("ipe_id"))
    return out.select("ipe_id", "doc_key", "document_id", "file_name")


@query("SELECT coalesce(nullif(trim(category),''),'unknown') AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark, folder):
    return docs(spark, folder).groupBy(corpus.default_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_pages = "string_split(coalesce(text,''), chr(12))"
_chars = f"length({S.strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})"
_empty = f"len(list_filter({_pages}, lambda p: {S.strip('p')} = ''))"


@query(f"""SELECT doc_id, pc AS page_count, cc AS char_count, ep AS empty_pages, round(cc / pc, 2) AS text_density, cc > 0 AS success,
    CASE WHEN cc < 100 OR ep / pc > 0.5 OR round(cc / pc, 2) < 50 OR cc = 0 THEN 'low' ELSE 'ok' END AS quality_flag FROM
    (SELECT doc_id, len({_pages})::int AS pc, {_chars}::int AS cc, {_empty}::int AS ep FROM documents)""")
def extraction_quality(spark, folder):
    return docs(spark, folder).select("doc_id", corpus.extraction_quality(F.col("text")).alias("q")).select("doc_id", "q.*")


@query(f"SELECT doc_id, {S.clean('text')} AS text FROM documents WHERE text IS NOT NULL")
def corpus_clean(spark, folder):
    return docs(spark, folder).filter("text is not null").select("doc_id", T.clean(F.col("text")).alias("text"))


_cleaned = f"(SELECT doc_id, t FROM (SELECT doc_id, {S.clean('text')} AS t FROM documents WHERE text IS NOT NULL) WHERE t <> '')"
_chunks = S.chunks(_cleaned, SIZE, OVERLAP)


def _chunk_rows(spark, folder):
    return corpus.chunked(docs(spark, folder), "doc_id", "text", SIZE, OVERLAP)


@query(_chunks)
def corpus_chunks(spark, folder):
    return _chunk_rows(spark, folder)


@query(f"SELECT doc_id, pos, chunk FROM ({_chunks}) WHERE length(chunk) >= {LEAST} QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) = 1")
def corpus_dedup(spark, folder):
    return corpus.accepted(_chunk_rows(spark, folder), "doc_id", LEAST)


@query(f"SELECT doc_id, pos, (row_number() OVER (ORDER BY doc_id, pos) - 1)::bigint AS chunk_id FROM ({_chunks})")
def corpus_chunk_ids(spark, folder):
    return corpus.chunk_ids(_chunk_rows(spark, folder).select("doc_id", "pos"), "doc_id")


@query(f"""WITH c AS ({_chunks}), k AS (SELECT length(chunk) < {LEAST} AS short, count(*) AS n FROM c GROUP BY chunk)
    SELECT 'retained' AS reason, count(*) FILTER (NOT short) AS n FROM k UNION ALL SELECT 'duplicate_chunk', coalesce(sum(n - 1) FILTER (NOT short), 0)::bigint FROM k
    UNION ALL SELECT 'too_short', coalesce(sum(n) FILTER (short), 0)::bigint FROM k""")
def corpus_reasons(spark, folder):
    return corpus.accept_counts(_chunk_rows(spark, folder), LEAST)


_tok = "greatest(1, length(chunk) // 4)"
_q = "floor(round(quantile_cont({t}, {p}), 6))::bigint"


def _stats_sql(source: str, t: str) -> str:
    q = {n: _q.format(t=t, p=p) for n, p in (("median", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))}
    return f"SELECT count({t}) AS n, sum({t})::bigint AS total, round(avg({t}), 2) AS mean, {', '.join(f'{v} AS {k}' for k, v in q.items())}, min({t}) AS min, max({t}) AS max, round(stddev_pop({t}), 4) AS std FROM {source}"


@query(_stats_sql(f"(SELECT chunk FROM ({_chunks}) WHERE length(chunk) >= {LEAST} GROUP BY chunk)", _tok))
def corpus_manifest(spark, folder):
    return corpus.token_stats(corpus.accepted(_chunk_rows(spark, folder), "doc_id", LEAST), T.token_estimate(F.col("chunk")))


@query(_stats_sql("documents WHERE text IS NOT NULL", "greatest(1, least(length(text) // 4, 8192))"))
def token_stats(spark, folder):
    return corpus.token_stats(docs(spark, folder).filter("text is not null"), T.token_estimate(F.col("text"), 8192))


@query("""SELECT n_docs, chars, bytes, tokens, round(bytes / tokens, 6) AS bytes_per_token, round(chars / n_docs, 6) AS avg_chars FROM
    (SELECT count(*) AS n_docs, sum(length(text))::bigint AS chars, sum(octet_length(encode(text)))::bigint AS bytes, sum(greatest(1, length(text) // 4))::bigint AS tokens FROM documents WHERE text IS NOT NULL)""")
def size_stats(spark, folder):
    return corpus.size_stats(docs(spark, folder), F.col("text"))


@query("SELECT count(*) AS n_docs, count(*) FILTER (contains(lower(text), 'hoje')) AS n_hits, round(avg(contains(lower(text), 'hoje')::int), 6) AS ratio FROM documents WHERE text IS NOT NULL")
def keyword_gate(spark, folder):
    return corpus.keyword_ratio(docs(spark, folder), F.col("text"), "hoje")


@query(f"""SELECT n_texts, n_copied, round(n_copied / n_texts, 6) AS rate FROM (SELECT coalesce(sum(n),0)::bigint AS n_texts, coalesce(sum(n) FILTER (n > 1),0)::bigint AS n_copied
    FROM (SELECT count(*) AS n FROM documents WHERE {S.strip('text')} <> '' GROUP BY {S.collapse('text')}))""")
def verbatim_copies(spark, folder):
    return corpus.verbatim_copies(docs(spark, folder), F.col("text"))


@query(f"SELECT row_id, source, dataset FROM clean WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE {S.collapse('b.text')} = {S.collapse('clean.source')})")
def decontaminate(spark, folder):
    rows = table(spark, folder, "clean").select("row_id", "source", "dataset")
    return dedup.without(rows, T.collapse(F.col("source")), table(spark, folder, "benchmark"), T.collapse(F.col("text")))


@query("""WITH c AS (SELECT coalesce(nullif(trim(category),''),'unknown') AS category, count(*) AS n FROM documents GROUP BY 1),
    r AS (SELECT CASE WHEN row_number() OVER (ORDER BY n DESC, category) <= 10 THEN category ELSE 'other' END AS category, n FROM c)
    SELECT category, sum(n)::bigint AS n, round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM r GROUP BY category""")
def category_shares(spark, folder):
    return corpus.shares(docs(spark, folder), F.col("category"))


_words = S.words("text", dsir.TOKENS)
_feats = f"""SELECT doc_id, target, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1]))) AS f FROM
    (SELECT doc_id, coalesce(lower(lang) = 'en', false) AS target, {_words} AS w FROM documents WHERE text IS NOT NULL)"""
_buckets = f"SELECT bucket, count(*) AS source_cnt, count(*) FILTER (target) AS target_cnt FROM (SELECT target, {S.md5_bucket('f', BUCKETS)} AS bucket FROM ({_feats})) GROUP BY bucket"
_ratio = f"""SELECT r.bucket, ln(((coalesce(target_cnt,0) + 1) / (t + {BUCKETS})) / ((coalesce(source_cnt,0) + 1) / (s + {BUCKETS}))) AS log_ratio
    FROM (SELECT unnest(generate_series(0, {BUCKETS - 1})) AS bucket) r LEFT JOIN b USING (bucket), (SELECT sum(source_cnt) AS s, sum(target_cnt) AS t FROM b)"""
_raw = f"""SELECT d.doc_id, d.text, coalesce(x.raw, 0.0) AS raw FROM documents d LEFT JOIN (SELECT doc_id, sum(log_ratio) AS raw FROM (SELECT doc_id, {S.md5_bucket('f', BUCKETS)} AS bucket FROM ({_feats})) JOIN r USING (bucket) GROUP BY doc_id) x USING (doc_id)
    WHERE d.text IS NOT NULL"""
def _target():
    return F.lower("lang") == "en"


def _counts(spark, folder):
    return dsir.bucket_counts(docs(spark, folder), "text", _target(), T.md5_bucket, BUCKETS)


@query(_buckets)
def dsir_buckets(spark, folder):
    """From the first 512 words of each text (``dsir.TOKENS``), as in the reference."""
    return _counts(spark, folder)


@query(f"WITH b AS ({_buckets}) SELECT bucket, round(log_ratio, 6) AS log_ratio FROM ({_ratio})")
def dsir_log_ratio(spark, folder):
    """From the first 512 words of each text (``dsir.TOKENS``), as in the reference."""
    return dsir.log_ratios(_counts(spark, folder), BUCKETS).select("bucket", F.round("log_ratio", 6).alias("log_ratio"))


@query(f"WITH b AS ({_buckets}) SELECT bucket, round(log_ratio, 6) AS log_ratio FROM ({_ratio}) ORDER BY round(log_ratio, 9) DESC, bucket LIMIT 10")
def dsir_top_buckets(spark, folder):
    """The ten buckets that speak most for the target (a report), from the first 512 words of each text."""
    ratios = dsir.log_ratios(_counts(spark, folder), BUCKETS)
    return ratios.orderBy(F.round("log_ratio", 9).desc(), "bucket").limit(10).select("bucket", F.round("log_ratio", 6).alias("log_ratio"))


def _scores(spark, folder):
    d = docs(spark, folder).filter("text is not null")
    feats = dsir.document_features(d, "doc_id", "text", _target(), T.md5_bucket, BUCKETS)
    return dsir.importance(feats, dsir.log_ratios(_counts(spark, folder), BUCKETS), d, "doc_id")


@query(f"WITH b AS ({_buckets}), r AS ({_ratio}) SELECT doc_id, round(raw, 4) AS raw FROM ({_raw})")
def dsir_scores(spark, folder):
    """From the first 512 words of each text (``dsir.TOKENS``), as in the reference."""
    return _scores(spark, folder).select("doc_id", F.round("raw", 4).alias("raw"))


_u = S.hash_uniform("doc_id", "42")
_sel = f"""SELECT doc_id, tok, score, sum(tok) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) - tok AS taken_before FROM
    (SELECT doc_id, greatest(1, least(length(text) // 4, 8192)) AS tok, round(raw - ln(-ln({_u})), 4) AS score FROM ({_raw}))"""


def _selected(spark, folder):
    scored = _scores(spark, folder).select("doc_id", F.round(dsir.gumbel(F.col("raw"), F.col("doc_id")), 4).alias("score"))
    tokens = docs(spark, folder).filter("text is not null").select("doc_id", T.token_estimate(F.col("text"), 8192).alias("tokens"))
    return dsir.take_budget(scored.join(tokens, "doc_id"), [F.desc("score"), F.col("doc_id")], F.col("tokens"), BUDGET)


@query(f"WITH b AS ({_buckets}), r AS ({_ratio}) SELECT doc_id, tok AS tokens, taken_before::bigint AS taken_before FROM ({_sel}) WHERE taken_before < {BUDGET}")
def dsir_select(spark, folder):
    """From the first 512 words of each text (``dsir.TOKENS``), as in the reference."""
    return _selected(spark, folder).select("doc_id", "tokens", "taken_before")


_kl = f"""WITH b AS ({_buckets}), r AS ({_ratio}), sel AS (SELECT doc_id FROM ({_sel}) WHERE taken_before < {BUDGET}),
    q AS (SELECT {S.md5_bucket('f', BUCKETS)} AS bucket, count(*) AS sel_cnt FROM ({_feats}) JOIN sel USING (doc_id) GROUP BY 1),
    a AS (SELECT coalesce(source_cnt,0) AS s, coalesce(target_cnt,0) AS t, coalesce(sel_cnt,0) AS q FROM (SELECT unnest(generate_series(0, {BUCKETS - 1})) AS bucket) x LEFT JOIN b USING (bucket) LEFT JOIN q USING (bucket)),
    p AS (SELECT (t + 1) / (sum(t) OVER () + {BUCKETS}) AS g, (s + 1) / (sum(s) OVER () + {BUCKETS}) AS n, (q + 1) / (sum(q) OVER () + {BUCKETS}) AS q FROM a),
    k AS (SELECT sum(g * ln(g / n)) AS pre, sum(g * ln(g / q)) AS post FROM p)
    SELECT round(pre, 6) AS kl_pre, round(post, 6) AS kl_post, round(pre - post, 6) AS reduction, round((pre - post) / pre, 6) AS ratio FROM k"""


@query(_kl)
def dsir_divergence(spark, folder):
    """From the first 512 words of each text (``dsir.TOKENS``), as in the reference."""
    chosen = _selected(spark, folder).select("doc_id")
    picked = docs(spark, folder).join(chosen, "doc_id", "left_semi")
    sel = dsir.bucket_counts(picked, "text", F.lit(False), T.md5_bucket, BUCKETS).select("bucket", F.col("source_cnt").alias("sel_cnt"))
    return dsir.divergence(_counts(spark, folder), sel, BUCKETS)


@query(f"SELECT doc_id, text FROM (SELECT d.doc_id, d.text FROM documents d JOIN (WITH b AS ({_buckets}), r AS ({_ratio}) SELECT doc_id FROM ({_sel}) WHERE taken_before < {BUDGET}) USING (doc_id))")
def dsir_subset(spark, folder):
    """Texts of the selection in the order of selection: ids are scored by their first 512 words first, whole texts fetched last."""
    order = _selected(spark, folder).select("doc_id", "score")
    return docs(spark, folder).join(order, "doc_id").orderBy(F.desc("score"), "doc_id").select("doc_id", "text")


_thought = "'<think>' || substring(text, 1, 30) || '</think>' || text"
_after = f"list_extract(string_split({_thought}, '</think>'), -1)"
_answer = S.strip(f"regexp_replace({_after}, '(?is)<think>.*$', '', 'g')")
_cut = S.strip("list_extract(string_split_regex(a, '\\n[ \\t]*\\n|Question:'), 1)")
_lone = "length(b) - length(replace(b, '\"', '')) = 1 AND ends_with(b, '\"')"


@query(f"SELECT doc_id, CASE WHEN {_lone} THEN {S.strip(chr(34).join(('regexp_replace(b, ' + chr(39), '$' + chr(39) + ', ' + chr(39) * 2 + ')')))} ELSE b END AS answer FROM (SELECT doc_id, {_cut} AS b FROM (SELECT doc_id, {_answer} AS a FROM documents WHERE text IS NOT NULL))")
def answer_clean(spark, folder):
    """Model answers with their thoughts; here each text is an answer that thinks of its own beginning."""
    raw = F.concat(F.lit("<think>"), F.substring("text", 1, 30), F.lit("</think>"), F.col("text"))
    return docs(spark, folder).filter("text is not null").select("doc_id", T.clean_answer(raw).alias("answer"))


_marked = "'<w:p>' || replace(text, chr(10), '</w:p><w:p a=\"1\">') || '</w:p>'"


@query("SELECT doc_id, " + S.strip(f"replace(replace(replace(replace(regexp_replace(replace({_marked}, '</w:p>', chr(10) || chr(10)), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')") + " AS text FROM documents WHERE text IS NOT NULL")
def tag_strip(spark, folder):
    """Text of marked-up paragraphs; here each line of a text is one."""
    raw = F.concat(F.lit("<w:p>"), F.replace("text", F.lit("\n"), F.lit('</w:p><w:p a="1">')), F.lit("</w:p>"))
    return docs(spark, folder).filter("text is not null").select("doc_id", T.strip_tags(raw).alias("text"))


WORDS = {"cresceu": 2, "avançou": 2, "subiu": 2, "estável": 1, "caiu": 0, "recuou": 0, "encolheu": 0}


@query("SELECT row_id, CASE regexp_extract(lower(source), '(" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WORDS.items()) + " END AS class FROM clean WHERE source IS NOT NULL")
def label_parse(spark, folder):
    from riacho.operators import evaluate

    return table(spark, folder, "clean").filter("source is not null").select("row_id", evaluate.parsed_label(F.col("source"), WORDS).alias("class"))


@query(f"SELECT ipe_id FROM ipe i WHERE year(loaded_at) >= 2020 AND NOT EXISTS (SELECT 1 FROM ipe d WHERE year(d.loaded_at) < 2020 AND {_ipe_key.replace('(link', '(d.link').replace('(cnpj', '(d.cnpj').replace('(data_', '(d.data_').replace('(assunto', '(d.assunto')} = {_ipe_key.replace('(link', '(i.link').replace('(cnpj', '(i.cnpj').replace('(data_', '(i.data_').replace('(assunto', '(i.assunto')})")
def resume(spark, folder):
    """Index rows left to do: those loaded since 2020 whose key was not finished before."""
    ipe = table(spark, folder, "ipe")
    key = T.composite_key(*(F.col(c) for c in ("link_download", "cnpj_companhia", "data_referencia", "assunto")))
    return dedup.without(ipe.filter(F.year("loaded_at") >= 2020), key, ipe.filter(F.year("loaded_at") < 2020), key).select("ipe_id")


_digits = S.digits_padded


@query(f"""WITH r AS (SELECT DISTINCT {_digits('cnpj_cia')} AS c FROM registry WHERE cnpj_cia IS NOT NULL), s AS (SELECT DISTINCT {_digits('cnpj_companhia')} AS c FROM securities WHERE cnpj_companhia IS NOT NULL)
    SELECT c AS cnpj, 'both' AS side FROM r WHERE c IN (FROM s) UNION ALL SELECT c, 'registry' FROM r WHERE c NOT IN (FROM s) UNION ALL SELECT c, 'securities' FROM s WHERE c NOT IN (FROM r)""")
def set_overlap(spark, folder):
    """Companies in both sets, and the orphans of each."""
    r = table(spark, folder, "registry").filter("cnpj_cia is not null").select(T.digits_padded(F.col("cnpj_cia")).alias("cnpj")).distinct()
    s = table(spark, folder, "securities").filter("cnpj_companhia is not null").select(T.digits_padded(F.col("cnpj_companhia")).alias("cnpj")).distinct()
    sides = ((r.intersect(s), "both"), (r.exceptAll(s), "registry"), (s.exceptAll(r), "securities"))
    from riacho.operators.evaluate import union_of

    return union_of([df.withColumn("side", F.lit(name)) for df, name in sides])


@query("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n / 1.0) WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) ELSE printf('%.1f MB', round(n / 1048576.0, 1)) END AS size FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)")
def readable_sizes(spark, folder):
    return docs(spark, folder).filter("text is not null").select("doc_id", T.human_bytes(F.octet_length("text")).alias("size"))
