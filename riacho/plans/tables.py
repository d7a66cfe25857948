"""Queries of labelled text, registry and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.operators import dedup, labels, registry, statements
from riacho.plans import sqlparts as S
from riacho.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


MAP = {"negative": "negative", "neutral": "neutral", "positive": "positive", "mildly positive": "positive", "mildly negative": "negative", "0": "negative", "1": "neutral", "2": "positive"}
_map = "CASE lower(trim(sentiment)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MAP.items()) + " END"


@query(f"SELECT row_id, {_map} AS label FROM clean")
def label_map(spark, folder):
    return table(spark, folder, "clean").select("row_id", labels.mapped(F.col("sentiment"), MAP).alias("label"))


_ds = "regexp_replace(lower(trim(dataset)), '[ _/-]+', '-', 'g')"


@query(f"""SELECT row_id, text, label, dataset, lang FROM (SELECT row_id, source AS text, {_map} AS label, {_ds} AS dataset, NULL::varchar AS lang FROM clean WHERE coalesce({_ds}, '') <> 'benicio-gpt-fin-phrases' AND {S.strip('source')} <> ''
    UNION ALL SELECT item_id, text, NULL, suite, lang FROM benchmark) QUALIFY row_number() OVER (PARTITION BY {S.collapse('text')} ORDER BY dataset IS NULL DESC, dataset, row_id) = 1""")
def label_union(spark, folder):
    """Union of differently shaped sets, one excluded by its tag, the first of each normalised text."""
    name = F.regexp_replace(F.lower(F.trim("dataset")), "[ _/-]+", "-")
    clean = table(spark, folder, "clean").select("row_id", "source", labels.mapped(F.col("sentiment"), MAP).alias("label"), name.alias("dataset"))
    one = labels.aliased(clean.filter(F.coalesce("dataset", F.lit("")) != "benicio-gpt-fin-phrases"), to="text")
    two = table(spark, folder, "benchmark").select(F.col("item_id").alias("row_id"), "text", F.col("suite").alias("dataset"), "lang")
    both = labels.union_all(one, two)
    return dedup.first_wins(both, [T.collapse(F.col("text"))], F.col("dataset"), F.col("row_id")).select("row_id", "text", "label", "dataset", "lang")


@query(f"SELECT k AS key, count(*) AS n_labels, sum(n)::bigint AS n_rows FROM (SELECT {S.canon('source')} AS k, sentiment, count(*) AS n FROM clean WHERE source IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 1")
def label_conflicts(spark, folder):
    return labels.conflicts(table(spark, folder, "clean"), F.col("source"), F.col("sentiment"))


_first = f"(SELECT {S.canon('source')} AS k, arg_min(sentiment, row_id) AS sentiment FROM clean WHERE source IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1)"
_last = f"(SELECT {S.canon('source')} AS k, arg_max(length(source) % 10 / 10, row_id) AS quality FROM clean WHERE source IS NOT NULL AND row_id % 2 = 0 GROUP BY 1)"
_reason = f"""CASE WHEN coalesce({S.strip('c.source')}, '') = '' THEN 'blank_source' WHEN coalesce({S.strip('c.translated')}, '') = '' THEN 'blank_translated'
    WHEN {S.canon('c.source')} = {S.canon('c.translated')} THEN 'echo' WHEN l.sentiment IS NULL THEN 'no_label' WHEN l.sentiment NOT IN ('negative','neutral','positive') THEN 'bad_label' ELSE 'keep' END"""


@query(f"""WITH j AS (SELECT c.row_id, {S.canon('c.source')} AS k, l.sentiment, s.quality, {_reason} AS reason FROM (SELECT row_id, source, coalesce(dataset, source) AS translated FROM clean) c LEFT JOIN {_first} l ON l.k = {S.canon('c.source')} LEFT JOIN {_last} s ON s.k = {S.canon('c.source')})
    SELECT max(row_id) AS row_id, arg_max(sentiment, row_id) AS sentiment, arg_max(quality, row_id) AS quality, 'keep' AS reason, min(row_id) AS first_seen FROM j WHERE reason = 'keep' GROUP BY k
    UNION ALL SELECT row_id, sentiment, quality, reason, NULL FROM j WHERE reason <> 'keep'""")
def label_join(spark, folder):
    """First label and last score of each text, the last good row per text, unfit rows with their reason."""
    clean = table(spark, folder, "clean")
    return _joined(clean, clean.filter("row_id % 2 = 0"))


def _joined(clean, scored):
    rows = clean.select("row_id", "source", F.coalesce("dataset", "source").alias("translated"))
    scores = scored.select("row_id", "source", (F.length("source") % 10 / 10).alias("score"))
    out = labels.final_merge(rows, clean.select("row_id", "source", "sentiment"), scores, [F.col("row_id")], [F.col("row_id")], [F.col("row_id")])
    return out.select("row_id", "sentiment", "quality", "reason", F.col("first_seen.row_id").alias("first_seen"))


@query(ORACLES["label_join"].replace(_last, _last.replace(" AND row_id % 2 = 0", "")))
def label_join_all(spark, folder):
    """As ``label_join``, with the scores of all rows."""
    clean = table(spark, folder, "clean")
    return _joined(clean, clean)


@query("""SELECT event_id, list_sort(list_concat(list_concat(CASE WHEN j ->> '$.k' IS NULL THEN ['missing:k'] ELSE [] END, ['missing:value']), [])) AS faults FROM (SELECT event_id, props AS j FROM events)""")
def contract_faults(spark, folder):
    return table(spark, folder, "events").select("event_id", labels.contract(F.col("props"), ["k", "value"], ["k"]).alias("faults"))


@query("SELECT t.threshold::double AS threshold, count(*) FILTER (l_discount >= t.threshold) AS n FROM lineitem, (VALUES (0.02), (0.04), (0.06), (0.08)) t(threshold) GROUP BY 1")
def threshold_ladder(spark, folder):
    return labels.threshold_ladder(table(spark, folder, "lineitem"), F.col("l_discount"), [0.02, 0.04, 0.06, 0.08])


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean_score, count(*) FILTER (value < 10) AS n_below FROM events")
def score_summary(spark, folder):
    return labels.score_summary(table(spark, folder, "events"), F.col("value"), 10)


@query("""SELECT step, stage, n FROM (SELECT 0 AS step, 'loaded' AS stage, count(*) AS n FROM clean UNION ALL SELECT 1, 'text', count(*) FILTER (source IS NOT NULL) FROM clean
    UNION ALL SELECT 2, 'label', count(*) FILTER (source IS NOT NULL AND sentiment IS NOT NULL) FROM clean UNION ALL SELECT 3, 'dataset', count(*) FILTER (source IS NOT NULL AND sentiment IS NOT NULL AND dataset IS NOT NULL) FROM clean)""")
def run_flow(spark, folder):
    return labels.flow(table(spark, folder, "clean"), ("loaded", F.lit(True)), ("text", F.col("source").isNotNull()), ("label", F.col("sentiment").isNotNull()), ("dataset", F.col("dataset").isNotNull()))


@query("SELECT row_id, CASE substring(lower(trim(sentiment)),1,3) WHEN 'neg' THEN 0 WHEN 'neu' THEN 1 WHEN 'pos' THEN 2 END AS class FROM clean WHERE substring(lower(trim(sentiment)),1,3) IN ('neg','neu','pos')")
def label_classes(spark, folder):
    return table(spark, folder, "clean").select("row_id", labels.label_by_prefix(F.col("sentiment")).alias("class")).filter("class is not null")


_sec = f"(SELECT codigo_negociacao AS ticker, arg_min({S.digits_padded('cnpj_companhia')}, (ano, cnpj_companhia)) AS cnpj FROM securities WHERE regexp_matches(codigo_negociacao, '{registry.TICKER}') GROUP BY 1)"


def _securities(spark, folder):
    return registry.securities(table(spark, folder, "securities"), "codigo_negociacao", "cnpj_companhia", F.col("ano"), F.col("cnpj_companhia"))


@query(f"SELECT ticker, cnpj FROM {_sec}")
def securities_first(spark, folder):
    return _securities(spark, folder)


_rank = "CASE upper(trim(sit)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in registry.STATUS_RANK.items()) + f" ELSE {registry.LAST_RANK} END"
_best = f"(SELECT *, {S.digits_padded('cnpj_cia')} AS cnpj, {_rank} AS rank FROM registry QUALIFY row_number() OVER (PARTITION BY {S.digits_padded('cnpj_cia')} ORDER BY {_rank}, coalesce(try_cast(dt_reg AS date), DATE '0001-01-01') DESC, cd_cvm, dt_reg) = 1)"


@query(f"SELECT cnpj, cd_cvm, sit, rank FROM {_best} WHERE cnpj IS NOT NULL")
def registry_best(spark, folder):
    return registry.best_entries(table(spark, folder, "registry"), "cnpj_cia", "sit", "dt_reg", F.col("cd_cvm"), F.col("dt_reg")).select("cnpj", "cd_cvm", "sit", "rank")


# Tickers to resolve: every second one is asked for under another class, so that the fallback works.
_asked = "(SELECT DISTINCT CASE WHEN cnpj IS NOT NULL AND ascii(substring(ticker,2,1)) % 2 = 0 THEN substring(ticker,1,4) || '5' ELSE ticker END AS ticker FROM known)"
_resolved = f"""WITH known AS {_sec}, asked AS {_asked}, s AS (SELECT ticker, list_value('3','4','5','6','11') AS x FROM asked), p AS (SELECT ticker, unnest(x) AS suffix, unnest(generate_series(0,4)) AS pos FROM s),
    h AS (SELECT p.ticker, pos, k.ticker AS sibling, k.cnpj FROM p JOIN known k ON k.ticker = substring(p.ticker,1,4) || suffix WHERE k.ticker <> p.ticker AND k.cnpj IS NOT NULL),
    b AS (SELECT ticker, arg_min(sibling, pos) AS sibling, arg_min(cnpj, pos) AS cnpj FROM h GROUP BY 1)
    SELECT a.ticker, coalesce(k.cnpj, b.cnpj) AS cnpj, CASE WHEN k.cnpj IS NOT NULL THEN 'direct' WHEN b.cnpj IS NOT NULL THEN 'base (' || b.sibling || ')' END AS provenance FROM asked a LEFT JOIN known k USING (ticker) LEFT JOIN b USING (ticker)"""


def _resolve(spark, folder):
    known = _securities(spark, folder)
    other = F.when(F.col("cnpj").isNotNull() & (F.ascii(F.substring("ticker", 2, 1)) % 2 == 0), F.concat(F.substring("ticker", 1, 4), F.lit("5"))).otherwise(F.col("ticker"))
    return registry.resolve(known.select(other.alias("ticker")).distinct(), known)


@query(_resolved)
def registry_resolve(spark, folder):
    return _resolve(spark, folder)


@query(f"SELECT r.ticker, r.cnpj, r.provenance, e.cd_cvm FROM ({_resolved}) r LEFT JOIN {_best} e USING (cnpj)")
def registry_enriched(spark, folder):
    best = registry.best_entries(table(spark, folder, "registry"), "cnpj_cia", "sit", "dt_reg", F.col("cd_cvm"), F.col("dt_reg")).select("cnpj", "cd_cvm")
    return _resolve(spark, folder).join(best, "cnpj", "left").select("ticker", "cnpj", "provenance", "cd_cvm")


@query(f"SELECT count(*) AS n, count(cnpj) AS n_found, round(avg((cnpj IS NOT NULL)::int), 6) AS coverage FROM ({_resolved})")
def registry_coverage(spark, folder):
    return registry.coverage(_resolve(spark, folder), "cnpj")


NAMES = {"3.01": "revenue", "3.11": "profit", "3.11.01": "profit_owners", "2.01": "current", "2.02": "non_current", "2.03": "equity"}
_lines = f"""(SELECT line_id, {S.digits_padded('cnpj_cia')} AS cnpj, denom_cia AS name, d AS date, year(d)::int AS year, month(d)::int AS month, CASE WHEN month(d) % 3 = 0 THEN 'Q' || (month(d) // 3) END AS quarter,
    year(d) || '-' || CASE WHEN month(d) % 3 = 0 THEN 'Q' || (month(d) // 3) END AS period, cd_conta AS account, try_cast(trim(vl_conta) AS double) AS value, table_code, received_at
    FROM (SELECT *, CASE WHEN regexp_matches(trim(dt_refer), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(trim(dt_refer) AS date) END AS d FROM statement_lines) WHERE d IS NOT NULL AND upper(trim(ordem_exerc)) IN ('ÚLTIMO','ULTIMO'))"""
_vals = ", ".join(f"('{k}', '{v}')" for k, v in NAMES.items())
_named = f"(SELECT l.*, n.name AS account_name FROM {_lines} l JOIN (VALUES {_vals}) n(prefix, name) ON l.account = n.prefix OR starts_with(l.account, n.prefix || '.') QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY length(prefix) DESC) = 1)"


def _parsed(spark, folder):
    return statements.parsed_lines(table(spark, folder, "statement_lines"))


@query(f"SELECT line_id, cnpj, date, year, month, quarter, period, value FROM {_lines}")
def statement_lines_parsed(spark, folder):
    return _parsed(spark, folder).select("line_id", "cnpj", "date", "year", "month", "quarter", "period", "value")


@query(f"SELECT line_id, account, account_name FROM {_named}")
def statement_accounts(spark, folder):
    return statements.account_names(_parsed(spark, folder), NAMES).select("line_id", "account", "account_name")


def _pivot_sql(names: list[str], table_code: str) -> str:
    cols = ", ".join(f"arg_min(value, (received_at, line_id)) FILTER (account_name = '{n}' AND value IS NOT NULL) AS {n}" for n in names)
    return f"SELECT cnpj, year, quarter, period, {cols} FROM {_named} WHERE table_code = '{table_code}' AND cnpj IS NOT NULL AND quarter IS NOT NULL GROUP BY ALL"


_income, _balance = ["revenue", "profit", "profit_owners"], ["current", "non_current", "equity"]
_keys = ["cnpj", "year", "quarter", "period"]


def _pivoted(spark, folder, names, code):
    rows = statements.account_names(_parsed(spark, folder), NAMES).filter(F.col("table_code") == code)
    return statements.pivoted(rows, _keys, names, [F.col("received_at"), F.col("line_id")])


@query(_pivot_sql(_income, "DRE_con"))
def statement_pivot(spark, folder):
    return _pivoted(spark, folder, _income, "DRE_con")


@query(f"SELECT * FROM ({_pivot_sql(_income, 'DRE_con')}) FULL JOIN ({_pivot_sql(_balance, 'BPP_con')}) USING (cnpj, year, quarter, period)")
def statement_merge(spark, folder):
    return statements.merged(_pivoted(spark, folder, _income, "DRE_con"), _pivoted(spark, folder, _balance, "BPP_con"), _keys)


_q = f"(SELECT DISTINCT cnpj, year, quarter FROM {_lines} WHERE quarter IS NOT NULL AND ascii(substring(cnpj, 5, 1)) % 2 = 0)"


@query(f"WITH q AS {_q} SELECT cnpj, year, quarter FROM q UNION ALL SELECT DISTINCT cnpj, year, NULL FROM {_lines} l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.cnpj = l.cnpj)")
def statement_fallback(spark, folder):
    lines = _parsed(spark, folder)
    quarterly = lines.filter(F.col("quarter").isNotNull() & (F.ascii(F.substring("cnpj", 5, 1)) % 2 == 0)).select("cnpj", "year", "quarter").distinct()
    return statements.with_annual(quarterly, lines.select("cnpj", "year").distinct(), "cnpj")


@query(ORACLES["statement_fallback"].replace(_q, _q.replace(" AND ascii(substring(cnpj, 5, 1)) % 2 = 0", "")))
def statement_fallback_all(spark, folder):
    """As ``statement_fallback``, with the quarters of all companies."""
    lines = _parsed(spark, folder)
    quarterly = lines.filter("quarter is not null").select("cnpj", "year", "quarter").distinct()
    return statements.with_annual(quarterly, lines.select("cnpj", "year").distinct(), "cnpj")


@query(f"SELECT count(DISTINCT cnpj) AS n_companies, count(DISTINCT period) AS n_periods, min(period) AS first_period, max(period) AS last_period FROM {_lines}")
def statement_span(spark, folder):
    return statements.span(_parsed(spark, folder), "cnpj", "period")


@query(f"SELECT line_id, value FROM {_lines} QUALIFY row_number() OVER (PARTITION BY cnpj, date, table_code, account ORDER BY received_at DESC, line_id DESC) = 1")
def statement_latest(spark, folder):
    return statements.latest_received(_parsed(spark, folder)).select("line_id", "value")


@query(f"SELECT w.cnpj, EXISTS (SELECT 1 FROM {_lines} l WHERE l.cnpj = w.cnpj) AS found FROM (SELECT DISTINCT {S.digits_padded('cnpj_companhia')} AS cnpj FROM securities WHERE cnpj_companhia IS NOT NULL) w")
def statement_requested(spark, folder):
    wanted = table(spark, folder, "securities").select(T.digits_padded(F.col("cnpj_companhia")).alias("cnpj")).filter("cnpj is not null").distinct()
    rows, missing = statements.restricted(_parsed(spark, folder), "cnpj", wanted)
    return rows.select("cnpj").distinct().withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query(f"SELECT line_id, round(sum(value) OVER (PARTITION BY name), 2) AS value_total FROM {_lines} WHERE name IS NOT NULL")
def company_totals(spark, folder):
    return statements.total_over(_parsed(spark, folder).filter("name is not null"), "value", "name").select("line_id", F.round("value_total", 2).alias("value_total"))
