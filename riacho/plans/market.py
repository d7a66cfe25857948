"""Queries of panels, run analytics, evaluation and portfolios, over orders, line items, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from riacho.operators import evaluate, panel, portfolio, runs
from riacho.plans import sqlparts as S
from riacho.sources.tables import table
from riacho.streaming import ingest

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Nations stand for stocks: their yearly turnover is the fundamental, their last order of a month the price.
FIRST, LAST = 1995, 2000
_year = f"(SELECT c_nationkey AS e, (year(o_orderdate) - {FIRST})::int AS t, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN {FIRST} AND {LAST} GROUP BY 1, 2)"
_d = f"(SELECT e, t, x, x - (regr_intercept(x, t) OVER w + regr_slope(x, t) OVER w * t) AS d FROM (SELECT e, t, ln(1 + greatest(v, 0)) AS x FROM {_year}) WINDOW w AS (PARTITION BY e))"
_rate = f"(SELECT (year(l_shipdate) - {FIRST})::int AS t, avg(l_discount) AS rate FROM lineitem WHERE year(l_shipdate) BETWEEN {FIRST} AND {LAST} GROUP BY 1)"
_f = f"""(SELECT d.*, m, (rate - (SELECT avg(rate) FROM {_rate})) / (SELECT stddev_pop(rate) FROM {_rate}) * (SELECT stddev_pop(d) FROM {_d}) AS s
    FROM {_d} d JOIN (SELECT t, avg(d) AS m FROM {_d} GROUP BY t) USING (t) JOIN {_rate} USING (t))"""
_eps = f"""(SELECT f.*, d - c.y - (my * ss - sy * ms) / (mm * ss - ms * ms) * (m - c.m0) - (sy * mm - my * ms) / (mm * ss - ms * ms) * (s - c.s0) AS eps FROM {_f} f,
    (SELECT avg(d) AS y, avg(m) AS m0, avg(s) AS s0, var_pop(m) AS mm, var_pop(s) AS ss, covar_pop(m, s) AS ms, covar_pop(m, d) AS my, covar_pop(s, d) AS sy FROM {_f}) c)"""
_ranks = "(SELECT e, t, rank() OVER (PARTITION BY e ORDER BY q) + (count(*) OVER (PARTITION BY e, q) - 1) / 2.0 AS r FROM (SELECT e, t, round(eps, 9) AS q FROM {eps}))"
_pairs = f"(SELECT a.e AS i, b.e AS j, coalesce(CASE WHEN isnan(corr(a.r, b.r)) THEN 0 ELSE corr(a.r, b.r) END, 0) AS rho FROM {_ranks.format(eps=_eps)} a JOIN {_ranks.format(eps=_eps)} b ON a.t = b.t AND a.e < b.e GROUP BY 1, 2)"


def _years(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = joined.filter(F.year("o_orderdate").between(FIRST, LAST))
    return rows.groupBy(F.col("c_nationkey").alias("e"), (F.year("o_orderdate") - FIRST).alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


def _rates(spark, folder):
    rows = table(spark, folder, "lineitem").filter(F.year("l_shipdate").between(FIRST, LAST))
    return rows.groupBy((F.year("l_shipdate") - FIRST).alias("t")).agg(F.avg("l_discount").alias("rate"))


def _detrended(spark, folder):
    return panel.detrended(_years(spark, folder).withColumn("x", F.log1p(F.greatest("v", F.lit(0.0)))), "e", "t", "x")


def _residuals(spark, folder):
    return panel.pooled_residuals(panel.with_factors(_detrended(spark, folder), "t", "d", _rates(spark, folder)), "d", "m", "s")


def _spearman(spark, folder):
    ranked = panel.average_ranks(_residuals(spark, folder).select("e", "t", F.round("eps", 9).alias("q")), "e", "q")
    return panel.pair_correlations(ranked, "e", "t", "r")


@query(f"SELECT e, t, round(d, 6) AS d FROM {_d}")
def detrend(spark, folder):
    return _detrended(spark, folder).select("e", "t", F.round("d", 6).alias("d"))


@query(f"SELECT e, t, round(m, 6) AS m, round(s, 6) AS s FROM {_f}")
def market_factors(spark, folder):
    return panel.with_factors(_detrended(spark, folder), "t", "d", _rates(spark, folder)).select("e", "t", F.round("m", 6).alias("m"), F.round("s", 6).alias("s"))


@query(f"SELECT e, t, round(eps, 6) AS eps FROM {_eps}")
def pooled_ols(spark, folder):
    return _residuals(spark, folder).select("e", "t", F.round("eps", 6).alias("eps"))


@query(f"SELECT i, j, round(rho, 6) AS rho FROM {_pairs}")
def spearman_pairs(spark, folder):
    return _spearman(spark, folder).select("i", "j", F.round("rho", 6).alias("rho"))


@query(f"SELECT i, j, round(rho * 0.7, 6) AS rho_identity, round(rho * 0.5 + avg(rho) OVER () * 0.5, 6) AS rho_mean FROM {_pairs}")
def shrinkage(spark, folder):
    return panel.shrunk(_spearman(spark, folder)).select("i", "j", F.round("rho_identity", 6).alias("rho_identity"), F.round("rho_mean", 6).alias("rho_mean"))


@query(f"SELECT count(*) AS n_pairs, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.5), 6) AS median, round(max(rho), 6) AS max FROM {_pairs}")
def triangle_stats(spark, folder):
    return panel.triangle(_spearman(spark, folder))


@query(f"SELECT i, j, round(rho, 6) AS rho, side FROM ((SELECT *, 'most' AS side FROM {_pairs} ORDER BY round(rho, 9) DESC, i, j LIMIT 5) UNION ALL (SELECT *, 'least' FROM {_pairs} ORDER BY round(rho, 9), i, j LIMIT 5))")
def extreme_pairs(spark, folder):
    return panel.extremes(_spearman(spark, folder)).select("i", "j", F.round("rho", 6).alias("rho"), "side")


_traits = f"(SELECT x.e, regr_slope(d, m) AS beta, avg(x.x) AS score, any_value(n_regionkey) AS grp FROM {_f} x JOIN nation ON n_nationkey = x.e GROUP BY 1)"
_gap = "coalesce(abs(a.{0} - b.{0}) / nullif((SELECT max({0}) - min({0}) FROM {1}), 0), 0)"


@query(f"""SELECT i, j, round(p, 6) AS proxy, round((rho + p) / 2, 6) AS blend FROM (SELECT i, j, rho, greatest(-1, least(1, 0.5 - 0.3 * {_gap.format('beta', _traits)} - 0.2 * {_gap.format('score', _traits)} + CASE WHEN a.grp = b.grp THEN 0.2 ELSE 0 END)) AS p
    FROM {_pairs} JOIN {_traits} a ON a.e = i JOIN {_traits} b ON b.e = j)""")
def fundamental_proxy(spark, folder):
    x = panel.with_factors(_detrended(spark, folder), "t", "d", _rates(spark, folder))
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("e"), F.col("n_regionkey").alias("grp"))
    traits = x.groupBy("e").agg(F.regr_slope("d", "m").alias("beta"), F.avg("x").alias("score")).join(nations, "e")
    return panel.proxy(_spearman(spark, folder), traits, "e").select("i", "j", F.round("proxy", 6).alias("proxy"), F.round("blend", 6).alias("blend"))


DRAWS = 100
_draw = f"(SELECT b, floor({S.hash_uniform(chr(40) + 'b || ' + chr(39) + ',' + chr(39) + ' || k' + chr(41), '42')} * {LAST - FIRST + 1})::int AS t FROM generate_series(0, {DRAWS - 1}) x(b), generate_series(0, {LAST - FIRST}) y(k))"
_boot = f"""(SELECT i, j, tanh(quantile_cont(z, 0.025)) AS lo, tanh(quantile_cont(z, 0.975)) AS hi FROM (SELECT i, j, b, atanh(greatest(-0.999, least(0.999, round(coalesce(CASE WHEN isnan(corr(x, y)) THEN 0 ELSE corr(x, y) END, 0), 9)))) AS z
    FROM (SELECT p.e AS i, q.e AS j, p.t, p.x, q.x AS y FROM (SELECT e, t, round(eps, 9) AS x FROM {_eps} WHERE e < 8) p JOIN (SELECT e, t, round(eps, 9) AS x FROM {_eps} WHERE e < 8) q ON p.t = q.t AND p.e < q.e) JOIN {_draw} USING (t) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _stability(spark, folder):
    """A universe of eight nations is the feature here: stability is asked of a chosen set."""
    x = _residuals(spark, folder).filter("e < 8").select("e", "t", F.round("eps", 9).alias("x"))
    return panel.bootstrap_pairs(x, "e", "t", "x", DRAWS)


@query(f"SELECT i, j, round(lo, 5) AS lo, round(hi, 5) AS hi, round(lo, 6) > 0 OR round(hi, 6) < 0 AS stable FROM {_boot}")
def bootstrap_stability(spark, folder):
    return _stability(spark, folder).select("i", "j", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "stable")


@query(f"""SELECT n_pairs, n_stable, mean_width, CASE WHEN mean_width < 0.5 AND n_stable / n_pairs > 0.3 THEN 'stable' ELSE 'unstable' END AS verdict FROM
    (SELECT count(*) AS n_pairs, count(*) FILTER (round(lo, 6) > 0 OR round(hi, 6) < 0) AS n_stable, round(avg(hi - lo), 6) AS mean_width FROM {_boot})""")
def stability_verdict(spark, folder):
    return panel.verdict(_stability(spark, folder))


_draw_all = _draw.replace(f"generate_series(0, {DRAWS - 1})", "generate_series(0, 499)")
_boot_all = _boot.replace(" WHERE e < 8", "").replace(_draw, _draw_all)


def _stability_all(spark, folder):
    """Every nation and the operator's own number of draws."""
    return panel.bootstrap_pairs(_residuals(spark, folder).select("e", "t", F.round("eps", 9).alias("x")), "e", "t", "x")


@query(f"SELECT i, j, round(lo, 5) AS lo, round(hi, 5) AS hi, round(lo, 6) > 0 OR round(hi, 6) < 0 AS stable FROM {_boot_all}")
def bootstrap_stability_all(spark, folder):
    return _stability_all(spark, folder).select("i", "j", F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"), "stable")


@query(f"""SELECT n_pairs, n_stable, mean_width, CASE WHEN mean_width < 0.5 AND n_stable / n_pairs > 0.3 THEN 'stable' ELSE 'unstable' END AS verdict FROM
    (SELECT count(*) AS n_pairs, count(*) FILTER (round(lo, 6) > 0 OR round(hi, 6) < 0) AS n_stable, round(avg(hi - lo), 6) AS mean_width FROM {_boot_all})""")
def stability_verdict_all(spark, folder):
    return panel.verdict(_stability_all(spark, folder))


@query()
def decorrelated_universe(spark, folder):
    """Greedy choice in score order; order-dependent, so it is tested against a plain loop."""
    ranked = _years(spark, folder).groupBy("e").agg(F.sum("v").alias("score"))
    from pyspark.sql import Window

    ranked = ranked.select("e", F.row_number().over(Window.orderBy(F.desc("score"), "e")).alias("position"))  # one row per nation
    return panel.decorrelated(ranked, _spearman(spark, folder), "e")


_w = "WINDOW w AS (PARTITION BY e ORDER BY t)"


@query(f"""SELECT e, count(v) AS n, round(regr_slope(v, t) / avg(v), 6) AS slope, round(sqrt(avg(d * d)) / avg(v), 6) AS deviation, round(avg((v > 0)::int), 6) AS positive, round(avg(((v - b) / b > 0)::int), 6) AS rises,
    round(least(1, 1 - min(v / greatest(top, 1))), 6) AS drawdown FROM (SELECT e, t, v, lag(v) OVER w AS b, max(v) OVER w AS top, v - (regr_intercept(v, t) OVER p + regr_slope(v, t) OVER p * t) AS d FROM {_year} WINDOW w AS (PARTITION BY e ORDER BY t), p AS (PARTITION BY e)) GROUP BY e""")
def series_profile(spark, folder):
    return panel.series_profile(_years(spark, folder), "e", "t", "v")


_wide = ", ".join(f"sum(v) FILTER (t = {y - FIRST}) AS y{y}" for y in range(FIRST, LAST + 1))


@query(f"SELECT e, (t + {FIRST})::int AS year, v AS value FROM {_year}")
def year_panel(spark, folder):
    """Wide columns ``turnover <year>`` back to long form; only complete series stay."""
    years = list(range(FIRST, LAST + 1))
    wide = _years(spark, folder).groupBy("e").agg(*(F.max(F.when(F.col("t") == y - FIRST, F.col("v"))).alias(f"turnover {y}") for y in years))
    return panel.complete_only(panel.unpivot_years(wide, ["e"], "turnover"), "e", "value", len(years)).select("e", "year", "value")


_last = "(SELECT c_nationkey AS e, last_day(o_orderdate) AS month, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_monthly = f"""(SELECT e, month, value FROM (SELECT e, month, value, count(*) FILTER (value IS NULL) OVER (PARTITION BY e) AS gap FROM (SELECT e, month, last_value(x.value IGNORE NULLS) OVER (PARTITION BY e ORDER BY month) AS value
    FROM (SELECT DISTINCT e FROM {_last}) CROSS JOIN (SELECT last_day(unnest(generate_series(date_trunc('month', (SELECT min(month) FROM {_last})), date_trunc('month', (SELECT max(month) FROM {_last})), INTERVAL 1 MONTH))) AS month) LEFT JOIN {_last} x USING (e, month))) WHERE gap = 0)"""
_ret = f"(SELECT e, month, ret FROM (SELECT e, month, value / lag(value) OVER (PARTITION BY e ORDER BY month) - 1 AS ret FROM {_monthly}) WHERE ret IS NOT NULL)"


def _months(spark, folder):
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return panel.month_end(joined.withColumnRenamed("c_nationkey", "e"), "e", F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"))


def _returns(spark, folder):
    return panel.returns(_months(spark, folder), "e", "month", "value").select("e", "month", "ret")


@query(f"SELECT e, month::date AS month, value FROM {_monthly}")
def monthly_prices(spark, folder):
    return _months(spark, folder).select("e", "month", "value")


@query(f"SELECT e, month::date AS month, round(ret, 6) AS ret FROM {_ret}")
def monthly_returns(spark, folder):
    return _returns(spark, folder).select("e", "month", F.round("ret", 6).alias("ret"))


@query(f"SELECT e, round(avg(ret), 6) AS mean FROM {_ret} GROUP BY e ORDER BY round(avg(ret), 9) DESC, e LIMIT 18")
def top_returns(spark, folder):
    """The eighteen nations of the highest mean return (a top-k report)."""
    return portfolio.top_by_mean(portfolio.varying(_returns(spark, folder), "e"), "e", 18).select("e", F.round("mean", 6).alias("mean"))


@query(f"SELECT month::date AS month, round(rate, 6) AS rate, round(avg(ret), 6) AS mean_ret FROM {_ret} JOIN (SELECT last_day(l_shipdate) AS month, avg(l_discount) AS rate FROM lineitem GROUP BY 1) USING (month) GROUP BY ALL")
def rate_join(spark, folder):
    rate = table(spark, folder, "lineitem").groupBy(F.last_day("l_shipdate").alias("month")).agg(F.avg("l_discount").alias("rate"))
    return _returns(spark, folder).groupBy("month").agg(F.round(F.avg("ret"), 6).alias("mean_ret")).join(rate, "month").select("month", F.round("rate", 6).alias("rate"), "mean_ret")


@query("""SELECT month::date AS month, CASE WHEN count(rate) OVER w >= 12 THEN round_even(avg(rate) OVER w, 2) END AS mean FROM
    (SELECT last_day(l_shipdate) AS month, round(avg(l_quantity), 4) AS rate FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY month ROWS 11 PRECEDING)""")
def rolling_rate(spark, folder):
    rate = table(spark, folder, "lineitem").groupBy(F.last_day("l_shipdate").alias("month")).agg(F.round(F.avg("l_quantity"), 4).alias("rate"))
    return panel.rolling_mean(rate, [], ["month"], "rate", 12, 12).select("month", "mean")


@query("SELECT DISTINCT n_nationkey::bigint AS e FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey")
def common_universe(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("e"))
    s = table(spark, folder, "supplier").select(F.col("s_nationkey").cast("long").alias("e"))
    c = table(spark, folder, "customer").select(F.col("c_nationkey").cast("long").alias("e"))
    return n.intersect(s).intersect(c)


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 950 AND ends_with(p_brand, '3')")
def universe(spark, folder):
    return table(spark, folder, "part").filter((F.col("p_retailprice") > 950) & F.col("p_brand").endswith("3")).select("p_partkey", "p_retailprice")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def natural_join(spark, folder):
    n = table(spark, folder, "nation").withColumnRenamed("n_regionkey", "regionkey")
    r = table(spark, folder, "region").withColumnRenamed("r_regionkey", "regionkey")
    return n.join(r, [c for c in n.columns if c in r.columns]).select("n_nationkey", "n_name", F.col("regionkey").alias("n_regionkey"), "r_name")


_ev = "(SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events)"


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING), 6) AS trailing_mean FROM events")
def trailing_mean(spark, folder):
    return runs.trailing_mean(table(spark, folder, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", F.round("trailing_mean", 6).alias("trailing_mean"))


@query("SELECT event_id, max(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def running_best(spark, folder):
    rows = table(spark, folder, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return runs.running_best(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", "best")


@query("""WITH RECURSIVE h AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL),
    r AS (SELECT user_id, n, value::double AS ema FROM h WHERE n = 1 UNION ALL SELECT h.user_id, h.n, 0.3 * h.value + 0.7 * r.ema FROM r JOIN h ON h.user_id = r.user_id AND h.n = r.n + 1)
    SELECT user_id, max(n)::int AS n, round(arg_max(ema, n), 6) AS ema FROM r GROUP BY user_id""")
def ema(spark, folder):
    return runs.ema(table(spark, folder, "events"), "user_id", F.struct("ts", "event_id"), F.col("value")).select("user_id", "n", F.round("ema", 6).alias("ema"))


@query("""WITH x AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, sum((event_type <> 'error')::int) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
    c AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS in_a_row FROM x) SELECT event_id, user_id, in_a_row FROM c WHERE bad AND in_a_row % 3 = 0""")
def breaker(spark, folder):
    return runs.breaker(table(spark, folder, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "user_id", "in_a_row")


@query("SELECT event_type, max(event_id) AS last_step, arg_max(event_id, (value, -event_id)) AS best_step, max(value) AS best FROM events GROUP BY 1")
def best_step(spark, folder):
    return runs.best_step(table(spark, folder, "events"), "event_type", F.col("event_id"), F.col("value"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_ms, round(count(value) / (sum(value) / 1000), 4) AS per_second FROM events GROUP BY 1")
def throughput(spark, folder):
    return runs.throughput(table(spark, folder, "events"), ["event_type"], F.col("value")).withColumn("per_second", F.round("per_second", 4))


@query("SELECT round(regr_intercept(o_totalprice, log10(o_custkey)), 4) AS intercept, round(regr_slope(o_totalprice, log10(o_custkey)), 4) AS slope FROM orders WHERE o_custkey > 0")
def log_fit(spark, folder):
    return runs.log_fit(table(spark, folder, "orders"), F.col("o_custkey"), F.col("o_totalprice")).select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def daily_events(spark, folder):
    """The batch form of the stream's windowed counts (an extension)."""
    return ingest.windowed(table(spark, folder, "events"), "ts", "1 day", None).select("day", "event_type", "n", F.round("total", 4).alias("total"))


_pred = "(list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::int"
_cm = f"(SELECT g.c AS gold, p.c AS predicted, coalesce(n, 0) AS n FROM (SELECT unnest(range(10))::int AS c) g CROSS JOIN (SELECT unnest(range(10))::int AS c) p LEFT JOIN (SELECT label, {_pred} AS pred, count(*) AS n FROM embeddings GROUP BY 1, 2) x ON x.label = g.c AND x.pred = p.c)"


def _matrix(spark, folder):
    e = table(spark, folder, "embeddings")
    return evaluate.confusion(e, F.col("label"), evaluate.argmax(F.col("embedding"), 10), list(range(10)))


@query(f"SELECT gold, predicted, n FROM {_cm}")
def confusion(spark, folder):
    return _matrix(spark, folder)


@query(f"""SELECT sum(s)::bigint AS n, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(CASE WHEN s + c > 0 THEN 2 * tp / (s + c) ELSE 0 END), 6) AS macro_f1 FROM
    (SELECT gold, sum(n) AS s, sum(n) FILTER (gold = predicted) AS tp FROM {_cm} GROUP BY 1) JOIN (SELECT predicted AS gold, sum(n) AS c FROM {_cm} GROUP BY 1) USING (gold)""")
def macro_f1(spark, folder):
    return evaluate.f1(_matrix(spark, folder))


@query("""SELECT n, round(m, 6) AS mean_diff, round(sd / sqrt(n), 6) AS se, round(m - 1.96 * sd / sqrt(n), 6) AS lo, round(m + 1.96 * sd / sqrt(n), 6) AS hi, wins FROM
    (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd, count(*) FILTER (d > 0) AS wins FROM (SELECT b.s - a.s AS d FROM (SELECT l_orderkey AS k, avg(l_tax) AS s FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) a JOIN (SELECT l_orderkey AS k, avg(l_tax) AS s FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) b USING (k)))""")
def paired_interval(spark, folder):
    li = table(spark, folder, "lineitem")
    a, b = (li.filter(F.col("l_linenumber") % 2 == r).groupBy(F.col("l_orderkey").alias("k")).agg(F.avg("l_tax").alias("s")) for r in (0, 1))
    return evaluate.paired(a, b, "k", "s")


@query("SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('42' || vec_id::varchar), vec_id) <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS train FROM embeddings")
def stratified_split(spark, folder):
    return evaluate.stratified_split(table(spark, folder, "embeddings"), F.col("vec_id"), "label").select("vec_id", "train")


@query(f"SELECT doc_id, {S.hash_uniform('doc_id', '42')} < 0.01 AS test FROM documents")
def hash_split(spark, folder):
    return evaluate.hash_split(table(spark, folder, "documents"), F.col("doc_id")).select("doc_id", "test")


@query("SELECT (row_number() OVER (ORDER BY text, doc_id) - 1)::int AS no, doc_id FROM (SELECT doc_id, text FROM documents ORDER BY md5('7' || doc_id::varchar), doc_id LIMIT 20)")
def seeded_sample(spark, folder):
    """A sample of twenty texts, ordered and numbered (sampling is the feature)."""
    from pyspark.sql import Window

    picked = evaluate.hash_sample(table(spark, folder, "documents").select("doc_id", "text"), F.col("doc_id"), 20, "7")
    return picked.select((F.row_number().over(Window.orderBy(F.asc_nulls_last("text"), "doc_id")) - 1).alias("no"), "doc_id")


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY month) - 1 AS position, count(*) OVER () AS n FROM (SELECT DISTINCT last_day(o_orderdate) AS month FROM orders)),
    f AS (SELECT unnest(range(3))::int AS fold) SELECT fold, position, CASE WHEN position < n - (3 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS part FROM p, f WHERE position < n - (3 - fold) * (n // 4) + n // 4""")
def expanding_folds(spark, folder):
    from pyspark.sql import Window

    months = table(spark, folder, "orders").select(F.last_day("o_orderdate").alias("month")).distinct()  # a calendar
    numbered = months.select((F.row_number().over(Window.orderBy("month")) - 1).cast("long").alias("position"))
    return evaluate.expanding_folds(numbered, "position")


@query()
def probe(spark, folder):
    """Held-out quality of a linear probe on embeddings (a trained model, so no SQL)."""
    split = evaluate.stratified_split(table(spark, folder, "embeddings"), F.col("vec_id"), "label")
    found = evaluate.centroid_probe(split, "vec_id", "embedding", "label", "train")
    return evaluate.f1(evaluate.confusion(found, F.col("label"), F.col("predicted"), list(range(10))))


@query()
def latent_components(spark, folder):
    """Scaled features on principal components (signs are arbitrary, so no SQL)."""
    wide = _years(spark, folder).groupBy("e").agg(*(F.coalesce(F.max(F.when(F.col("t") == t, F.col("v"))), F.lit(0.0)).alias(f"y{t}") for t in range(LAST - FIRST + 1)))
    return panel.similar_by_latent(wide, "e", [f"y{t}" for t in range(LAST - FIRST + 1)])


DRAWN = 200
_weights = f"(SELECT draw, e, x / sum(x) OVER (PARTITION BY draw) AS weight FROM (SELECT d.draw, e, -ln({S.hash_uniform('(d.draw || ' + chr(39) + ',' + chr(39) + ' || e)', '42')}) AS x FROM (SELECT unnest(range({DRAWN})) AS draw) d, (SELECT DISTINCT e FROM {_ret})))"


def _weighted(spark, folder):
    return portfolio.random_weights(_returns(spark, folder).select("e").distinct(), "e", DRAWN)


@query(f"SELECT draw, e, round(weight, 6) AS weight FROM {_weights}")
def random_portfolios(spark, folder):
    return _weighted(spark, folder).select("draw", "e", F.round("weight", 6).alias("weight"))


@query(f"""SELECT draw, round(avg(r) * 12, 5) AS ret, round(stddev_samp(r) * sqrt(12), 5) AS vol FROM (SELECT draw, month, sum(ret * weight) AS r FROM {_ret} JOIN {_weights} USING (e) GROUP BY 1, 2) GROUP BY 1""")
def portfolio_outcomes(spark, folder):
    return portfolio.outcomes(_weighted(spark, folder), _returns(spark, folder), "e", "month").select("draw", F.round("ret", 5).alias("ret"), F.round("vol", 5).alias("vol"))


@query(f"""WITH o AS (SELECT draw, avg(r) * 12 AS ret, stddev_samp(r) * sqrt(12) AS vol FROM (SELECT draw, month, sum(ret * weight) AS r FROM {_ret} JOIN {_weights} USING (e) GROUP BY 1, 2) GROUP BY 1)
    SELECT arg_min(draw, (round(vol, 9), draw)) AS min_vol_draw, arg_max(draw, (round(ret / vol, 9), -draw)) AS max_sharpe_draw FROM o""")
def frontier_choice(spark, folder):
    return portfolio.chosen(portfolio.outcomes(_weighted(spark, folder), _returns(spark, folder), "e", "month"))


# The reference's number of draws.
DRAWN_ALL = 10_000
_all_drawn = lambda name: ORACLES[name].replace(f"range({DRAWN})", f"range({DRAWN_ALL})")


def _weighted_all(spark, folder):
    return portfolio.random_weights(_returns(spark, folder).select("e").distinct(), "e", DRAWN_ALL)


@query(_all_drawn("random_portfolios"))
def random_portfolios_all(spark, folder):
    return _weighted_all(spark, folder).select("draw", "e", F.round("weight", 6).alias("weight"))


@query(_all_drawn("portfolio_outcomes"))
def portfolio_outcomes_all(spark, folder):
    return portfolio.outcomes(_weighted_all(spark, folder), _returns(spark, folder), "e", "month").select("draw", F.round("ret", 5).alias("ret"), F.round("vol", 5).alias("vol"))


@query(_all_drawn("frontier_choice"))
def frontier_choice_all(spark, folder):
    return portfolio.chosen(portfolio.outcomes(_weighted_all(spark, folder), _returns(spark, folder), "e", "month"))


@query()
def utility_weights(spark, folder):
    """Bounded mean-variance weights by projected gradients (iterative, so no SQL)."""
    best = portfolio.top_by_mean(_returns(spark, folder), "e", 18).select("e")
    return portfolio.utility_weights(_returns(spark, folder).join(best, "e", "left_semi"), "e", "month", 2.0, 0.1)


@query("""WITH g AS (SELECT ra, l2 FROM (VALUES (1.0), (2.0), (4.0)) a(ra), (VALUES (0.0), (0.1), (0.5)) b(l2)), s AS (SELECT ra, l2, avg(-abs(value - 10 * ra) - l2) AS mean_score FROM events, g GROUP BY 1, 2)
    SELECT ra::double AS ra, l2::double AS l2, round(mean_score, 6) AS mean_score FROM s ORDER BY round(mean_score, 9) DESC, ra, l2 LIMIT 1""")
def grid_choice(spark, folder):
    """Nine parameter pairs over all rows: the grid is literal, so its product with the rows stays nine rows each."""
    g = portfolio.grid(spark, ra=[1.0, 2.0, 4.0], l2=[0.0, 0.1, 0.5])
    scored = table(spark, folder, "events").crossJoin(F.broadcast(g))
    best = portfolio.best_parameters(scored, ["ra", "l2"], -F.abs(F.col("value") - 10 * F.col("ra")) - F.col("l2"))
    return best.select("ra", "l2", F.round("mean_score", 6).alias("mean_score"))
