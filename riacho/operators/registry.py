"""Securities and company registry: identifiers, ranked entries, fallback joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.operators import dedup

TICKER = r"^[A-Z0-9]{4}[0-9]{1,2}[A-Z]?$"
#: Class suffixes tried for a ticker without an entry, in order.
SUFFIXES = ("3", "4", "5", "6", "11")
#: Rank of a registration's status; others come last.
STATUS_RANK = {"ATIVO": 0, "FASE PRÉ": 1, "SUSPENSO(A)": 2, "CANCELADA": 3}
LAST_RANK = 9


def valid_ticker(c: Column) -> Column:
    return F.coalesce(c.rlike(TICKER), F.lit(False))


def securities(df: DataFrame, ticker: str, cnpj: str, *order: Column) -> DataFrame:
    """(ticker, cnpj) of valid tickers, the first entry of each in ``order``; identifiers as fourteen digits."""
    rows = df.filter(valid_ticker(F.col(ticker)))
    return dedup.first_wins(rows, [F.col(ticker)], *order).select(F.col(ticker).alias("ticker"), T.digits_padded(F.col(cnpj)).alias("cnpj"))


def best_entries(df: DataFrame, cnpj: str, status: str, date: str, *ties: Column) -> DataFrame:
    """One registry row per company: best status first, then the latest date."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_RANK.items() for x in kv)), F.upper(F.trim(F.col(status)))), F.lit(LAST_RANK))
    rows = df.withColumn("cnpj", T.digits_padded(F.col(cnpj))).withColumn("rank", rank)
    return dedup.first_wins(rows.filter("cnpj is not null"), [F.col("cnpj")], F.col("rank"), -F.coalesce(F.unix_date(F.col(date).try_cast("date")), F.lit(-1_000_000)), *ties)


def resolve(tickers: DataFrame, known: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(ticker, cnpj, provenance): direct hits, else the first sibling of the same base with another suffix.

    Provenance is ``direct``, ``base (<sibling>)``, or null where nothing matches. Only tickers without a direct hit are
    spread over the suffixes.
    """
    direct = tickers.join(known.select("ticker", "cnpj"), "ticker", "left")
    open_ = direct.filter("cnpj is null").select("ticker", F.posexplode(F.array(*map(F.lit, suffixes))).alias("pos", "suffix"))
    tried = open_.withColumn("sibling", F.concat(F.substring("ticker", 1, 4), F.col("suffix"))).filter("sibling != ticker")
    hits = tried.join(known.select(F.col("ticker").alias("sibling"), F.col("cnpj").alias("sib_cnpj")), "sibling").filter("sib_cnpj is not null")
    best = hits.groupBy("ticker").agg(F.min_by(F.struct("sibling", "sib_cnpj"), "pos").alias("s"))
    out = direct.join(best, "ticker", "left")
    provenance = F.when(F.col("cnpj").isNotNull(), "direct").when(F.col("s").isNotNull(), F.concat(F.lit("base ("), F.col("s.sibling"), F.lit(")")))
    return out.select("ticker", F.coalesce("cnpj", "s.sib_cnpj").alias("cnpj"), provenance.alias("provenance"))


def coverage(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("n_found"), F.round(F.avg(F.col(c).isNotNull().cast("int")), 6).alias("coverage"))
