"""Financial statement lines: periods, account names, pivots, annual fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.operators import dedup

LATEST = ("ÚLTIMO", "ULTIMO")


def periods(date: Column) -> tuple[Column, Column, Column, Column]:
    """(year, month, quarter, period) of a date; months that end no quarter have neither quarter nor period."""
    year, month = F.year(date), F.month(date)
    quarter = F.when(month % 3 == 0, F.concat(F.lit("Q"), F.floor(month / 3).cast("string")))
    return year, month, quarter, F.concat(year.cast("string"), F.lit("-"), quarter)


def parsed_lines(df: DataFrame) -> DataFrame:
    """Lines of the latest exercise with readable dates, digits-only company, numeric value and period."""
    rows = df.filter(F.upper(F.trim("ordem_exerc")).isin(*LATEST))
    rows = rows.withColumn("date", F.try_to_date(F.trim("dt_refer"), "yyyy-MM-dd")).filter("date is not null")
    year, month, quarter, period = periods(F.col("date"))
    return rows.select(
        "line_id", T.digits_padded(F.col("cnpj_cia")).alias("cnpj"), F.col("denom_cia").alias("name"), "date", year.alias("year"), month.alias("month"), quarter.alias("quarter"), period.alias("period"),
        F.col("cd_conta").alias("account"), F.trim("vl_conta").try_cast("double").alias("value"), F.col("table_code").alias("table_code"), "received_at",
    )


def account_names(lines: DataFrame, names: dict[str, str], longest: bool = True) -> DataFrame:
    """Lines with the name of the account they belong to: the code itself or one it lies under.

    ``longest`` takes the most specific account; otherwise the first of ``names`` that matches wins. Others go.
    """
    rows = [(i, k, v) for i, (k, v) in enumerate(names.items())]
    table = lines.sparkSession.createDataFrame(rows, "no int, prefix string, account_name string")
    code = F.col("account")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(code, r"\."))), lambda i: F.array_join(F.slice(F.split(code, r"\."), F.lit(1), i), "."))
    spread = lines.filter(code.isNotNull()).withColumn("prefix", F.explode(prefixes))
    hits = spread.join(F.broadcast(table), "prefix")  # a literal table
    order = [-F.length("prefix")] if longest else [F.col("no")]
    return dedup.first_wins(hits, [F.col("line_id")], *order).drop("prefix", "no")


def pivoted(lines: DataFrame, keys: list[str], names: list[str], order: list[Column]) -> DataFrame:
    """One row per keys, a column per account name with the first non-null value in ``order``; null keys go."""
    rows = lines.dropna(subset=keys)
    position = F.struct(*order)
    return rows.groupBy(*keys).agg(*(F.min_by(F.when(F.col("account_name") == n, F.col("value")), F.when((F.col("account_name") == n) & F.col("value").isNotNull(), position)).alias(n) for n in names))


def merged(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on the keys."""
    return a.join(b, keys, "full_outer")


def with_annual(quarterly: DataFrame, annual: DataFrame, company: str) -> DataFrame:
    """Quarterly rows, and annual ones of the companies that have no quarterly row at all."""
    missing = annual.join(quarterly.select(company).distinct(), company, "left_anti")
    return quarterly.unionByName(missing, allowMissingColumns=True)


def restricted(df: DataFrame, company: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of wanted companies, wanted companies that were not found)."""
    return df.join(wanted, company, "left_semi"), wanted.join(df.select(company).distinct(), company, "left_anti")


def span(df: DataFrame, company: str, period: str) -> DataFrame:
    return df.agg(F.count_distinct(company).alias("n_companies"), F.count_distinct(period).alias("n_periods"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def latest_received(lines: DataFrame) -> DataFrame:
    """The last delivery of each company, date, table and account."""
    return dedup.last_wins(lines, [F.col(c) for c in ("cnpj", "date", "table_code", "account")], F.col("received_at"), F.col("line_id"))


def total_over(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``df`` with the total of ``value`` over the rows of equal keys."""
    return df.withColumn(f"{value}_total", F.sum(value).over(Window.partitionBy(*keys)))
