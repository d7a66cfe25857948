"""Rows that fail to parse: a minimum-cost error parse.

A record costs nothing if it is a sound delimited record of the wanted number of fields. Otherwise dynamic programming
over the characters finds the cheapest insertions and deletions of quotes and delimiters that make it one; which kind of
edit is needed is the reason for which the record is set apart. Zero-cost records are typed by Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX_COLUMNS = ("Link_Download", "CNPJ_Companhia", "Nome_Companhia", "Categoria", "Assunto", "Data_Referencia")

PARSED = T.StructType([
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("quote_cost", T.IntegerType()),
    T.StructField("field_cost", T.IntegerType()),
    T.StructField("edits", T.StringType()),
])

# Parser states: at a field's start, in a plain field, inside quotes, after a quote that may close or double.
START, PLAIN, INSIDE, CLOSING = range(4)


def _moves(state: int, ch: str, delimiter: str) -> tuple[int, int] | None:
    """(next state, fields closed) of an unedited character; None where the grammar forbids it."""
    if state == INSIDE:
        return (CLOSING, 0) if ch == '"' else (INSIDE, 0)
    if ch == delimiter:
        return (START, 1)
    if ch == '"':
        return {START: (INSIDE, 0), CLOSING: (INSIDE, 0)}.get(state)
    return None if state == CLOSING else (PLAIN, 0)


def error_parse(record: str, n_fields: int, delimiter: str = ";", quotes_only: bool = False) -> tuple[int, list[tuple[str, int]]]:
    """Cost and edits of the cheapest parse of ``record``.

    Edits are ("insert quote" | "delete quote" | "insert delimiter" | "delete delimiter", position); each costs 1. With
    ``quotes_only`` any number of fields is accepted and delimiters are not edited. States are (parser state, fields
    closed); runs without quote or delimiter are one step, so the work is linear in the record. Of equal costs, the
    later insertion wins.
    """
    last = 0 if quotes_only else n_fields - 1
    best: dict[tuple[int, int], tuple[int, tuple]] = {}

    def offer(into: dict, state: int, closed: int, cost: int, path: tuple, tie: bool = False) -> bool:
        key = (state, 0 if quotes_only else closed)
        if key[1] > last or key in into and into[key][0] < cost + (not tie):
            return False
        into[key] = (cost, path)
        return True

    def insertions(states: dict, at: int) -> None:
        todo = list(states)
        while todo:
            s, k = todo.pop()
            c, p = states[s, k]
            if s != PLAIN and offer(states, CLOSING if s == INSIDE else INSIDE, k, c + 1, (p, ("insert quote", at)), True):
                todo.append((CLOSING if s == INSIDE else INSIDE, k))
            if s != INSIDE and not quotes_only and offer(states, START, k + 1, c + 1, (p, ("insert delimiter", at)), True):
                todo.append((START, k + 1))

    offer(best, START, 0, 0, ())
    for at, token in _tokens(record, delimiter):
        insertions(best, at)
        after: dict[tuple[int, int], tuple[int, tuple]] = {}
        for (s, k), (c, p) in best.items():
            move = _moves(s, token[0], delimiter)
            if move is not None:
                offer(after, move[0], k + move[1], c, p)
            if token == '"' or token == delimiter and not quotes_only:
                offer(after, s, k, c + 1, (p, ("delete quote" if token == '"' else "delete delimiter", at)))
        best = after
    insertions(best, len(record))
    cost, path = min((v for (s, k), v in best.items() if s != INSIDE and k == last), key=lambda v: v[0])
    edits: list[tuple[str, int]] = []
    while path:
        path, edit = path
        edits.append(edit)
    return cost, edits[::-1]


def _tokens(record: str, delimiter: str) -> Iterator[tuple[int, str]]:
    """Quotes, delimiters and whole runs of other characters (a run acts as one character), with positions."""
    for m in re.finditer(rf'"|{re.escape(delimiter)}|[^"{re.escape(delimiter)}]+', record):
        yield m.start(), m.group()


def split_sound(record: str, delimiter: str = ";") -> list[str] | None:
    """Fields of a record whose quoting is sound, else None: the zero-cost path of the parse, which has no choices."""
    d = re.escape(delimiter)
    field = re.compile(rf'"((?:[^"]++|"")*+)"(?={d}|\Z)|([^"{d}]*+)(?={d}|\Z)')
    out, at = [], 0
    while True:
        m = field.match(record, at)
        if m is None:
            return None
        out.append(m.group(1).replace('""', '"') if m.group(1) is not None else m.group(2))
        at = m.end()
        if at == len(record):
            return out
        at += len(delimiter)


def _parse_one(record: str | None, n_fields: int, delimiter: str) -> tuple:
    if record is None:
        return None, 0, n_fields - 1, None
    fields = split_sound(record, delimiter)
    if fields is not None and len(fields) == n_fields:
        return fields, 0, 0, ""
    quote_cost = 0 if fields is not None else error_parse(record, n_fields, delimiter, quotes_only=True)[0]
    cost, edits = error_parse(record, n_fields, delimiter)
    return fields, quote_cost, cost, "; ".join(f"{what} at {at}" for what, at in edits)


def parse_records(record: Column, n_fields: int = len(INDEX_COLUMNS), delimiter: str = ";") -> Column:
    """struct(fields, quote_cost, field_cost, edits) of each record; Arrow batches, one pass."""

    @F.pandas_udf(PARSED)
    def parse(records: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [_parse_one(r if isinstance(r, str) else None, n_fields, delimiter) for r in records],
            columns=[f.name for f in PARSED],
        )

    return parse.asNondeterministic()(record)  # else a filter on the result would parse twice


def blank_trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\p{Z}\s]+|[\p{Z}\s]+$", "")


def valid_link(c: Column) -> Column:
    """An http or https address with a dotted host and no blank inside."""
    return c.rlike(r"^(?i:https?)://[^\p{Z}\s/?#.][^\p{Z}\s/?#]*\.[^\p{Z}\s/?#.][^\p{Z}\s/?#]*([/?#][^\p{Z}\s]*)?$")


def cnpj_number(c: Column) -> Column:
    """The fourteen digits of an identifier, plain or punctuated in the usual way, as a number; null for any other text."""
    shaped = c.rlike(r"^([0-9]{14}|[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2})$")
    return F.when(shaped, F.translate(c, "./-", "").try_cast("long"))


def right_digits(number: Column) -> Column:
    """Whether both check digits of an identifier's number are right (modulus 11). Plain arithmetic on one long column."""

    def check(n: int) -> Column:
        total = sum((F.pmod(F.call_function("div", number, F.lit(10 ** (13 - i))), F.lit(10)) * ((n - 1 - i) % 8 + 2) for i in range(n)), F.lit(0))
        # 11 less the rest, where 10 and 11 stand for 0
        return F.pmod(F.pmod(-total, F.lit(11)), F.lit(10)) == F.pmod(F.call_function("div", number, F.lit(10 ** (13 - n))), F.lit(10))

    return check(12) & check(13)


def valid_cnpj(c: Column) -> Column:
    """Fourteen digits, plain or punctuated in the usual way, with right check digits."""
    return F.coalesce(right_digits(cnpj_number(c)), F.lit(False))


def index_date(c: Column) -> Column:
    """The calendar day of ``yyyy-mm-dd`` or ``dd/mm/yyyy``; null for anything else."""
    iso = F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), c)
    day = F.when(c.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.concat_ws("-", F.substring(c, 7, 4), F.substring(c, 4, 2), F.substring(c, 1, 2)))
    return F.try_to_date(F.coalesce(iso, day), "yyyy-MM-dd")


def is_header(record: Column, columns: tuple[str, ...] = INDEX_COLUMNS, delimiter: str = ";") -> Column:
    """A header line: the column names, case, blanks, quotes and a byte order mark ignored."""
    plain = F.lower(F.regexp_replace(record, r"[\"\p{Z}\p{C}\s]", ""))
    return F.coalesce(plain == delimiter.join(columns).lower(), F.lit(False))


def with_sound_fields(df: DataFrame, record: str, columns: tuple[str, ...], delimiter: str = ";") -> DataFrame:
    """Adds ``_sound`` (whether the parse takes the record at no cost) and its fields as ``_f0``, ``_f1`` ..., all in the JVM.

    A record without quotes is cut at its delimiters. One with quotes is cut by one pattern, field by field, once it is
    known to be made of such fields only. The columns are projected step by step, so none is computed twice.
    """
    d, n = re.escape(delimiter), len(columns)
    field = rf'"(?:[^"]++|"")*+"|[^"{d}]*+'
    quoted = F.col(record).contains('"')
    cut = F.when(quoted, F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(f"{d}({field})"), 1)).otherwise(F.split(record, d))
    shaped = F.when(quoted, F.col(record).rlike(f"^(?:{field})(?:{d}(?:{field})){{{n - 1}}}\\z")).otherwise(F.size("_cut") == n)
    out = df.withColumn("_cut", cut).withColumn("_sound", F.coalesce(shaped, F.lit(False)))
    raw = out.select("*", *(F.when(F.col("_sound"), F.get("_cut", F.lit(i))).alias(f"_r{i}") for i in range(n)))
    inner = lambda c: F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    unquoted = (F.when(F.col(f"_r{i}").startswith('"'), inner(F.col(f"_r{i}"))).otherwise(F.col(f"_r{i}")).alias(f"_f{i}") for i in range(n))
    return raw.select(*df.columns, "_sound", *unquoted)


def triage(df: DataFrame, record: str = "raw_record", columns: tuple[str, ...] = INDEX_COLUMNS, delimiter: str = ";") -> DataFrame:
    """``df`` without header lines, with ``_f0`` ... (fields), ``_edits``, ``_day`` and ``_reason`` (null for records that load).

    Records that the parse takes at no cost are recognised, cut and typed by JVM expressions; the dynamic programme sees
    the others alone. Reasons, the first that holds: ``quoting``, ``columns``, ``value``. A null record has no fields:
    ``columns``; so has an empty one. Extra columns pass through; ones of these names are replaced.
    """
    own = ["_sound", "_reason", "_edits", "_day", "_cut", "_link", "_number", "_parsed", *(f"{x}{i}" for x in ("_r", "_f") for i in range(len(columns)))]
    rows = df.drop(*own).filter(~is_header(F.col(record), columns, delimiter))
    rows = with_sound_fields(rows, record, columns, delimiter)
    trimmed = {name: blank_trim(F.col(f"_f{columns.index(name)}")) for name in ("Link_Download", "CNPJ_Companhia", "Data_Referencia")}
    rows = rows.withColumns({"_link": trimmed["Link_Download"], "_number": trimmed["CNPJ_Companhia"], "_day": trimmed["Data_Referencia"]})
    rows = rows.withColumns({"_link": valid_link(F.col("_link")), "_number": cnpj_number(F.col("_number")), "_day": index_date(F.col("_day"))})
    rows = rows.withColumn("_parsed", parse_records(F.when(~F.col("_sound"), F.col(record)), len(columns), delimiter))
    broken = F.when(F.col("_parsed.quote_cost") > 0, "quoting").otherwise("columns")
    typed = F.col("_link") & right_digits(F.col("_number")) & F.col("_day").isNotNull()
    reason = F.when(~F.col("_sound"), broken).when(~F.coalesce(typed, F.lit(False)), "value")
    edits = F.when(~F.col("_sound"), F.col("_parsed.edits")).otherwise(F.lit(""))
    return rows.withColumns({"_reason": reason, "_edits": edits}).drop("_parsed", "_link", "_number", "_sound")


def load_index(df: DataFrame, record_id: str = "record_id", record: str = "raw_record") -> DataFrame:
    """Sound records as rows of the filing index: the id, the six fields and the reference date as a date."""
    good = triage(df, record).filter(F.col("_reason").isNull())
    fields = [F.col(f"_f{i}").alias(n.lower()) for i, n in enumerate(INDEX_COLUMNS)]
    return good.select(record_id, *fields, F.col("_day").alias("ref_date"))


def rejected(df: DataFrame, record_id: str = "record_id", record: str = "raw_record") -> DataFrame:
    """(id, reason, edits): unsound records apart, with the edits that would mend quoting and field count."""
    bad = triage(df, record).filter(F.col("_reason").isNotNull())
    return bad.select(record_id, F.col("_reason").alias("reason"), F.col("_edits").alias("edits"))
