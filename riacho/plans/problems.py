"""Queries of the general data problem (p1)."""

from __future__ import annotations

from riacho.operators import error_parse
from riacho.sources.tables import table


def p1_found(spark, folder):
    return error_parse.rejected(table(spark, folder, "ipe_raw")).select("record_id", "reason")


def p1_edits(spark, folder):
    return error_parse.rejected(table(spark, folder, "ipe_raw"))


def p1_loaded(spark, folder):
    return error_parse.load_index(table(spark, folder, "ipe_raw"))


# Sound quoting as one pattern; the six fields of a sound record; blanks around a value ignored.
_field = """("([^"]|"")*"|[^";]*)"""
_sound = f"regexp_full_match(raw_record, '{_field}(;{_field})*')"
_parts = "^" + ";".join(["""("(?:[^"]|"")*"|[^";]*)"""] * 6) + "$"
_blank = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def _plain(i: int) -> str:
    raw = f"regexp_extract(raw_record, '{_parts}', {i})"
    return f"CASE WHEN starts_with({raw}, '\"') THEN replace(substring({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END"


def _value(i: int) -> str:
    return f"regexp_replace({_plain(i)}, '^{_blank}+|{_blank}+$', '', 'g')"


def _check_digit(n: int) -> str:
    total = " + ".join(f"substring(d, {i + 1}, 1)::int * {(n - 1 - i) % 8 + 2}" for i in range(n))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END) = substring(d, {n + 1}, 1)::int"


_TRIAGED = f"""WITH r AS (SELECT record_id, raw_record, coalesce({_sound}, true) AS sound, coalesce(length(regexp_replace(raw_record, '"([^"]|"")*"', '', 'g')) - length(replace(regexp_replace(raw_record, '"([^"]|"")*"', '', 'g'), ';', '')) + 1, 0) AS n
    FROM ipe_raw WHERE coalesce(lower(regexp_replace(raw_record, '["\\p{{Z}}\\p{{C}}\\s]', '', 'g')) <> 'link_download;cnpj_companhia;nome_companhia;categoria;assunto;data_referencia', true)),
    v AS (SELECT *, {_value(1)} AS link, {_value(2)} AS c, {_value(6)} AS dt FROM r), w AS (SELECT *, regexp_replace(c, '[^0-9]', '', 'g') AS d,
      regexp_matches(c, '^([0-9]{{14}}|[0-9]{{2}}\\.[0-9]{{3}}\\.[0-9]{{3}}/[0-9]{{4}}-[0-9]{{2}})$') AS shaped,
      regexp_matches(link, '^(?i:https?)://[^\\p{{Z}}\\s/?#.][^\\p{{Z}}\\s/?#]*\\.[^\\p{{Z}}\\s/?#.][^\\p{{Z}}\\s/?#]*([/?#][^\\p{{Z}}\\s]*)?$') AS linked,
      CASE WHEN regexp_matches(dt, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(dt AS date) WHEN regexp_matches(dt, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN try_cast(substring(dt, 7, 4) || '-' || substring(dt, 4, 2) || '-' || substring(dt, 1, 2) AS date) END AS day FROM v),
    x AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN n <> 6 THEN 'columns' WHEN NOT linked OR NOT shaped OR day IS NULL THEN 'value' WHEN NOT ({_check_digit(12)} AND {_check_digit(13)}) THEN 'value' END AS reason FROM w)"""
_P1 = f"{_TRIAGED} SELECT record_id, reason FROM x WHERE reason IS NOT NULL"
_FIELDS = ", ".join(f"{_plain(i)} AS {name.lower()}" for i, name in enumerate(error_parse.INDEX_COLUMNS, 1))
_P1_LOADED = f"{_TRIAGED} SELECT record_id, {_FIELDS}, day AS ref_date FROM x WHERE reason IS NULL"

QUERIES = {"p1_found": p1_found, "p1_edits": p1_edits, "p1_loaded": p1_loaded}
ORACLES: dict[str, str] = {"p1_found": _P1, "p1_loaded": _P1_LOADED}
