"""Pieces of SQL shared by the queries' checks; they spell out what the column expressions of ``functions`` do."""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def canon(c: str) -> str:
    return f"replace(lower({strip(c)}), 'ß', 'ss')"


def collapse(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{WS}+', ' ', 'g')))"


def clean(c: str) -> str:
    from riacho.functions.text import CLEANERS

    out = f"regexp_replace({c}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')"
    for p in CLEANERS[:4]:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def md5_bucket(c: str, buckets: int) -> str:
    return f"(('0x' || substring(md5({c}), 1, 8))::ubigint % {buckets})::bigint"


def hash_uniform(key: str, seed: str = "") -> str:
    return f"((('0x' || substring(md5('{seed}' || {key}::varchar), 1, 8))::ubigint)::double + 0.5) / 4294967296.0"


def words(c: str, n: int) -> str:
    return f"list_slice(list_filter(string_split_regex(lower({c}), '{WS}+'), lambda x: x <> ''), 1, {n})"


def digits_padded(c: str, width: int = 14) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) < {width} THEN lpad({d}, {width}, '0') ELSE {d} END"


def chunks(table: str, size: int, overlap: int) -> str:
    """(doc_id, pos, chunk) of ``table`` (doc_id, t); a fold over paragraphs held in structs of one type."""
    step = size - overlap
    windows = f"list_transform(generate_series(1, greatest(1, length(y.p)), {step}), lambda i: substring(y.p, i, {size}))"
    blank = f"{strip('x.cur')} = ''"
    carried = f"CASE WHEN length(x.cur) > {overlap} THEN right(x.cur, {overlap}) || chr(10) || chr(10) || y.p ELSE y.p END"
    none = "[]::varchar[]"
    return f"""
    SELECT doc_id, unnest(generate_series(0, len(c) - 1))::int AS pos, unnest(c) AS chunk FROM (
      SELECT doc_id, CASE WHEN length(t) <= {size} THEN [t] ELSE list_concat(f.o, CASE WHEN {strip('f.cur')} = '' THEN {none} ELSE [{strip('f.cur')}] END) END AS c FROM (
        SELECT doc_id, t, list_reduce(list_prepend({{'cur': '', 'o': {none}, 'p': ''}},
          list_transform(list_filter(list_transform(string_split_regex(t, '\\n[\\t-\\r ]*\\n'), lambda z: {strip('z')}), lambda z: z <> ''), lambda z: {{'cur': '', 'o': {none}, 'p': z}})),
          lambda x, y: CASE
            WHEN length(y.p) > {size} THEN {{'cur': CASE WHEN {blank} THEN x.cur ELSE '' END, 'o': list_concat(list_concat(x.o, CASE WHEN {blank} THEN {none} ELSE [{strip('x.cur')}] END), {windows}), 'p': ''}}
            WHEN x.cur <> '' AND length(x.cur) + length(y.p) + 2 > {size} THEN {{'cur': {carried}, 'o': list_concat(x.o, [x.cur]), 'p': ''}}
            ELSE {{'cur': CASE WHEN x.cur = '' THEN y.p ELSE x.cur || chr(10) || chr(10) || y.p END, 'o': x.o, 'p': ''}} END) AS f
        FROM {table}))"""
