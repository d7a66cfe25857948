"""Text expressions: cleaning, keys, paragraph-aware chunks, estimates. All are JVM-side column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python understands it, which is more than a plain regular expression's.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def canon(c: Column) -> Column:
    """Comparison key of a text: stripped, lower case, sharp s folded."""
    return F.replace(F.lower(strip(c)), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    """Stripped, runs of white space as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, rf"{WS}+", " ")))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


# What cleaning removes, in order: page headers, registration lines, captions of names with a registration, disclaimers
# up to the next blank line, control characters.
CLEANERS = (
    r"(?im)^[ \t]*(folha[ \t]+[0-9]+[ \t]*/[ \t]*[0-9]+|p[aá]gina[ \t]+[0-9]+[ \t]+de[ \t]+[0-9]+|page[ \t]+[0-9]+[ \t]+of[ \t]+[0-9]+)[ \t]*$",
    r"(?im)^[ \t]*cnpj[^\n]*[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}[^\n]*$",
    r"(?m)^[A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9 .&/-]{5,}[ \t]+[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}[ \t]*$",
    r"(?is)(aviso legal|disclaimer)[ \t]*:.*?(\n[ \t]*\n|\z)",
    r"[\x00-\x08\x0b\x0c\x0e-\x1f]",
)


def clean(c: Column) -> Column:
    """Text without page headers, registration lines, disclaimers and control characters; at most one blank line in a row."""
    c = F.regexp_replace(c, CLEANERS[4], "")
    for p in CLEANERS[:4]:
        c = F.regexp_replace(c, p.replace("(?im)", "(?imd)").replace("(?m)", "(?md)"), "")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def windows(c: Column, size: int, step: int) -> Column:
    """Substrings of ``size`` characters that begin every ``step`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c)), F.lit(step))
    return F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))


def chunks(c: Column, size: int = 8192, overlap: int = 200) -> Column:
    """Chunks of a text of about ``size`` characters, packed from paragraphs.

    A text that fits is one chunk. Paragraphs (blank lines part them) are packed while they fit; a full chunk hands its last
    ``overlap`` characters on. A paragraph beyond ``size`` is cut into windows that overlap. With the overlap a chunk may
    reach ``size + overlap + 2`` characters.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("cur"), empty.alias("out"))

    def state(cur: Column, out: Column) -> Column:
        return F.struct(cur.alias("cur"), out.alias("out"))

    def add(acc: Column, p: Column) -> Column:
        cur, out = acc["cur"], acc["out"]
        blank = ~cur.rlike(WS.replace("[", "[^", 1))
        carried = F.concat(F.right(cur, F.lit(overlap)), F.lit("\n\n"), p) if overlap else p
        handed = F.when(F.length(cur) > overlap, carried).otherwise(p)
        return (
            F.when(F.length(p) > size, state(F.when(blank, cur).otherwise(F.lit("")), F.concat(out, F.when(blank, empty).otherwise(F.array(strip(cur))), windows(p, size, size - overlap))))
            .when((cur != "") & (F.length(cur) + F.length(p) + 2 > size), state(handed, F.concat(out, F.array(cur))))
            .otherwise(state(F.when(cur == "", p).otherwise(F.concat(cur, F.lit("\n\n"), p)), out))
        )

    def end(acc: Column) -> Column:
        return F.when(strip(acc["cur"]) == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(strip(acc["cur"]))))

    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")  # stripped once, not at each use
    packed = F.aggregate(paragraphs, start, add, end)
    return F.when(F.length(c) <= size, F.array(c)).otherwise(packed)


def token_estimate(c: Column, cap: int | None = None) -> Column:
    """A token for four characters, at least one; ``cap`` bounds it."""
    n = F.floor(F.length(c) / 4)
    return F.greatest(F.lit(1).cast("long"), F.least(n, F.lit(cap).cast("long")) if cap else n)


def digits_padded(c: Column, width: int = 14) -> Column:
    """Digits of an identifier, zeros in front up to ``width``; longer ones are kept whole."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) < width, F.lpad(d, width, "0")).otherwise(d)


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def composite_key(*columns: Column) -> Column:
    """Trimmed columns joined by ``|``; nulls are empty."""
    return F.concat_ws("|", *(F.trim(F.coalesce(c, F.lit(""))) for c in columns))


def safe_name(cnpj: Column, date: Column, subject: Column) -> Column:
    """File name of a filing: signs other than letters, digits, dot, dash and underscore become ``_``."""
    raw = F.concat_ws("_", F.coalesce(cnpj, F.lit("")), F.coalesce(date, F.lit("")), F.substring(F.coalesce(subject, F.lit("")), 1, 50))
    return F.concat(F.regexp_replace(raw, r"[^\p{L}\p{N}._-]", "_"), F.lit(".pdf"))


def strip_tags(c: Column) -> Column:
    """Text of marked-up paragraphs: paragraph ends become blank lines, tags go, entities for signs are read."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?i)</(w:)?p>", "\n\n"), r"<[^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return strip(text)


def clean_answer(c: Column) -> Column:
    """Answer of a language model without its thoughts: tagged thoughts, what precedes a stray end tag, what follows a
    blank line or a repeated question, and a lone quote at the end."""
    c = F.regexp_replace(c, r"(?is)<think>.*?</think>", "")
    c = F.substring_index(c, "</think>", -1)
    c = strip(F.regexp_replace(c, r"(?is)<think>.*\z", ""))
    c = F.split(c, r"\n[ \t]*\n|Question:", 2)[0]
    c = strip(c)
    lone = (F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))) == 1
    return F.when(lone & c.endswith('"'), strip(F.regexp_replace(c, '"$', ""))).otherwise(c)


def residue(output: Column, source: Column, n: int = 30) -> Column:
    """Whether an output still holds thought marks, or the first characters of its source."""
    return F.lower(output).contains("<think") | F.lower(output).contains("</think") | output.contains(F.substring(source, 1, n))


def tagged_answer(c: Column, tag: str = "answer") -> Column:
    """What stands between a tag's begin and end; null without the tag."""
    return F.when(c.contains(f"<{tag}>"), strip(F.split_part(F.split_part(c, F.lit(f"<{tag}>"), F.lit(2)), F.lit(f"</{tag}>"), F.lit(1))))


def human_bytes(c: Column) -> Column:
    """Size in B, KB, MB, GB or TB with one decimal."""
    out = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        value = F.format_string("%.1f " + unit, F.round(c / F.lit(1024.0**power), 1))
        out = F.when((c >= 1024**power) & ((c < 1024 ** (power + 1)) | F.lit(power == 4)), value).otherwise(out)
    return F.when(c < 1, F.format_string("%.1f B", c.cast("double"))).otherwise(out)


def parse_count(text: str) -> int:
    """``250M`` -> 250000000; suffixes K, M and B, case ignored. Raises ValueError unless the result is positive."""
    m = re.fullmatch(r"\s*([0-9][0-9_]*(?:\.[0-9]+)?)\s*([kmb]?)\s*", text, re.I)
    value = int(float(m[1].replace("_", "")) * {"": 1, "k": 10**3, "m": 10**6, "b": 10**9}[m[2].lower()]) if m else 0
    if value <= 0:
        raise ValueError(f"no positive count: {text!r}")
    return value


def label_count(n: int) -> str:
    """250000000 -> ``250M``."""
    for size, unit in ((10**9, "B"), (10**6, "M")):
        if n >= size:
            return f"{n / size:g}{unit}"
    return str(n)


def year_range(text: str, first: int = 2003, last: int = 2026) -> list[int]:
    """``all`` -> every year; ``a-b`` -> inclusive; one year -> itself; anything else -> every year."""
    every = list(range(first, last + 1))
    if m := re.fullmatch(r"\s*(\d{4})\s*-\s*(\d{4})\s*", text):
        return list(range(int(m[1]), int(m[2]) + 1)) or every
    return [int(text)] if re.fullmatch(r"\s*\d{4}\s*", text) else every


def hash_uniform(key: Column, seed: str = "") -> Column:
    """Uniform number in (0, 1) from the md5 of seed and key: the same everywhere, no generator state."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / 4294967296.0


def md5_bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("long")


def crc_bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(c), F.lit(buckets)).cast("long")
