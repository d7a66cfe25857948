"""Text decoded with the wrong character encoding: found and, where possible, restored.

Stretches with implausible characters are nodes of a graph whose edges encode, decode or unescape. A best-first search
with hashed visited states walks from the stretch to the cheapest text it can reach; the cost measures how implausible
the characters are beside their neighbours. A stretch counts as garbled if a clearly cheaper text is reachable through a
change of encoding, or if it holds replacement characters, whose original is lost.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings by which bytes are read wrongly.
CODECS = ("cp1252", "cp850", "cp437", "cp1251", "cp1250", "mac_roman", "iso8859_15")
#: Single-byte encodings in which such bytes were meant; the first is that of most texts.
MEANT = ("cp1252", "cp1250")
#: Ones of other scripts: only a word without any ASCII letter can have been meant in them.
FOREIGN = ("cp1251", "cp1253")
#: Letters such a word has at least.
FOREIGN_LETTERS = 4
#: What the cost must fall by for a stretch to count.
MARGIN = 1.0
#: Cost of a step, and of one between single-byte encodings.
STEP, BYTE_STEP = 0.3, 0.5
#: Cost of an escape that stands for a character beyond ASCII, and of a character that no sound text is left with.
ESCAPED, UNSOUND = 2.0, 1.3

REPLACEMENT = "�"
_SYMBOLS = frozenset("¡¢£¤¥¦§¨©«¬¯°±²³´¶·¸¹»¼½¾¿×÷ƒ†‡•…‰‹›€™‚„“”‘’–—˜ˆ√≠≤≥∞∂∑∏π∫Ω≈∆◊⁄ﬂµ®ªº◊ı˘˙˚˝˛ˇŒœŠšŽžŸ")
_LETTERLIKE = frozenset("ªº")
_TAIL = frozenset("®™²³ªº¬…”’»—–°©…")
_RARE = {"ñ": 0.1, "þ": 1.6, "Þ": 2, "ð": 1.2, "Ð": 1.2, "ƒ": 3, "ı": 2, "Ý": 1.2, "ý": 1.0, "š": 0.6, "ž": 0.6, "Š": 0.6, "Ž": 0.6, "Ÿ": 1.2, "ÿ": 1.2}
#: Letters beyond ASCII of Portuguese and Spanish; others cost a little.
_USUAL = frozenset("áàâãéêíóôõúüçñÁÀÂÃÉÊÍÓÔÕÚÜÇÑ")

#: Signs that may stand before a letter, and that may follow anything.
_OPEN, _CLOSE = frozenset("¡¿«“‘£€°§•–—©±"), frozenset("¬…”’»—–")


_ESCAPE = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8}[0-9]{0,2});|\\u[0-9a-fA-F]{4}")


def _unescaped(m: re.Match) -> str:
    """The character of an escape, if it is one letter or sign beyond ASCII; else the escape itself."""
    out = chr(int(m.group()[2:], 16)) if m.group()[0] == "\\" else html.unescape(m.group())
    return m.group() if out.isascii() or len(out) > 1 or 0xD800 <= ord(out) < 0xE000 else out


def _suspect() -> str:
    """A pattern (of the JVM) that every text with a stretch of cost 1 or more matches; what it refuses cannot be changed.

    Each alternative is a branch of ``cost``, looked for at characters beyond ASCII that are no usual small letter. Letters
    that cost little have to meet another one in the same stretch.
    """
    some = lambda chars: "[" + "".join(sorted(chars)) + "]"
    near, far = r"[^\x00-@\[-`{-\x7f]", r"[^\x00-\x7f]"  # letters and all beyond ASCII; beyond ASCII
    latin = r"\u00c0-\u024f\u1e00-\u1eff\ufb00-\ufb06"
    foreign = rf"[\p{{L}}&&[^A-Za-zªº{latin}]]"
    signs, usual = _SYMBOLS - set(_RARE), "".join(sorted(_USUAL - {"ñ"}))
    odd = f"[{latin}&&[^{usual}]]"
    parts = [
        r"[\ufffd\u0080-\u009f\u2500-\u259fþÞðÐƒıÝýŸÿß]",
        f"(?<={near}){some(signs)}(?={near})",
        f"(?<={near}){some(signs - _TAIL)}",
        f"(?<={far}){some(_TAIL - _CLOSE)}",
        f"{some(signs - _OPEN - _LETTERLIKE)}(?={near})",
        f"{some(_LETTERLIKE)}(?={far})",
        r"(?<=[^\x00-/:-\x7f])¬",
        r"(?<=[ÃÂ])[\xad\xa0]",
        r"(?<=[\p{Ll}\p{Lm}ªº])\p{Lu}",
        rf"(?<=\p{{N}}|[A-Za-zªº{latin}]){foreign}",
        f"{foreign}(?=[A-Za-zªº{latin}])",
        *(x for own in (r"\u0370-\u03ff", r"\u0400-\u052f") for x in (rf"(?<=[\p{{L}}&&[^{own}]])[{own}]", rf"[{own}](?=[\p{{L}}&&[^{own}]])")),
        rf"{odd}(?=[^\x00-\x20]*{odd})",
    ]
    usual_small = "".join(sorted(c for c in _USUAL - {"ñ"} if c.islower()))
    return rf"(?=[^\x00-\x7f{usual_small}])(?:{'|'.join(parts)})|{_ESCAPE.pattern}"


SUSPECT = _suspect()


def _script(c: str) -> str:
    o = ord(c)
    if c.isascii() or 0xC0 <= o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFB00 <= o < 0xFB07:
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    return "other"


@lru_cache(100_000)
def cost(text: str) -> float:
    """How implausible the characters of ``text`` are beside their neighbours; 0 for sound text."""
    return sum(_costs(text))


@lru_cache(100_000)
def sound(text: str) -> bool:
    """Whether no character is implausible by itself; letters that are only rare here do not count."""
    return all(x < UNSOUND for x in _costs(text))


def _costs(text: str) -> Iterator[float]:
    """Cost of each character beyond ASCII and of each escape."""
    if "&" in text or "\\u" in text:
        yield sum(ESCAPED for m in _ESCAPE.finditer(text) if _unescaped(m) != m.group())
    for i, c in enumerate(text):
        if c.isascii():
            continue
        total = 0.0
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
        o = ord(c)
        if c == REPLACEMENT:
            total += 6
        elif 0x80 <= o < 0xA0:
            total += 5
        elif 0x2500 <= o < 0x25A0:
            total += 4 if before.isalnum() or after.isalnum() else 0
        elif c in _SYMBOLS and c not in _RARE:
            left, right = before.isalpha() or not before.isascii(), after.isalpha() or not after.isascii()
            if c in _LETTERLIKE:
                total += 0 if not before.isalpha() or before.isascii() and not after.isalpha() else 2
            elif left and right:
                total += 0.7 if c in "–—…’”»" else 3
            elif left and not (c in _TAIL and (before.isascii() or c in _CLOSE)) or right and c not in _OPEN:
                total += 2.5
            elif c == "¬" and before.isdigit():
                total += 2
        elif c.isalpha():
            total += _RARE.get(c, 0 if c in _USUAL or _script(c) != "latin" else 0.3)
            if c == "ß":  # after a vowel it may be German
                total += 0.8 if before in "aeiouäöüAEIOU" else 1.6
            if c.isupper() and before.islower():
                total += 2.5
            own = _script(c)
            for other in (before, after):
                if other.isalpha() and own != _script(other) and not unicodedata.category(c).startswith("M"):
                    total += 2.5
            if own != "latin" and before.isdigit():
                total += 2.5
        elif c == "\xad" and before in "ÃÂ":
            total += 2
        elif c == "\xa0" and before in "ÃÂ":
            total += 2
        yield total


@lru_cache(None)
def _table(codec: str) -> dict[str, int]:
    """Character -> byte; bytes that cp1252 leaves undefined stand for the control of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _as_utf8(text: str, codec: str) -> str:
    """``text`` with every well-formed sequence of its bytes in ``codec`` read as UTF-8; the rest stays."""
    table = _table(codec)
    raw = bytes(table.get(c, 0x20) for c in text)  # 0x20: breaks sequences
    out, at = [], 0
    for m in _UTF8.finditer(raw):
        try:
            char = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += (text[at : m.start()], char)
        at = m.end()
    return "".join(out) + text[at:]


def _as_bytes(text: str, codec: str, meant: str) -> str:
    """``text`` whose characters beyond ASCII are the bytes of ``codec`` read as ``meant``; unmapped ones stay."""
    table = _table(codec)
    return "".join(bytes([table[c]]).decode(meant, "replace") if c in table else c for c in text)


def _neighbours(text: str) -> Iterator[tuple[str, str]]:
    for codec in CODECS:
        yield f"{codec}>utf-8", _as_utf8(text, codec)
        for meant in MEANT:
            if codec not in (meant, "iso8859_15"):
                yield f"{codec}>{meant}", _as_bytes(text, codec, meant)
    letters = [c for c in text if c.isalpha()]
    if len(letters) >= FOREIGN_LETTERS and not any(c.isascii() for c in letters):
        for meant in FOREIGN:
            yield f"cp1252>{meant}", _as_bytes(text, "cp1252", meant)
    if "&" in text or "\\u" in text:
        yield "unescape", _ESCAPE.sub(_unescaped, text)


def _goes_on(text: str, other: str) -> bool:
    """Whether a step may be taken: it shortens the text, makes it cheaper or opens a sequence of UTF-8.

    Such steps cannot go round for ever, so the search ends by itself however often a text was misread.
    """
    return len(other) < len(text) or cost(other) < cost(text) or _as_utf8(other, "cp1252") != other


@lru_cache(200_000)
def repair(stretch: str) -> tuple[str, tuple[str, ...]]:
    """(cheapest text reachable from ``stretch``, operations that lead to it); unchanged if nothing is clearly better.

    Best-first by the cost of a text and of the steps to it. A text whose steps alone cost as much as the best one found
    leads to nothing better; there is no other limit.
    """
    start = cost(stretch)
    if start < MARGIN:
        return stretch, ()
    best, best_cost, best_path = stretch, start, ()
    queue: list[tuple[float, int, float, str, tuple[str, ...]]] = [(start, 0, 0.0, stretch, ())]
    seen, n = {hash(stretch)}, 0
    while queue:
        now, _, steps, text, path = heappop(queue)
        if now < best_cost:
            best, best_cost, best_path = text, now, path
        for name, other in _neighbours(text):
            step = steps + (STEP if name.endswith("utf-8") or name == "unescape" else BYTE_STEP)
            if step >= best_cost or hash(other) in seen or REPLACEMENT in other and REPLACEMENT not in text or not _goes_on(text, other):
                continue
            seen.add(hash(other))
            n += 1
            heappush(queue, (cost(other) + step, n, step, other, (*path, name)))
    return (best, best_path) if start - best_cost >= MARGIN else (stretch, ())


_STRETCH = re.compile(rf"[^\x00-\x20]*(?:[^\x00-\x7f]|{_ESCAPE.pattern})[^\x00-\x20]*")
#: Short words that are whole stretches beyond ASCII, so that only the rest of the row tells how they were read.
_SHORT = frozenset(("é", "à", "É", "À", "ó", "–", "í"))


def restore(text: str | None) -> tuple[str | None, bool, bool]:
    """(restored text, garbled?, fully restored?) of one text; null and empty texts are sound.

    Every stretch is searched by itself first. The changes of encoding found then hold for the whole row: sequences that
    are well-formed UTF-8 under them are decoded everywhere, and of single-byte encodings the one that makes the row
    cheapest is taken for all its implausible stretches. A stretch that does not become sound comes out as it was.
    """
    if not text or text.isascii() and not _ESCAPE.search(text):
        return text, False, True
    found = [m.group() for m in _STRETCH.finditer(text)]
    paths = {s: repair(s)[1] for s in set(found)}
    used = {p for path in paths.values() for p in path}
    lost = REPLACEMENT in text
    if not used:
        return text, lost, not lost
    decode = sorted(p.partition(">")[0] for p in used if p.endswith("utf-8"))
    byte_wise = {s for s, path in paths.items() if path and all(p.endswith(f">{MEANT[0]}") for p in path)}
    codec = None
    if byte_wise:
        odd = [s for s in set(found) if s in byte_wise or not paths[s] and cost(s) > 0]
        codec = min((c for c in CODECS if c not in (*MEANT, "iso8859_15")), key=lambda c: sum(cost(_as_bytes(s, c, MEANT[0])) for s in odd))
    whole = not lost

    def mend(m: re.Match) -> str:
        nonlocal whole
        s = m.group()
        out = repair(s)[0]
        if codec and (s in byte_wise or not paths[s]):
            other = _as_bytes(s, codec, MEANT[0])
            if s in byte_wise or cost(other) < cost(s) or other.strip(",.;:()") in _SHORT:
                out = other
        if out == s:
            for c in decode:
                out = _as_utf8(out, c)
        if not sound(out):
            whole = False
            return s
        return out

    return _STRETCH.sub(mend, text), True, whole


def suspects(text: Column) -> Column:
    """Whether a text can hold garbled stretches at all; a JVM scan that spares only texts the search would not change."""
    return text.rlike(SUSPECT)


def garbled(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text, restored, complete) of garbled rows only.

    ``complete`` is false where characters are lost or implausible ones remain. Sound rows, null and empty texts have no
    row; repeated rows come out as often. Extra columns are ignored.
    """

    @F.pandas_udf("restored string, garbled boolean, complete boolean")
    def mend(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([restore(t) for t in texts], columns=["restored", "garbled", "complete"])

    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("text")).filter(suspects(F.col("text")))
    done = rows.withColumn("m", mend.asNondeterministic()("text"))
    return done.filter("m.garbled").select("row_id", "text", "m.restored", "m.complete")


def garbled_rows(ipe: DataFrame, documents: DataFrame) -> DataFrame:
    """(table_name, row_id, restored, complete) over both tables."""
    parts = (("ipe", ipe, "ipe_id", "assunto"), ("documents", documents, "doc_id", "text"))
    one, two = (garbled(df, key, text).select(F.lit(name).alias("table_name"), "row_id", "restored", "complete") for name, df, key, text in parts)
    return one.unionByName(two)

