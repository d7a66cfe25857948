"""Noise in text from scanned pages: page furniture, words broken at line ends, misread characters.

Layout is read per document: hard-wrapped lines, page numbers and lines that recur at page edges. Words are settled over
the whole corpus in SQL: anagram hashes (sums of character hashes) turn each known confusion into a constant difference,
so rare words meet their frequent variants in an equi-join; counts of joined and hyphenated forms tell whether a hyphen
at a line end belongs to the word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riacho.llm import pieces
from riacho.scale import checked_broadcast, materialize, salted_join

# What a scanner reads -> what is printed.
CONFUSIONS = {
    "@": "a", "0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "3": "e", "!": "l", "|": "l", "$": "s",
    "l": "i", "i": "l", "c": "e", "e": "c", "f": "t", "q": "g", "g": "q", "rn": "m", "m": "rn", "cl": "d", "d": "cl",
    "ii": "u", "u": "ii", "li": "h", "h": "li", "vv": "w", "ri": "n", "n": "ri", "à": "ã", "ã": "à", "á": "â", "è": "é", "ò": "õ", "ö": "õ",
    "ì": "í", "ù": "ú", "ç,": "ç", "nn": "m", "v": "y", "o": "c", "b": "h", "tl": "d", "1n": "m", "ci": "d", "t": "r",
}
_MORE = {"1": ("i",), "l": ("t",), "0": ("ó", "õ", "ô"), "i": ("í",), "6": ("ó",), "t": ("f",), "r": ("t",), "c": ("ç", "o"), "a": ("ã", "á", "à"), "o": ("ó", "õ")}
HYPHENS = "-­‐¬"
#: How much more frequent a variant must be than a rare word; less is asked where a sign or digit stands among letters.
RATIO, RATIO_SIGN = 12, 2
WIDEST, NARROWEST = 120, 30
#: Documents in which an edge line's pattern must stand, and the share in which it recurs.
EDGE_DOCS, EDGE_SHARE = 3, 0.15
#: Share of a text's pages that its running header heads or ends at least.
EDGE_PAGES = 0.3

_STRIP = ".,;:()[]{}\"'!?«»“”‘’…–—|/-­‐¬"
_ROMAN = r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER = rf"(?:\d{{1,4}}|(?=[ivxlcdm]){_ROMAN})"
_MARKED = re.compile(
    rf"(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)|\d{{1,4}}\s*/\s*\d{{1,4}}"
    rf"|(?:p[áaà@]?g(?:ina|e|\.)?|page|p\.|folha|fls?\.?|sheet)\s*(?:n[ºo.]\s*)?{_NUMBER}(?:\s*(?:de|of|/)\s*{_NUMBER})?)\s*\Z",
    re.I,
)
_BARE = re.compile(rf"{_NUMBER}\Z", re.I)
_TAIL = re.compile(r"\s{2,}(\S.*)\Z")
_DIGITS = re.compile(r"\d+")
_OWNER = re.compile(r"^(?:[\d.@/-]{14,}\s+)?.{3,80}?\b(?:s\.?\s?a\.?|s/a|5\.a\.?|ltda\.?|inc\.?|plc)(?=[\s,.|]|$)", re.I)
_ALIKE = [("rn", "m"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("0", "o"), ("1", "l"), ("5", "s"), ("6", "b"), ("@", "a"), ("i", "l"), ("c", "e"), ("f", "t"), ("q", "g"), ("à", "ã"), ("ç,", "ç")]


def hard_wrapped(lines: list[str]) -> bool:
    """Whether lines break only because they are full: the next word would hardly ever have fitted."""
    used = [x.rstrip() for x in lines]
    lengths = sorted(len(x) for x in used if x.strip() and page_mark(x)[2] is None)
    if len(lengths) < 3 or lengths[-1] > 2 * WIDEST:
        return False
    width = lengths[int(0.85 * (len(lengths) - 1))]  # some headers are wider
    if not NARROWEST <= width <= WIDEST:
        return False
    full = breaks = 0
    for a, b in zip(used, used[1:], strict=False):
        if len(a) > 0.5 * width and b.strip() and b.lstrip()[0].islower():
            breaks += 1
            full += len(a) + 1 + len(b.split()[0]) >= width - 3
    return breaks >= 2 and full >= 0.75 * breaks


def page_mark(line: str) -> tuple[str, bool, int | None]:
    """(rest of the line before a page number, marked as one?, number) of a line; number None if there is none."""
    text = line.strip("\x0c \t\r")
    tail = _TAIL.search(text)
    for rest, part in ([(text[: tail.start()], tail.group(1))] if tail else []) + [("", text)]:
        if m := _MARKED.match(part):
            digits = _DIGITS.findall(m.group())
            return rest, True, int(digits[0]) if digits else 0
        if _BARE.match(part) and part:
            return rest, False, int(part) if part.isdigit() else 0
    return text, False, None


def pattern(text: str) -> str:
    """Pattern of a running header: owner and digits masked, look-alike characters merged."""
    low = _OWNER.sub("X", " ".join(text.split())).lower()
    low = _DIGITS.sub("#", low)
    for a, b in _ALIKE:
        low = low.replace(a, b)
    return low


def _may_head(line: str, shape: str) -> bool:
    """Whether a line can be a running header: it begins with its owner or a capital and does not end a sentence."""
    text = line.strip("\x0c \t\r")
    if len(text) < 4 or shape.startswith("#") or not (shape.startswith("x") or text[0].isupper()):
        return False
    return text[-1] not in ";:," and not (text[-1] == "." and text[-2].islower())


def layout(text: str) -> list[tuple[int, str, int, str]]:
    """(line number, line, sure, pattern) of every line of a hard-wrapped text; an empty list for other texts.

    ``sure`` is 1 for page numbers, 2 for lines whose pattern recurs at page edges, 0 for the rest; ``pattern`` is that of
    lines short enough for a header.
    """
    lines = text.split("\n")
    if not hard_wrapped(lines):
        return []
    marks = [page_mark(x) for x in lines]
    sure = [0] * len(lines)
    filled = [i for i, x in enumerate(lines) if x.strip()]
    bare = [i for i in filled if marks[i][2] is not None and not marks[i][1] and not marks[i][0]]
    in_order = {j for i, j in zip(bare, bare[1:], strict=False) if marks[j][2] - marks[i][2] == 1 or marks[i][2] == marks[j][2] == 0}
    in_order |= {i for i, j in zip(bare, bare[1:], strict=False) if j in in_order}
    for i in filled:
        rest, marked, number = marks[i]
        if number is not None and (marked or not rest and (i in in_order or "\x0c" in lines[i] or i == filled[-1]) and (number or len(lines[i].strip("\x0c ")) <= 6)):
            sure[i] = 1
    patterns = {i: pattern(marks[i][0] if marks[i][2] is not None and marks[i][0] else lines[i]) for i in filled}
    heads = {i: p for i, p in patterns.items() if sure[i] != 1 and _may_head(lines[i], p)}
    order = {i: k for k, i in enumerate(filled)}

    def at_edge(i: int) -> bool:
        near = [filled[j] for j in (order[i] - 1, order[i] + 1) if 0 <= j < len(filled)]
        return order[i] == 0 or "\x0c" in lines[i] or any(sure[j] == 1 or "\x0c" in lines[j] for j in near)

    edges = Counter(p for i, p in heads.items() if at_edge(i))
    both = Counter(patterns[i] for i in filled if i in patterns and sure[i] == 1 and marks[i][0])  # header and number in one line
    pages = sum(sure[i] == 1 or "\x0c" in lines[i] for i in filled)
    for i, p in heads.items():
        if edges[p] >= max(2, EDGE_PAGES * pages) or edges[p] and both[p]:
            sure[i] = 2
    patterns = {i: p if i in heads or sure[i] == 1 and marks[i][0] else "" for i, p in patterns.items()}
    return [(i + 1, x, sure[i], patterns.get(i, "")) for i, x in enumerate(lines)]


def word_of(token: str) -> str:
    """Lower-case word without outer punctuation; empty for tokens with more digits than letters."""
    w = token.strip(_STRIP).lower()
    letters = sum(c.isalpha() for c in w)
    return w if letters and letters >= sum(c.isdigit() for c in w) else ""


_LINES = "array<struct<no: bigint, line: string, sure: int, pattern: string>>"
_ARROW_LINES = pa.list_(pa.struct([("no", pa.int64()), ("line", pa.string()), ("sure", pa.int32()), ("pattern", pa.string())]))


def read_layout(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, lines) of each hard-wrapped text, and (word, n) of all texts, counted per batch; other columns null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch, texts in pieces.slices(batches, "text", 4_000_000):
            tokens: Counter = Counter()
            docs, layouts = [], []
            for doc, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                if not t:
                    continue
                tokens.update(t.split())
                if lines := layout(t):
                    docs.append(doc)
                    layouts.append([{"no": no, "line": x, "sure": sure, "pattern": p} for no, x, sure, p in lines])
            words: Counter = Counter()
            for token, n in tokens.items():
                w = known.get(token)
                if w is None:
                    if len(known) > 500_000:
                        known.clear()
                    w = known[token] = word_of(token)
                if w:
                    words[w] += n
            none = [None] * len(words)
            arrays = [
                pa.array(docs + none, pa.int64()),
                pa.array(layouts + none, _ARROW_LINES),
                pa.array([None] * len(docs) + list(words), pa.string()),
                pa.array([None] * len(docs) + list(words.values()), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lines", "word", "n"])

    schema = f"doc_id bigint, lines {_LINES}, word string, n bigint"
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def anagram(word: Column) -> Column:
    """Sum of character hashes: equal for anagrams, and a confusion changes it by a constant."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.pmod(F.xxhash64(c), F.lit(1 << 40)))


def confusions(spark) -> DataFrame:
    pairs = sorted({*CONFUSIONS.items(), *((a, b) for a, bs in _MORE.items() for b in bs)})
    rows = spark.createDataFrame(pairs, "wrong string, right string")
    return rows.withColumn("difference", anagram(F.col("right")) - anagram(F.col("wrong")))


def corrections(words: DataFrame, rare: DataFrame) -> DataFrame:
    """(word, right, at) from ``words`` (word, n): the most frequent variant one confusion away of each rare word.

    ``at`` is the position of the confusion, from 0. Ties go to the first variant in order.
    """
    pairs = F.broadcast(confusions(words.sparkSession))  # a fixed list
    keyed = words.withColumn("hash", anagram(F.col("word")))
    plain = F.col("word").rlike(r"^[\p{L}.,/-]+$")
    frequent = keyed.filter(plain & (F.col("n") >= RATIO_SIGN)).select(F.col("word").alias("variant"), F.col("n").alias("variant_n"), F.col("hash").alias("target"))
    changed = keyed.join(rare, "word").join(pairs, F.col("word").contains(F.col("wrong"))).withColumn("target", F.col("hash") + F.col("difference"))
    met = changed.join(frequent, "target")
    found = F.array_position(
        F.transform(
            F.sequence(F.lit(1), F.length("word")),
            lambda p: (F.substring(F.col("word"), p, F.length("wrong")) == F.col("wrong"))
            & (F.concat(F.substring(F.col("word"), F.lit(1), p - 1), F.col("right"), F.substring(F.col("word"), p + F.length("wrong"), F.length("word"))) == F.col("variant")),
        ),
        True,
    )
    sign = F.col("wrong").rlike(r"[^\p{L}]")
    strong = F.col("variant_n") >= F.col("n") * F.when(sign, RATIO_SIGN).otherwise(RATIO)
    met = met.withColumn("at", found - 1).filter((F.col("at") >= 0) & strong)
    best = Window.partitionBy("word").orderBy(F.desc("variant_n"), "variant")
    return met.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("word", F.col("variant").alias("right"), F.col("at").cast("int").alias("at"))


class ScannedPages:
    """Findings on the hard-wrapped texts of ``documents``.

    Lines are numbered from 1 between line feeds. Null and empty texts have no findings; repeated rows of a document give
    each finding once, and a document that occurs with several texts has those of each. Extra columns are ignored. The
    lines of a document stay together in one row; only words, patterns and findings are shuffled.
    """

    def __init__(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> None:
        self.documents, self.doc_id, self.text = documents, doc_id, text
        read = materialize(read_layout(documents, doc_id, text))
        self.words = materialize(read.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        docs = read.filter("lines is not null").select("doc_id", "lines").withColumn("copy", F.xxhash64("lines"))
        # A pattern that recurs at page edges of several documents is furniture wherever it heads or ends a text.
        marked = docs.select("doc_id", "copy", F.explode(F.filter("lines", lambda x: x["pattern"] != "")).alias("x")).select("doc_id", "copy", "x.no", "x.sure", "x.pattern")
        per_doc = marked.groupBy("pattern", "doc_id").agg(F.max((F.col("sure") > 0).cast("int")).alias("edge"))
        learnt = per_doc.groupBy("pattern").agg(F.count(F.lit(1)).alias("docs"), F.sum("edge").alias("edges"))
        learnt = learnt.filter((F.col("edges") >= EDGE_DOCS) & (F.col("edges") >= EDGE_SHARE * F.col("docs"))).select("pattern")
        learnt, small = checked_broadcast(learnt)
        known = salted_join(marked.filter("sure = 0"), learnt, small, ["pattern"], ["doc_id", "no"])
        known, small = checked_broadcast(known.groupBy("doc_id", "copy").agg(F.collect_set("no").alias("known")))
        docs = docs.join(F.broadcast(known) if small else known, ["doc_id", "copy"], "left")
        furniture = lambda x: (x["sure"] > 0) | F.coalesce(F.array_contains("known", x["no"]), F.lit(False))
        lines = F.transform("lines", lambda x: F.struct(x["no"].alias("no"), x["line"].alias("line"), furniture(x).alias("furniture")))
        self.docs = materialize(docs.select("doc_id", lines.alias("lines")))
        self.running = self.docs.select("doc_id", F.filter("lines", lambda x: ~x["furniture"]).alias("lines"))
        self.broken = materialize(self._hyphens().distinct())
        self.fixes = materialize(self._misread().distinct())

    def _hyphens(self) -> DataFrame:
        """(doc_id, line_no, next_no, a, b, joined?): line ends with a hyphen and what goes on in the next running line."""
        filled = self.running.select("doc_id", F.filter("lines", lambda x: F.trim(F.regexp_replace(x["line"], r"[\x0c\r]", "")) != "").alias("lines"))
        ends = filled.select("doc_id", F.explode(F.transform("lines", lambda x, i: F.struct(x["no"].alias("no"), x["line"].alias("line"), F.get(F.col("lines"), i + 1).alias("after")))).alias("x"))
        ends = ends.select("doc_id", F.col("x.no").alias("line_no"), F.col("x.after.no").alias("next_no"), F.regexp_replace("x.line", r"[\s\x0c]+$", "").alias("line"), F.col("x.after.line").alias("next"))
        ends = ends.filter(F.col("line").rlike(rf"\p{{L}}[{HYPHENS}]$") & F.col("next").rlike(r"^\s*[\p{Ll}@0-9]"))
        ends = ends.select(
            "doc_id", "line_no", "next_no",
            F.lower(F.regexp_extract("line", rf"([^\s(\"“«/]+)[{HYPHENS}]$", 1)).alias("a"),
            F.lower(F.regexp_extract("next", r"^\s*(\S+?)[.,;:()\"'!?«»“”…]*(\s|$)", 1)).alias("b"),
        )
        ends = materialize(ends)
        counts = self.words.select("word", "n")
        asked = ends.select(F.explode(F.array(F.concat("a", "b"), F.concat_ws("-", "a", "b"))).alias("word")).distinct()
        counts, small = checked_broadcast(counts.join(asked, "word", "left_semi"))
        whole = counts.withColumnRenamed("n", "n_whole")
        split = counts.withColumnRenamed("n", "n_split")
        tried = salted_join(ends.withColumn("word", F.concat("a", "b")), whole, small, ["word"], ["doc_id", "line_no"], "left").drop("word")
        tried = salted_join(tried.withColumn("word", F.concat_ws("-", "a", "b")), split, small, ["word"], ["doc_id", "line_no"], "left").drop("word")
        n_whole, n_split = F.coalesce("n_whole", F.lit(0)), F.coalesce("n_split", F.lit(0))
        joined = F.when((n_whole > 0) | (n_split > 0), n_whole > n_split).otherwise(F.lit(True))
        return tried.select("doc_id", "line_no", "next_no", "a", "b", joined.alias("joined"))

    def _misread(self) -> DataFrame:
        """(doc_id, line_no, word, right) of misread words in running lines; halves of a broken word on their lines."""
        halves = self.broken.select("doc_id", "line_no", "next_no", "a", "b", F.when(F.col("joined"), F.concat("a", "b")).otherwise(F.concat_ws("-", "a", "b")).alias("word"))
        lines = self.running.select("doc_id", F.explode("lines").alias("x"))
        tokens = lines.select("doc_id", F.col("x.no").alias("line_no"), F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("x.line", r"[\x0c\r]", "")), r"\s+"))).alias("token"))
        edge = re.escape(_STRIP).replace("/", r"\/")
        whole = tokens.select("doc_id", "line_no", F.regexp_replace("token", rf"^[{edge}]+|[{edge}]+$", "").alias("word")).filter(F.col("word").rlike(r"\p{L}"))
        extra = halves.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counts = self.words.unionByName(extra).groupBy("word").agg(F.sum("n").alias("n"))
        rare = whole.select("word").unionByName(halves.select("word")).distinct()
        fixes, small = checked_broadcast(corrections(counts, rare))
        # Cut here, else the anti-join below would move under the join with the fixes and shuffle every word.
        plain = materialize(salted_join(whole, fixes.drop("at"), small, ["word"], ["doc_id", "line_no"]).select("doc_id", "line_no", "word", "right"))
        # A half of a broken word is no word of its own.
        ends = self.broken.select("doc_id", "line_no", F.col("a").alias("word")).unionByName(self.broken.select("doc_id", F.col("next_no").alias("line_no"), F.col("b").alias("word")))
        plain = plain.join(ends, ["doc_id", "line_no", "word"], "left_anti")
        broken = salted_join(halves, fixes, small, ["word"], ["doc_id", "line_no"])
        broken = broken.select("doc_id", F.when(F.col("at") < F.length("a"), F.col("line_no")).otherwise(F.col("next_no")).alias("line_no"), "word", "right")
        return plain.unionByName(broken)

    def findings(self) -> DataFrame:
        """(doc_id, line_no, kind): furniture, hyphen and char, each once per line."""
        parts = (
            self.docs.select("doc_id", F.explode(F.filter("lines", lambda x: x["furniture"])).alias("x")).select("doc_id", F.col("x.no").alias("line_no"), F.lit("furniture").alias("kind")).distinct(),
            self.broken.filter("joined").select("doc_id", "line_no", F.lit("hyphen").alias("kind")),
            self.fixes.select("doc_id", "line_no", F.lit("char").alias("kind")).distinct(),
        )
        out = parts[0].unionByName(parts[1]).unionByName(parts[2])
        return out.withColumnRenamed("doc_id", self.doc_id)

    def paragraphs(self) -> DataFrame:
        """(doc_id, text) of the hard-wrapped texts as continuous paragraphs, repaired."""
        fixes = self.fixes.groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("fixes"))
        joins = self.broken.groupBy("doc_id", "line_no").agg(F.max("joined").alias("joined")).groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("line_no").cast("string"), "joined")))).alias("joins"))
        rows = self.running.dropDuplicates(["doc_id", "lines"]).join(fixes, "doc_id", "left").join(joins, "doc_id", "left")

        @F.pandas_udf("string")
        def flow(lines: pd.Series, fixes: pd.Series, joins: pd.Series) -> pd.Series:
            return pd.Series([reflow([(x["no"], x["line"]) for x in a], dict(b or {}), dict(c or {})) for a, b, c in zip(lines, fixes, joins, strict=True)])

        return rows.select(F.col("doc_id").alias(self.doc_id), flow("lines", "fixes", "joins").alias("text"))


def _like(right: str, seen: str) -> str:
    """``right`` in the letter case of ``seen``."""
    if seen.isupper() and len(seen) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if seen[:1].isupper() else right


def reflow(lines: list[tuple[int, str]], fixes: dict[str, str], joins: dict[str, bool]) -> str:
    """Paragraphs of running lines: blank lines part them, broken words are joined, misread words replaced."""
    paragraphs, now = [], ""
    for no, raw in lines:
        line = raw.strip("\x0c\r \t")
        if not line:
            if now:
                paragraphs.append(now)
            now = ""
            continue
        now = now + line if now.endswith("\x00") else f"{now} {line}".strip()
        now = now.replace("\x00", "")
        joined = joins.get(str(no))
        if joined is not None:
            now = (now[:-1] if joined else now[:-1] + "-") + "\x00"
    if now:
        paragraphs.append(now)

    def mend(m: re.Match) -> str:
        token = m.group()
        core = token.strip(_STRIP)
        right = fixes.get(core.lower()) if core else None
        return token.replace(core, _like(right, core)) if right else token

    return "\n\n".join(re.sub(r"\S+", mend, p.replace("\x00", "")) for p in paragraphs)
