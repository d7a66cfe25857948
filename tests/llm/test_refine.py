import random
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from riacho.llm import refine as R


def brute_key(left, right):
    def content(s):
        s = unicodedata.normalize("NFC", "".join(c for c in s if unicodedata.category(c) != "Cf")).casefold()
        digit = lambda i: 0 <= i < len(s) and s[i].isdigit()
        out = ""
        for i, c in enumerate(s):
            if c.isspace() or unicodedata.category(c)[0] in "ZC":
                continue
            if unicodedata.category(c)[0] == "P" or c in "^~+<=>|`":
                between, percent, sign = digit(i - 1) and digit(i + 1), c == "%" and digit(i - 1), c in "-+" and digit(i + 1) and not (i and s[i - 1].isalnum())
                if not (between or percent or sign):
                    continue
            out += c
        return out

    field = lambda s: tuple(sorted(x for x in map(content, s.split("|")) if x))
    return tuple(sorted((field(left), field(right))))


def test_refinement_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["Lucro", "lucro", " ", "​", " ", ",", ".", "-", "%", "12,3", "123", "5", "|", "ção", "ção", "café", "café", "cafe", "!", "…", "ß", "SS", "\n"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(1, 4))), rng.choice(["a/b", "A b", "a_b", "c"])) for i in range(600)]
    rows += [(600 + i, *(rows[i][:0:-1])) for i in range(40)]  # columns swapped
    rows += [(700, None, "c"), (701, " ", "c"), (702, "x", ""), (703, "x" * 100_000, "c"), (704, "X" * 100_000 + "!", "C")]
    groups = defaultdict(list)
    for i, a, b in rows:
        if a and b and re.sub(r"[\s​]", "", a) and b.strip():
            groups[brute_key(a, b)].append(i)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row_id long, source string, dataset string, n long".replace("n long", "n_copies string"))
    got = R.copies(df).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    kept = R.collapse(df, "row_id", "source", "dataset")
    assert kept.count() == len(rows) - len(want)
    assert kept.agg(F.sum("n_copies")).first()[0] == len(rows)


def test_hot_class_is_spread_and_counted(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Mesma frase!").otherwise(F.concat(F.lit("frase "), F.col("id"))).alias("source"), F.lit("d").alias("dataset"))
    found = R.refine(df, "row_id", "source", "dataset")
    assert {tuple(r) for r in found.select("kept_id", "n_copies").distinct().collect()} == {(0, 1000)} and found.count() == 1000
    assert R.copies(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "A.", "b")], "row_id long, source string, dataset string")
    assert [tuple(r) for r in R.copies(df).collect()] == [(1, 2)]


def test_composed_letters_of_every_script(spark):
    texts = ["Tiếng Việt", "Ελλάδα ΐ", "Łódź żółć", "naïve İ", "각"]
    rows = [(2 * i, unicodedata.normalize("NFC", t), "c") for i, t in enumerate(texts)] + [(2 * i + 1, unicodedata.normalize("NFD", t).upper(), "C") for i, t in enumerate(texts)]
    got = {tuple(r) for r in R.copies(spark.createDataFrame(rows, "row_id long, source string, dataset string")).collect()}
    assert got >= {(2 * i, 2 * i + 1) for i in (0, 2, 4)}


def test_invariants_never_part_equal_rows():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choices("aAbÇç ſıß12,.é\u0301ΣςǅﬁẞŉΑ", k=12))
        seen, n, h = R.invariants(pa.array([t, t.upper(), t.upper().lower(), unicodedata.normalize("NFD", t), t[::-1], "  " + t]))
        assert seen.all() and len(set(n.tolist())) == 1 and len(set(h.tolist())) == 1
    seen, n, h = R.invariants(pa.array(["", None, " \u200b", "a"]).slice(1, 3))
    assert seen.tolist() == [False, False, True] and n.tolist() == [0, 0, 1] and h[0] == 0
    assert [len(x) for x in R.invariants(pa.array([], pa.string()))] == [0, 0, 0]
