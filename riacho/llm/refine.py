"""Duplicates hidden by formatting: progressive partition refinement.

One pass folds each text and leaves (id, number of letters and digits, fingerprint of the letter histogram). Rows are
split into classes by the number first; the histogram parts only classes with several members, and the costly canonical
key is computed only for rows whose class still has several. Texts are read again for those rows alone and never shuffled
before. Everything is built-in Spark expressions; no class is ever gathered in one task.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riacho.scale import SALTS, checked_broadcast, count_classes, materialize, salt_of

#: Invisible characters: format, control and other code points without a glyph.
INVISIBLE = r"[\p{Cf}\p{Cc}\p{Co}\p{Cn}&&[^\t\n\x0B\f\r\x1c-\x1f\x85]]"
#: What may stand between the contents of two equal fields: white space, punctuation and the ASCII signs used as such.
IGNORED = r"[\p{P}\p{Z}\s\x1c-\x1f\x85\^~+<=>|`]"
#: A mark that belongs to a number: between two digits, a sign right before, a percent sign right after.
NUMBER_MARK = r"(?<=\p{Nd})[\p{P}\p{S}](?=\p{Nd})|(?<=\p{Nd})[%‰٪％]|(?<![\p{L}\p{N}])[-+−±](?=\p{Nd})"


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: seen?, visible?, letters and digits it folds to, sum of their hashes; filled as they occur."""
    n = sys.maxunicode + 1
    return np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.uint64)


def _hash(c: str) -> int:
    """A 64-bit mix of one character's code point."""
    x = (ord(c) + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def _learn(points: np.ndarray) -> None:
    seen, visible, letters, hashes = _tables()
    for p in np.unique(points[~seen[points]]).tolist():
        c = chr(p)
        # Coarser than the key on purpose: case and accents, composed or not, never part two rows here.
        base = unicodedata.normalize("NFD", c.upper().lower().replace("ς", "σ").replace("ß", "ss"))
        kept = [x for x in base if unicodedata.category(x)[0] == "L" or unicodedata.category(x) == "Nd"]
        seen[p], letters[p], hashes[p] = True, len(kept), sum(map(_hash, kept)) & (1 << 64) - 1
        visible[p] = unicodedata.category(c)[0] not in "ZC" and not c.isspace()


def invariants(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has a visible character, number of letters and digits, histogram fingerprint) of each text; nulls are empty.

    The fingerprint is the sum of the characters' hashes, so it does not depend on their order.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])[offsets - offsets[0]]
    _learn(points)
    _, visible, letters, hashes = _tables()

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])  # wraps around, which is meant
        return total[begins[1:]] - total[begins[:-1]]

    return sums(visible[points].astype(np.int64)) > 0, sums(letters[points]), sums(hashes[points])


def cheap(df: DataFrame, row_id: str, left: str, right: str) -> DataFrame:
    """(_id, _n, _h): letters and digits of both fields together and their fingerprint, of rows with an id and two visible fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, n, h), (two, m, g) = invariants(batch.column(1)), invariants(batch.column(2))
            keep = pa.array(one & two)
            arrays = [batch.column(0), pa.array(n + m, pa.int64()), pa.array((h + g).view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays([a.filter(keep) for a in arrays], ["_id", "_n", "_h"])

    kind = df.schema[row_id].dataType.simpleString()
    rows = df.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    return rows.mapInArrow(run, f"_id {kind}, _n bigint, _h bigint")


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """Letters with combining accents as single letters (NFC)."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def fold(c: Column) -> Column:
    """Case-folded text without invisible characters, sharp s and final sigma included; accents composed."""
    small = F.lower(F.upper(F.regexp_replace(c, INVISIBLE, "")))
    return _composed(F.replace(F.replace(small, F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss")))


def content(folded: Column) -> Column:
    """What is left of a folded field when white space and punctuation are ignored; marks of numbers stay."""
    return F.regexp_replace(folded, f"({NUMBER_MARK})|{IGNORED}", "$1")


def sorted_fields(folded: Column) -> Column:
    """Contents of the fields that ``|`` separates, sorted, empty ones dropped, each closed by U+0001."""
    parts = F.filter(F.transform(F.split(folded, r"\|"), content), lambda x: x != "")
    return F.array_join(F.array_sort(parts), "\x01")


def with_canonical_key(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Adds the key that is equal for two rows that differ only in form; the order of the two columns does not count."""
    rows = rows.withColumn("_a", fold(F.col(left))).withColumn("_b", fold(F.col(right)))
    rows = rows.withColumn("_a", sorted_fields(F.col("_a"))).withColumn("_b", sorted_fields(F.col("_b")))
    return rows.withColumn(name, F.sha2(F.concat_ws("\x02", F.least("_a", "_b"), F.greatest("_a", "_b")), 256)).drop("_a", "_b")


def _classes_of_several(rows: DataFrame, key: list[str], unique: str, salts: int) -> DataFrame:
    """``rows`` whose class has several members, with its size ``n`` and smallest member ``first``."""
    classes = count_classes(rows, key, unique, salts).filter("n > 1")
    salted = rows.withColumn("salt", salt_of(F.col(unique), salts))
    return salted.join(classes, [*key, "salt"]).drop("salt")


def refine(df: DataFrame, row_id: str, left: str, right: str, salts: int = SALTS) -> DataFrame:
    """(row_id, kept_id, n_copies) of every row that has at least one copy.

    ``kept_id`` is the smallest ``row_id`` of the record, ``n_copies`` the number of its rows. Rows with a null or blank
    field, or without id, never are copies. Repeated rows with one id count as copies with that id. Extra columns are
    ignored; an empty table gives an empty result.
    """
    light = materialize(cheap(df, row_id, left, right))
    alike, small = checked_broadcast(_classes_of_several(light, ["_n", "_h"], "_id", salts).select("_id").distinct())
    texts = df.filter(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_id"), F.col(left).alias("_l"), F.col(right).alias("_r"))
    texts = texts.join(F.broadcast(alike) if small else alike, "_id", "left_semi").filter(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    # A repeated id may have a blank row beside a sound one, so the key asks again; it is empty where a field is.
    keyed = with_canonical_key(texts, "_l", "_r", "_key").filter(~_blank(F.col("_l")) & ~_blank(F.col("_r"))).select("_id", "_key")
    same = _classes_of_several(materialize(keyed), ["_key"], "_id", salts)
    return same.select(F.col("_id").alias(row_id), F.col("first").alias("kept_id"), F.col("n").alias("n_copies"))


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Z}\p{C}\s]", "") == ""


def collapse(df: DataFrame, row_id: str, left: str, right: str, salts: int = SALTS) -> DataFrame:
    """One row per record of ``df``, all its columns kept, with ``n_copies``; rows that are no cases stay as they are.

    The survivor is the row with the smallest id. Rows without id stay, with one copy.
    """
    found = materialize(refine(df, row_id, left, right, salts))
    dropped = found.filter(F.col(row_id) != F.col("kept_id")).select(F.col(row_id).alias("_gone"))
    sizes = found.filter(F.col(row_id) == F.col("kept_id")).select(F.col(row_id).alias("_kept"), F.col("n_copies").alias("_n")).distinct()
    out = df.drop("n_copies").join(dropped, F.col(row_id) == F.col("_gone"), "left_anti")
    return out.join(sizes, F.col(row_id) == F.col("_kept"), "left").withColumn("n_copies", F.coalesce("_n", F.lit(1))).drop("_kept", "_n")


def copies(df: DataFrame, row_id: str = "row_id", left: str = "source", right: str = "dataset", salts: int = SALTS) -> DataFrame:
    """(kept_id, copy_id): each further row of a record beside its smallest row."""
    found = refine(df, row_id, left, right, salts)
    return found.filter(F.col(row_id) != F.col("kept_id")).select("kept_id", F.col(row_id).alias("copy_id"))
