"""Lines repeated across the documents of one source.

Texts are read once: each becomes the identifiers of its lines. A block of lines can span many documents only if each of
its lines does, so lines are counted first, on the JVM. What is left of each document is a short sequence of identifiers
of repeated lines; equal sequences of a source are merged with their weight. Suffix arrays over bounded shards of a
source's sequences give every repeated block through the common prefixes of neighbouring suffixes; shards add up, and
blocks that span enough documents are deleted. A block that spans its share of a source does so in one of its shards at
least, so the longest such block of any shard bounds the length of all: no constant does.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riacho.llm.suffix import common_prefixes, suffix_array
from riacho.scale import checked_broadcast, materialize, salted_join

LEAST_LETTERS = 12
LEAST_DOCS = 5
#: Least share of a source's documents, in thousandths.
LEAST_PER_MILLE = 50
#: Sequences per suffix array.
SHARD_SEQUENCES = 20_000

_WHITE = r"[\t\x0B\f\r\x1c-\x1f \x85\xa0  -     　]+"
_NO_SOURCE = "\x00"


def normal_lines(text: Column) -> Column:
    """Lines in lower case with runs of white space collapsed and ends trimmed."""
    return F.transform(F.split(F.regexp_replace(F.lower(text), _WHITE, " "), "\n"), lambda x: F.trim(x))


def _line_ids(text: Column) -> Column:
    """Identifier of each line; null for lines with too few letters."""
    return F.transform(normal_lines(text), lambda x: F.when(F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= LEAST_LETTERS, F.xxhash64(x)))


def _totals(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(F.coalesce(source, F.lit(_NO_SOURCE)).alias("source")).agg(F.count(F.lit(1)).alias("total"))


def _spans_enough(per_mille: int, least_docs: int) -> Column:
    return (F.col("n_docs") >= least_docs) & (F.col("n_docs") * 1000 >= F.col("total") * per_mille)


class Shard:
    """Blocks of the sequences of one shard, by their length: intervals of the suffix array with a common prefix."""

    def __init__(self, rows: pd.DataFrame) -> None:
        sequences = [np.asarray(s, np.int64) for s in rows["sequence"]]
        joined = np.concatenate([x for s in sequences for x in (s, np.zeros(1, np.int64))])
        self.owner = np.repeat(np.arange(len(sequences)), [len(s) + 1 for s in sequences])
        self.weight = rows["n_docs"].to_numpy(np.int64)
        self.names, dense = np.unique(joined[joined != 0], return_inverse=True)
        self.symbols = np.zeros(len(joined), np.int64)
        self.symbols[joined != 0] = dense + 1
        self.order = suffix_array(self.symbols)
        self.shared = common_prefixes(self.symbols, self.order, max(map(len, sequences)))

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first suffix, documents) of every block of 1, 2, 3 ... lines."""
        clear = np.ones(len(self.order), bool)  # suffixes whose first ``depth`` symbols hold no separator
        depth = 0
        while True:
            last = self.order + depth
            depth += 1
            clear &= last < len(self.symbols)
            clear[clear] = self.symbols[last[clear]] != 0
            at = np.flatnonzero(clear)
            if not len(at):
                return
            interval = np.cumsum(self.shared < depth)[at]
            pairs = np.unique(np.stack([interval, self.owner[self.order[at]]]), axis=1)
            numbers, first = np.unique(interval, return_index=True)
            yield self.order[at[first]], np.bincount(pairs[0], self.weight[pairs[1]])[numbers].astype(np.int64)

    def deepest(self, per_mille: int) -> int:
        """Lines of the longest block that spans its share of this shard's documents."""
        depth, least = 0, int(self.weight.sum()) * per_mille
        for _, docs in self.levels():
            if not (docs * 1000 >= least).any():
                break
            depth += 1
        return depth

    def blocks(self, depth: int) -> Iterator[tuple[list[int], int]]:
        for n, (first, docs) in enumerate(islice(self.levels(), depth), 1):
            for f, d in zip(first.tolist(), docs.tolist(), strict=True):
                yield self.names[self.symbols[f : f + n] - 1].tolist(), d


def _blocks(sharded: DataFrame, per_mille: int) -> DataFrame:
    """(source, block, n_docs) of the blocks that can span enough documents, summed over the shards of each source."""

    def deepest(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"source": rows["source"].iloc[:1], "depth": [Shard(rows).deepest(per_mille)]})

    def blocks(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(Shard(rows).blocks(int(rows["depth"].iloc[0])))
        return pd.DataFrame({"source": rows["source"].iloc[0], "block": [b for b, _ in found], "n_docs": [n for _, n in found]})

    parts = sharded.groupBy("source", "shard")
    depths = parts.applyInPandas(deepest, "source string, depth int").groupBy("source").agg(F.max("depth").alias("depth"))
    found = sharded.join(depths, "source").groupBy("source", "shard").applyInPandas(blocks, "source string, block array<bigint>, n_docs bigint")
    return found.groupBy("source", "block").agg(F.sum("n_docs").alias("n_docs"))


class Boilerplate:
    """Repeated lines and blocks of ``df`` per source.

    Documents are rows; null texts count in a source's total and have no lines. Documents without source form one source
    of their own. Lines are numbered from 1 between line feeds. Extra columns are ignored; an empty table has no blocks.
    """

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", per_mille: int = LEAST_PER_MILLE, least_docs: int = LEAST_DOCS) -> None:
        self.df, self.doc_id, self.text = df, doc_id, text
        totals = _totals(df, source)
        docs = df.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.coalesce(source, F.lit(_NO_SOURCE)).alias("source"), _line_ids(F.col(text)).alias("lines"))
        docs = materialize(docs)
        once = docs.select("source", F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("line"))
        counted = once.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= least_docs)
        frequent = counted.join(totals, "source").filter(_spans_enough(per_mille, least_docs)).select("source", "line")
        frequent, small = checked_broadcast(frequent)
        lines = docs.select("doc", "source", F.posexplode("lines").alias("at", "line")).filter(F.col("line").isNotNull())
        hits = salted_join(lines, frequent, small, ["source", "line"], ["doc"]).select("doc", "source", (F.col("at") + 1).cast("long").alias("line_no"), "line")
        per_doc = hits.groupBy("source", "doc").agg(F.array_sort(F.collect_set(F.struct("line_no", "line"))).alias("hits"))
        # A 0 stands wherever other lines lie between two repeated ones.
        gapped = F.flatten(F.transform("hits", lambda x, i: F.when((i > 0) & (F.get(F.col("hits"), i - 1)["line_no"] != x["line_no"] - 1), F.array(F.lit(0).cast("long"), x["line"])).otherwise(F.array(x["line"]))))
        self.per_doc = materialize(per_doc.withColumn("sequence", gapped))
        merged = self.per_doc.groupBy("source", "sequence").agg(F.count(F.lit(1)).alias("n_docs"))
        sizes = merged.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / SHARD_SEQUENCES).alias("shards"))
        sharded = materialize(merged.join(sizes, "source").withColumn("shard", F.pmod(F.xxhash64("sequence"), "shards")))
        self.blocks = materialize(_blocks(sharded, per_mille).join(totals, "source").filter(_spans_enough(per_mille, least_docs)))
        self.longest = self.blocks.agg(F.coalesce(F.max(F.size("block")), F.lit(0))).first()[0]

    def spans(self) -> DataFrame:
        """(doc, from_line, n_lines): at each line the longest block that starts there and spans enough documents."""
        blocks, small = checked_broadcast(self.blocks.select("source", "block"))
        starts = self.per_doc.select("doc", "source", "sequence", F.filter("hits", lambda x: F.lit(True)).alias("hits"))
        # Positions in the sequence, gaps included; line numbers come from the hits in order.
        starts = starts.select("doc", "source", "hits", "sequence", F.posexplode("sequence").alias("at", "line")).filter("line != 0")
        gaps = F.size(F.filter(F.slice("sequence", F.lit(1), F.col("at") + 1), lambda x: x == 0))
        rest = F.slice("sequence", F.col("at") + 1, F.lit(max(self.longest, 1)))
        end = F.array_position(rest, F.lit(0).cast("long"))
        rest = F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest)
        starts = starts.select("doc", "source", F.get("hits", F.col("at") - gaps)["line_no"].alias("from_line"), rest.alias("rest"))
        tried = starts.select("doc", "source", "from_line", F.explode(F.transform(F.sequence(F.lit(1), F.size("rest")), lambda n: F.slice(F.col("rest"), F.lit(1), n))).alias("block"))
        found = salted_join(tried, blocks, small, ["source", "block"], ["doc"])
        return found.groupBy("doc", "from_line").agg(F.max(F.size("block")).alias("n_lines"))

    def lines(self) -> DataFrame:
        """(doc_id, line_no) of every line to remove, once."""
        each = F.explode(F.sequence(F.col("from_line"), F.col("from_line") + F.col("n_lines") - 1))
        return self.spans().select(F.col("doc").alias(self.doc_id), each.alias("line_no")).distinct()

    def cleaned(self) -> DataFrame:
        """``df`` without those lines; other lines stay as they are."""
        gone = self.lines().groupBy(F.col(self.doc_id).alias("_doc")).agg(F.collect_list("line_no").alias("_gone"))
        parts = F.filter(F.split(F.col(self.text), "\n"), lambda x, i: ~F.array_contains("_gone", (i + 1).cast("long")))
        out = self.df.join(gone, F.col(self.doc_id) == F.col("_doc"), "left")
        return out.withColumn(self.text, F.when(F.col("_gone").isNull(), F.col(self.text)).otherwise(F.array_join(parts, "\n"))).drop("_doc", "_gone")
