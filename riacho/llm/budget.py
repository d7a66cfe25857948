"""Token budget: exact token totals per slice under an existing tokenizer.

Texts are normalised and pre-split as the tokenizer does; each distinct piece of the whole corpus is tokenised once, and
its length is joined with the piece frequencies of the slices (or documents).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riacho.llm import encode, pieces
from riacho.scale import checked_broadcast, materialize, salted_join

#: Parts of a piece's rows where its lengths are not broadcast.
SALTS = 16


def piece_frequencies(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys..., piece, n) summed within each Arrow batch; every piece of every text counts."""
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("piece", T.StringType()), T.StructField("n", T.LongType())])
    width = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: dict[str, list[str]] = {}
        for batch in batches:
            seen: dict[tuple, Counter] = defaultdict(Counter)
            columns = [batch.column(i).to_pylist() for i in range(width)]
            for key, t in zip(zip(*columns, strict=True) if columns else [()] * batch.num_rows, batch.column(width).to_pylist(), strict=True):
                if t:
                    seen[key].update(pieces.chunks(t))
            out_keys, out_pieces, out_n = [], [], []
            for key, counter in seen.items():
                total: Counter = Counter()
                for chunk, n in counter.items():
                    if chunk not in split:
                        if len(split) >= encode.MEMORY_WORDS:
                            split.clear()
                        split[chunk] = pieces.split_text(chunk)
                    for p in split[chunk]:
                        total[p] += n
                out_keys += [key] * len(total)
                out_pieces += total.keys()
                out_n += total.values()
            arrays = [pa.array([k[i] for k in out_keys], batch.schema.field(i).type) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out_pieces, pa.string()), pa.array(out_n, pa.int64())], schema.names)

    counted = df.select(*keys, text).mapInArrow(count, schema)
    return counted.groupBy(*keys, "piece").agg(F.sum("n").alias("n"))


def piece_lengths(distinct: DataFrame, ranks: str) -> DataFrame:
    """(piece, n_tokens) of distinct pieces."""
    file = encode.ship(distinct.sparkSession, ranks)

    @F.pandas_udf("int")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        exact = encode.load_ranks(SparkFiles.get(file))
        for batch in batches:
            yield batch.map(lambda p: len(encode.merge(exact, p))).astype("int32")

    return distinct.select("piece", length("piece").alias("n_tokens"))


def token_totals(df: DataFrame, text: str, keys: list[str], ranks: str = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(keys..., n_docs, n_empty, n_null, n_tokens) per slice.

    Null keys form slices of their own; so do keys that differ in case (normalise them before). Null and empty texts have
    no tokens and are counted apart; a blank text is text. An empty table gives no slice.
    """
    cached = materialize(piece_frequencies(df, text, keys))  # the texts are split once
    lengths, small = checked_broadcast(piece_lengths(cached.select("piece").distinct(), ranks))
    joined = salted_join(cached, lengths, small, ["piece"], keys or ["n"], salts=SALTS)
    tokens = joined.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))
    docs = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count(F.when(F.col(text) == "", 1)).alias("n_empty"),
        F.count(F.when(F.col(text).isNull(), 1)).alias("n_null"),
    )
    tokens = tokens.select(*(F.col(k).alias(f"_{k}") for k in keys), "n_tokens")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]
    out = docs.join(tokens, same, "left")
    return out.select(*keys, "n_docs", "n_empty", "n_null", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def normal_host(c):
    """Website without case and host prefix; blank is null."""
    host = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://)?(www\d*\.|m\.)?|[/.]+$", "")
    return F.when(host != "", host)


def normal_lang(c):
    """Language tag in lower case; null, blank and undetermined become ``und``."""
    return F.coalesce(F.when(F.trim(c) != "", F.lower(F.trim(c))), F.lit("und"))


def corpus_budget(documents: DataFrame, ranks: str = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    rows = documents.select("source", normal_lang(F.col("lang")).alias("lang"), normal_host(F.col("domain")).alias("domain"), "text")
    return token_totals(rows, "text", ["source", "lang", "domain"], ranks)


def labelled_budget(clean: DataFrame, ranks: str = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    name = F.regexp_replace(F.lower(F.trim("dataset")), r"[\s_-]+", "-")
    return token_totals(clean.select(name.alias("dataset"), "source"), "source", ["dataset"], ranks)


def document_tokens(documents: DataFrame, ranks: str = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) of each document; documents of equal id are summed, null and empty texts have 0.

    A document has about as many rows as pieces here, so lengths are summed where the text is read: each worker tokenises
    a piece once and remembers its length. Only one number per row is shuffled.
    """
    file = encode.ship(documents.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = encode.load_ranks(SparkFiles.get(file))
        known: dict[str, int] = {}

        def length(chunk: str) -> int:
            n = known.get(chunk)
            if n is None:
                if len(known) >= encode.MEMORY_WORDS:
                    known.clear()
                n = known[chunk] = sum(len(encode.merge(exact, p)) for p in pieces.split_text(chunk))
            return n

        for batch, texts in pieces.slices(batches, "text"):
            counts = [sum(map(length, pieces.chunks(t))) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    each = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
    return each.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"))
