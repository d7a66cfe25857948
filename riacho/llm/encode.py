"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Frequent words, counted over all texts, are compiled with their ids into a minimal acyclic transducer that every worker
memory-maps; words outside it are merged exactly. Texts are never cut: batches are only cut between texts.
"""

from __future__ import annotations

import base64
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riacho.llm import lexicon, pieces
from riacho.scale import ensure_checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
#: Words in the transducer. It bounds memory only: other words are merged exactly.
LEXICON_WORDS = 65_536
#: Pieces a worker remembers before it starts anew.
MEMORY_WORDS = 500_000


def load_ranks(path: str):
    """tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pieces.PATTERN, mergeable_ranks=ranks, special_tokens={})


def merge(encoding, piece: str) -> list[int]:
    """Ids of one piece by exact merging."""
    return encoding._encode_single_piece(piece)


def ship(spark: SparkSession, path: str) -> str:
    """Makes a file of the driver readable by all workers; returns its name for SparkFiles."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def ship_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes ``data`` to the shared checkpoint folder and hands it to all workers."""
    folder = ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{uuid.uuid4().hex}.bin")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    spark.sparkContext.addFile(path.toString())
    return path.getName()


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): how often each piece occurs in all texts; counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: dict[str, list[str]] = {}
        for batch in batches:
            seen: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(pieces.chunks(t))
            out: Counter = Counter()
            for chunk, n in seen.items():
                if chunk not in split:
                    if len(split) >= MEMORY_WORDS:
                        split.clear()
                    split[chunk] = pieces.split_text(chunk)
                for p in split[chunk]:
                    out[p] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["piece", "n"])

    return df.select(text).mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces of all texts, ties by piece; ``words`` bounds what comes to the driver."""
    top = piece_counts(df, text).filter("length(piece) <= 64").orderBy(F.desc("n"), "piece").limit(words)
    return [r.piece for r in top.select("piece").collect()]


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids array<int>): ids of each whole text, without special tokens.

    Strings that look like special tokens are ordinary text. Empty and null texts have the empty list. Rows are kept as
    they are: repeated ones are encoded again, a null id stays null. Extra columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    encoding = load_ranks(ranks)
    file = ship_bytes(spark, "lexicon", lexicon.to_bytes(lexicon.compile_lexicon({w: merge(encoding, w) for w in frequent_words(rows, words=words)})))
    ranks_file = ship(spark, ranks)
    key = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.map_file(SparkFiles.get(file))
        exact = load_ranks(SparkFiles.get(ranks_file))
        known: dict[str, list[int]] = {}
        for batch, texts in pieces.slices(batches, "text"):
            ids, ends = encode_batch(lex, exact, known, [t or "" for t in texts])
            if len(known) > MEMORY_WORDS:
                known.clear()
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {key}, ids array<int>").withColumnRenamed("doc_id", doc_id)


def encode_batch(lex: dict[str, np.ndarray], encoding, known: dict[str, list[int]], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offset of each text's ids)."""
    cp, begins = pieces.code_points(texts)
    start, length = pieces.split_points(cp)
    number = lexicon.look_up(lex, cp, start, length)
    missing = np.flatnonzero(number < 0)
    # Ids of words outside the transducer are appended to its id list; each distinct word once.
    offsets, flat = lex["offsets"], lex["ids"]
    n_words = len(offsets) - 1
    extra: dict[str, int] = {}
    extra_ids: list[list[int]] = []
    for i in missing.tolist():
        s = start[i]
        word = cp[s : s + length[i]].tobytes().decode("utf-32-le", "surrogatepass")
        at = extra.get(word)
        if at is None:
            if word not in known:
                known[word] = merge(encoding, word)
            at = extra[word] = len(extra_ids)
            extra_ids.append(known[word])
        number[i] = n_words + at
    size = np.concatenate([np.diff(offsets), np.fromiter(map(len, extra_ids), np.int64, len(extra_ids))])
    begin = np.concatenate([[0], np.cumsum(size)])[:-1] if len(size) else np.zeros(0, np.int64)
    every = np.concatenate([flat, np.fromiter((i for e in extra_ids for i in e), np.int32)])
    n_ids = size[number]
    ends = np.cumsum(n_ids)
    total = int(ends[-1]) if len(ends) else 0
    ids = every[np.repeat(begin[number] - (ends - n_ids), n_ids) + np.arange(total)]
    piece_end = np.concatenate([[0], ends])
    return ids, piece_end[np.searchsorted(start, begins)]
