"""Filing index and corpus: index rows -> documents -> cleaned, chunked, deduplicated chunks, and their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riacho.functions import text as T
from riacho.operators import dedup
from riacho.scale import running


def column_like(df: DataFrame, part: str) -> str:
    """The first column whose name contains ``part``, case ignored."""
    for c in df.columns:
        if part.lower() in c.lower():
            return c
    raise ValueError(f"no column like {part!r} in {df.columns}")


def keep_categories(df: DataFrame, categories: list[str]) -> DataFrame:
    """Rows whose category (trimmed, lower case) is one of ``categories``; null categories go."""
    return df.filter(F.lower(F.trim(F.col(column_like(df, "categ")))).isin([c.lower() for c in categories]))


def index_documents(df: DataFrame, link: str, cnpj: str, date: str, subject: str, *order: Column) -> DataFrame:
    """One row per composite key of a filing index, the first in ``order``; adds doc_key, document_id and file_name.

    Rows without a link have no document and go.
    """
    rows = df.filter(F.trim(F.coalesce(F.col(link), F.lit(""))) != "")
    rows = rows.withColumn("doc_key", T.composite_key(F.col(link), F.col(cnpj), F.col(date), F.col(subject)))
    rows = rows.withColumn("document_id", T.short_hash(F.col("doc_key"))).withColumn("file_name", T.safe_name(F.col(cnpj), F.col(date), F.col(subject)))
    return dedup.first_wins(rows, [F.col("doc_key")], *order)


def extraction_quality(text: Column) -> Column:
    """struct(page_count, char_count, empty_pages, text_density, success, quality_flag) of an extracted text.

    Pages end with form feeds. Low quality: under 100 characters, more than half of the pages empty, or under 50
    characters a page.
    """
    pages = F.split(F.coalesce(text, F.lit("")), "\f")
    n = F.size(pages)
    chars = F.length(T.strip(F.coalesce(text, F.lit(""))))
    empty = F.size(F.filter(pages, lambda p: T.strip(p) == ""))
    density = F.round(chars / n, 2)
    success = chars > 0
    low = (chars < 100) | (empty / n > 0.5) | (density < 50) | ~success
    return F.struct(
        n.alias("page_count"), chars.alias("char_count"), empty.alias("empty_pages"), density.alias("text_density"),
        success.alias("success"), F.when(low, "low").otherwise("ok").alias("quality_flag"),
    )


def default_category(c: Column) -> Column:
    return F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit("unknown"))


def chunked(df: DataFrame, doc_id: str, text: str, size: int, overlap: int) -> DataFrame:
    """(doc_id, pos, chunk) of cleaned texts; texts that are empty after cleaning give no chunk."""
    cleaned = df.select(doc_id, T.clean(F.col(text)).alias("_t")).filter("_t != ''")
    return cleaned.select(doc_id, F.posexplode(T.chunks(F.col("_t"), size, overlap)).alias("pos", "chunk"))


def accepted(chunks: DataFrame, doc_id: str, least: int) -> DataFrame:
    """Chunks of at least ``least`` characters, the first of each content in (document, position)."""
    return dedup.first_wins(chunks.filter(F.length("chunk") >= least), [F.sha2("chunk", 256)], F.col(doc_id), F.col("pos"))


def accept_counts(chunks: DataFrame, least: int) -> DataFrame:
    """(reason, n): retained, duplicate_chunk and too_short. Short chunks are never remembered, so they are too short each time.

    A partial count per content comes first, so a chunk that a third of all documents repeat is no hot key.
    """
    per = chunks.groupBy(F.sha2("chunk", 256).alias("_h"), (F.length("chunk") < least).alias("_short")).agg(F.count(F.lit(1)).alias("_n"))
    out = per.agg(
        F.count(F.when(~F.col("_short"), 1)).alias("retained"),
        F.coalesce(F.sum(F.when(~F.col("_short"), F.col("_n") - 1)), F.lit(0)).alias("duplicate_chunk"),
        F.coalesce(F.sum(F.when(F.col("_short"), F.col("_n"))), F.lit(0)).alias("too_short"),
    )
    names = ("retained", "duplicate_chunk", "too_short")
    return out.select(F.explode(F.array(*(F.struct(F.lit(n).alias("reason"), F.col(n).cast("long").alias("n")) for n in names))).alias("x")).select("x.*")


def chunk_ids(chunks: DataFrame, doc_id: str) -> DataFrame:
    """``chunks`` with ``chunk_id``: the number of each chunk, dropped ones included, in (document, position)."""
    return running(chunks, [F.col(doc_id), F.col("pos")], name="chunk_id")


def token_stats(df: DataFrame, tokens: Column) -> DataFrame:
    """One row: total, mean, median, percentiles (linear, truncated), extremes and population deviation of a token count."""
    p = F.percentile(tokens, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    out = df.agg(F.count(tokens).alias("n"), F.sum(tokens).alias("total"), F.round(F.avg(tokens), 2).alias("mean"), p.alias("p"), F.min(tokens).alias("min"), F.max(tokens).alias("max"), F.round(F.stddev_pop(tokens), 4).alias("std"))
    at = {name: F.floor(F.round(F.col("p")[i], 6)).cast("long").alias(name) for i, name in enumerate(("median", "p90", "p95", "p99"))}
    return out.select("n", "total", "mean", *at.values(), "min", "max", "std")


def size_stats(df: DataFrame, text: Column) -> DataFrame:
    """One row: documents, characters, bytes, bytes per estimated token."""
    tokens = T.token_estimate(text)
    out = df.filter(text.isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(tokens).alias("tokens"))
    return out.withColumn("bytes_per_token", F.round(F.col("bytes") / F.col("tokens"), 6)).withColumn("avg_chars", F.round(F.col("chars") / F.col("n_docs"), 6))


def keyword_ratio(df: DataFrame, text: Column, word: str) -> DataFrame:
    hit = F.lower(text).contains(word.lower())
    return df.filter(text.isNotNull()).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(hit).alias("n_hits"), F.round(F.avg(hit.cast("int")), 6).alias("ratio"))


def verbatim_copies(df: DataFrame, text: Column) -> DataFrame:
    """(n_texts, n_copied, rate): contents that occur again, equal after white space and case are collapsed."""
    per = df.filter(T.strip(text) != "").groupBy(F.sha2(T.collapse(text), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_texts"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_copied"))
    return out.withColumn("rate", F.when(F.col("n_texts") > 0, F.round(F.col("n_copied") / F.col("n_texts"), 6)).otherwise(F.lit(0.0)))


def shares(df: DataFrame, category: Column, top: int = 10) -> DataFrame:
    """(category, n, share): the ``top`` most frequent categories, the rest as ``other``."""
    from pyspark.sql import Window

    counts = df.groupBy(default_category(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))  # small: one row per category
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "category"))
    named = counts.withColumn("category", F.when(rank <= top, F.col("category")).otherwise(F.lit("other")))
    out = named.groupBy("category").agg(F.sum("n").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
