"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, source mix.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last give the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tailweave.llm import decontam, langid, mixing, neardup, pii
from tailweave.llm.common import marked_ids, stored, table, unused

#: Languages are rejected where none can be told, or where the best one is less likely than this.
LEAST_LIKELY = 0.5
#: Documents are near duplicates from this similarity of their word shingles on, in percent.
ALIKE = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: not ``und``, with probability LEAST_LIKELY at least.

    The model is learned from the labelled rows of docs; without one, nothing is told and no row stays.  Null, empty and
    letterless texts are ``und``; very long ones are read whole; ties go to the first language by code point.  Null ids
    and repeated rows are judged by their text, each for itself.  An empty table stays empty, and all columns stay as they are.
    """
    return langid.keep_identified(docs, langid.train(langid.training_rows(docs)), LEAST_LIKELY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the least id (null last).

    Of rows that repeat id and text one stays; different texts under one id stay unless they are alike.  Texts without words are
    like nothing and stay; very long ones are read whole.  An empty table stays empty, and all columns stay as they are.
    """
    return neardup.without_duplicates(docs, percent=ALIKE)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none; very long ones are searched whole.  Rows with null ids stay only if their text holds none, and repeated
    rows and different texts under one id are judged each for itself.  Empty tables on either side change nothing; all columns stay as they are.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms; n_chars follows the new text.

    Null texts stay null; very long ones are read whole.  All rows stay, with null or repeated ids too, and rows alike change alike.  An empty
    table stays empty; all other columns stay as they are.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of: all columns of docs, then size, source_size, target, taken (repeats counted), virtual_finish.

    Null and empty texts are never taken; very long ones count whole; a null source is a source of its own.  Rows of one id, source and
    size have each its own share, the larger ones first by a hash of the text.  An empty table stays empty.  Columns that have the
    names of results keep them, and the results get an underscore more.
    """
    mix = stored(mixing.mix_sources(docs), "mix")
    names = unused(docs, "size", "source_size", "target", "taken", "virtual_finish", "__id", "__source", "__k", "__may", "__key")
    size, source_size, target, taken, finish, id_, source, k, may, key = names
    keys = [id_, source, size]
    every = mix.select(F.col("doc_id").alias(id_), F.col("source").alias(source), *[F.col(a).alias(b) for a, b in zip(("size", "source_size", "target", "taken", "virtual_finish"), names, strict=False)])
    shares = every.where(F.col(taken) > 0)
    own = docs.withColumn(size, mixing.word_count(F.col("text")))

    def joined(rows: DataFrame, shares: DataFrame, *more: str) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(shares[id_]) & rows["source"].eqNullSafe(shares[source]) & (rows[size] == shares[size])
        for c in more:
            same = same & (rows[c] == shares[c])
        out = rows.join(shares.hint("shuffle_hash"), same)
        return out.select(*[rows[c] for c in docs.columns], rows[size], *[shares[c] for c in (source_size, target, taken, finish)])

    again = every.where(F.col(size) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias(k)).where(F.col(k) > 1).select(F.xxhash64(*keys).alias("id"))
    again = stored(again.distinct(), "mix-again")
    n = again.count()
    if not n:
        return joined(own, shares)
    # rows of one id, source and size: shares are dealt out by number
    marked = marked_ids(own.withColumn(key, F.xxhash64("doc_id", "source", size)), again, n, key, may)
    told = marked_ids(shares.withColumn(key, F.xxhash64(*keys)), again, n, key, may)
    here = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"), "text")
    there = Window.partitionBy(*keys).orderBy(F.desc(taken), F.desc(finish))
    twice = joined(marked.where(F.col(may)).withColumn(k, F.row_number().over(here)), told.where(F.col(may)).withColumn(k, F.row_number().over(there)), k)
    return joined(marked.where(~F.col(may)), told.where(~F.col(may))).unionAll(twice)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: Learned language models, sketches and projections are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
