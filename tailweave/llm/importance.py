"""Importance resampling towards a target text, over hashed runs of words.

No feature is ever a row when documents are scored: higher-order functions make each document's array of buckets, and its
weight is an aggregate of element_at over one literal array of gains.  Only bucket totals are shuffled, at most
``buckets`` rows a task.  Draws are Gumbel scores of a hash of the id, so reruns agree; ranks come from ranges of scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, marked_ids, stored, unused

#: Words: digits, letters a to z, and all beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, WIDTH = 10_000, 3
#: Ranked rows that one range holds, about; ranges at most.
RANGE_ROWS, MOST_RANGES = 50_000, 4096


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def run_buckets(words: Column, width: int = WIDTH, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to width words.  words: a lambda's variable or a column that is stored."""

    def runs(k: int) -> Column:
        def bucket(word: Column, at: Column) -> Column:
            parts = [word]
            for j in range(1, k):
                parts += [F.lit(" "), F.get(words, at + j)]
            return (F.crc32((F.concat(*parts) if k > 1 else word).cast("binary")) % buckets).cast("int")

        return F.transform(words if k == 1 else F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))), bucket)

    return F.concat(*[runs(k) for k in range(1, width + 1)])


def featured(text: Column, width: int = WIDTH, buckets: int = BUCKETS) -> Column:
    """struct(n_words, buckets) of a text; the words are made once, as the variable of a lambda."""
    return F.get(F.transform(F.array(word_list(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), run_buckets(w, width, buckets).alias("buckets"))), F.lit(0))


def bucket_totals(df: DataFrame, text_col: str = "text", width: int = WIDTH, buckets: int = BUCKETS) -> list[int]:
    """How many runs of all texts fall in each bucket: ``buckets`` numbers."""
    every = df.select(F.explode(featured(F.col(f"`{text_col}`"), width, buckets)["buckets"]).alias("bucket"))
    found = [0] * buckets
    for bucket, n in every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``buckets`` rows
        found[bucket] = n
    return found


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of how much likelier a bucket is in the target, each count raised by one."""
    all_source, all_target = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source, target, strict=True)]


def gumbel(id_col: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(df: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", seed: int = 42, width: int = WIDTH) -> DataFrame:
    """Per row of df: id, n_words, n_features, weight, score."""
    each = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded to one literal
    own = df.select(F.col(f"`{id_col}`").alias("id"), featured(F.col(f"`{text_col}`"), width, len(gain)).alias("f"))
    weight = F.aggregate("f.buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.element_at(each, b + 1))
    out = own.select("id", "f.n_words", F.size("f.buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("id"), seed)).alias("score"))


def ranked(scored: DataFrame, most: int, of: int, id_col: str = "doc_id") -> DataFrame:
    """scored (a stored table) with rank: 1 for the highest score among the ``of`` rows that ``may`` be drawn, up to ``most``; else null.

    Ties go to the smaller id, null first.  Cut points of scores make ranges of about RANGE_ROWS rows; the ranges that hold
    the first ``most`` rows are sorted, each by itself, and start where the totals of those above end.
    """
    from pyspark.ml.feature import Bucketizer

    none = F.lit(None).cast("long").alias("rank")
    kept = [c for c in scored.columns if c != "may"]
    if not most:
        return scored.select(*kept, none)
    pieces = min(MOST_RANGES, 1 + most // RANGE_ROWS)
    shares = sorted({max(0.0, 1 - most / of * k / pieces) for k in range(1, pieces + 2)})
    may = scored.where("may").withColumn("__score", F.col("score").cast("double"))
    cuts = may.agg(F.percentile_approx("__score", shares, 10_000 + 100 * pieces * of // max(most, 1))).first()[0]  # at most MOST_RANGES + 1 numbers
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    may = Bucketizer(splits=splits, inputCol="__score", outputCol="__range").transform(may)
    above, at = {}, 0
    for r, n in sorted(may.groupBy("__range").count().collect(), reverse=True):  # a row for each range
        above[int(r)], at = at, at + n
    last = min(r for r, n in above.items() if n < most)
    base = F.element_at(F.array(*[F.lit(above.get(r, 0)).cast("long") for r in range(len(splits) - 1)]), F.col("__range").cast("int") + 1)
    rank = base + F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("score"), F.col(f"`{id_col}`").asc_nulls_first()))
    top = may.where(F.col("__range") >= last).select(*kept, rank.alias("rank")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return scored.where("not may").select(*kept, none).unionAll(may.where(F.col("__range") < last).select(*kept, none)).unionAll(top)


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Per row of df: id, n_words, n_features, weight, score, rank (1, 2, ... for those drawn, else null).

    Of the N rows with at least least_words words, floor(percent * N / 100) of the highest scores are drawn.  Null and empty texts have no
    words: weight 0, never drawn unless least_words is 0.  Very long texts are read whole.  Null ids count as the empty text in
    the hash.  Repeated rows are rows of their own, with equal scores; ties go to the smaller id (null first).  An empty
    table gives no rows, an empty target lets every gain follow from the corpus alone.  Other columns are not read, whatever their names.
    """
    gain = gains(bucket_totals(df, text_col, width, buckets), bucket_totals(target, target_col, width, buckets))
    scored = importance(df, gain, id_col, text_col, seed, width)
    scored = stored(scored.withColumn("may", F.col("n_words") >= least_words), "importance")
    n = scored.where("may").count()
    return ranked(scored, percent * n // 100, n, id_col)


def drawn(df: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id has a rank (nulls never); all columns stay.  Only rows that a map of hashed ids marks are joined."""
    ids = ranks.where(F.col("rank").isNotNull()).select(F.col(id_col).alias("id")).where("id is not null").distinct()
    may, own = unused(df, "__may", "__id")
    marked = marked_ids(df, ids, ids.count(), id_col, may).where(F.col(may))
    return marked.join(ids.select(F.col("id").alias(own)), F.col(f"`{id_col}`") == F.col(own), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
