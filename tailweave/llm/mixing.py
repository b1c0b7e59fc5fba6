"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served again from the start for a second and a
third pass.  A document's virtual finish time in a pass is its source's cumulative words up to its end, divided by the
source's target.  The mix is the order of virtual finish times over all sources, cut off at the total budget: documents
are served whole, but for the one in which the budget ends.  So a source misses its target by less than its document
at the cut.

Scale: shuffled orders are cut into ranges of a hash, and virtual time into RANGES equal ranges.  Since all
sources together serve the budget evenly over virtual time, those ranges hold about equal shares.  Prefix
sums run over range totals; only the range where the budget ends is split further, and only its last
split, of at most SORTED rows, is sorted by itself.  Rows alike in id, source and size are one entry with a count until
their order is known, so an id of many rows is no single task's burden.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, require_bound, stored

PASSES = 3
RANGES, SORTED = 4096, 50_000
MOST_SOURCES = 100_000
#: Rows alike that one task writes out in a go.
ALIKE = 4096
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Source:
    rank: int
    name: str | None
    size: int
    target: float


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> list[Source]:
    """Share the sum of sizes by weight; what a source can't take (passes times its size) is shared by the others."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    rest, open_ = sum(sizes.values()), set(names)
    given: dict[str | None, float] = {}
    while open_:
        total = sum(weight[n] for n in open_)
        full = {n for n in open_ if rest * weight[n] > passes * sizes[n] * total}
        if not full:
            given |= {n: (rest * weight[n]) / total for n in open_}
            break
        given |= {n: float(passes * sizes[n]) for n in full}
        rest -= sum(passes * sizes[n] for n in full)
        open_ -= full
    return [Source(k, n, sizes[n], given[n]) for k, n in enumerate(names)]


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of df: id, source, size, source_size, target, taken, virtual_finish (of its last pass that counts; null: none).

    Null and empty texts have size 0 and take nothing; very long ones count whole.  A null source is a source of its own.
    Repeated rows are documents of their own.  Reruns agree: order comes from a hash of seed and id, then id and size; ties
    in virtual finish go to the source first by code point.  An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    named = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    rows = stored(named.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"), F.max("n").alias("most")).limit(MOST_SOURCES + 1).collect()
    require_bound(len(by_source), MOST_SOURCES, "sources")
    sources = targets({r["source"]: r["size"] for r in by_source}, weights)
    budget, n = sum(s.size for s in sources), sum(r["n"] for r in by_source)
    known = spark.createDataFrame([(s.rank, s.name, s.size, s.target) for s in sources], "rank int, source string, source_size long, target double")
    rows = rows.join(F.broadcast(known), rows["source"].eqNullSafe(known["source"])).drop(known["source"])  # at most MOST_SOURCES rows

    # cumulative words before each document: ranges of the hash, then inside a range
    bits = max(4, (max(1, n).bit_length() + 1) // 2)  # about as many ranges as rows in a range
    rows = rows.withColumn("h", h).withColumn("range", F.shiftright("h", 60 - bits)).withColumn("words", F.col("size") * F.col("n"))
    totals = rows.groupBy("rank", "range").agg(F.sum("words").alias("words"))
    before = totals.withColumn("base", F.sum("words").over(Window.partitionBy("rank").orderBy("range")) - F.col("words")).drop("words")
    own = Window.partitionBy("rank", "range").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("words").over(own)).join(before, ["rank", "range"])
    rows = rows.withColumn("start", F.col("base") + F.col("upto") - F.col("words")).drop("base", "upto", "range", "words")
    # rows alike stand one after the other, in any order
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {ALIKE}"))))
    if max((r["most"] for r in by_source), default=0) > ALIKE:
        rows = rows.repartition("h", "k")
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("k") * ALIKE, F.least(F.col("n"), (F.col("k") + 1) * ALIKE) - 1)))
    rows = rows.withColumn("start", F.col("start") + F.col("k") * F.col("size")).drop("k", "n", "h")

    # a document is served once a pass
    parts = F.array(*[F.struct(((F.col("start") + F.col("size") + p * F.col("source_size")) / F.col("target")).alias("finish"), F.col("size").alias("words")) for p in range(PASSES)])
    parts = F.when((F.col("size") > 0) & (F.col("target") > 0), parts).otherwise(F.array().cast("array<struct<finish:double,words:bigint>>"))
    rows = stored(rows.withColumn("parts", parts), "mix-parts")

    # where the budget ends in the order of (finish, rank)
    served = rows.select("rank", F.inline("parts"))
    low, high, done = 0.0, 2.0, 0
    finish, rank, last_words = (float("inf"), -1, 0) if not budget else (None, None, None)
    while finish is None:
        place = F.least(F.floor((F.col("finish") - low) / ((high - low) / RANGES)), F.lit(RANGES - 1))
        inner = F.col("finish").between(low, high)
        ranges = served.where(inner).groupBy(place.alias("k")).agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("finish").alias("a"), F.max("finish").alias("b")).orderBy("k").collect()  # at most RANGES rows
        for r in ranges:
            if done + r["words"] >= budget:
                break
            done += r["words"]
        else:  # the budget ends later than twice the time that all targets take: few documents, long against the targets
            low, high = served.where(F.col("finish") > high).agg(F.min("finish"), F.max("finish")).first()
            high = max(high, low + 1)
            continue
        if r["n"] <= SORTED or r["a"] == r["b"]:
            for x in sorted(served.where(F.col("finish").between(r["a"], r["b"])).collect(), key=lambda x: (x["finish"], x["rank"])):
                if done + x["words"] >= budget:
                    finish, rank, last_words = x["finish"], x["rank"], budget - done
                    break
                done += x["words"]
        else:
            low, high = r["a"], r["b"]
    took = lambda x: (
        F.when((x["finish"] < finish) | ((x["finish"] == finish) & (F.col("rank") < rank)), x["words"])
        .when((x["finish"] == finish) & (F.col("rank") == rank), F.lit(last_words).cast("long")).otherwise(F.lit(0).cast("long"))
    )
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + took(x))
    end = F.array_max(F.transform(F.filter("parts", lambda x: took(x) > 0), lambda x: x["finish"]))
    return rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), end.alias("virtual_finish"))
