"""Lines that several documents share: all copies but those of the smallest document go.

Lines are exploded, normalised and hashed to 128 bits; a grouped aggregate, summed up before the shuffle, counts the documents of
each hash.  Only lines whose hash may be repeated (a broadcast map of hashed keys says so) meet those counts, and
only texts that lose a line meet their dropped positions, from which they are put together again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, marked_ids, met, stored, unused

#: What is stripped from both ends of a line before it is compared.
BLANKS = " \t\n\x0b\f\r"


def line_list(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(df: DataFrame, id_col: str, text_col: str, least_length: int) -> DataFrame:
    """(id, text_hash, at, h1, h2) of the lines whose key has least_length code points at least; at counts from 0."""
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.posexplode(line_list(F.col(f"`{text_col}`"))).alias("at", "line"))
    keys = own.select("id", "text_hash", "at", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_length)
    return keys.select("id", "text_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(lines: DataFrame, least_documents: int = 2) -> DataFrame:
    """(h1, h2, first, n): hashes found in at least least_documents documents, their smallest id, and their lines.

    Rows without id are one document, after all others.
    """
    if least_documents == 2:  # the smallest and the largest id tell
        found = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
        return found.where((F.col("first") != F.col("last")) | (F.col("first").isNotNull() & F.col("nameless"))).select("h1", "h2", "first", "n")
    each = lines.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))
    return found.where(F.col("documents") >= least_documents).select("h1", "h2", "first", "n")


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 10, least_documents: int = 2) -> DataFrame:
    """(id, text_hash, dropped): for each text that loses lines, the distinct positions of those, from 0."""
    lines = line_hashes(df, id_col, text_col, least_length)
    again = stored(repeated_lines(lines, least_documents), "repeated-lines")
    n, total = again.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    some = marked_ids(lines, again.select(F.col("h1").alias("id")), n, "h1", "may").where("may").drop("may")
    lost = met(some, again, ["h1", "h2"], "n", total).where(~F.col("id").eqNullSafe(F.col("first")))
    return lost.groupBy("id", "text_hash").agg(F.collect_set("at").alias("dropped"))  # at most a text's lines


def without_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 10, least_documents: int = 2) -> DataFrame:
    """df with lines dropped from its texts, then n_lines (before) and n_dropped; a name that is taken gets an underscore more.

    A line's key is the line without blanks at its ends, A-Z lower-cased.  Keys of at least least_length code points that stand in at
    least least_documents documents lose all their lines but those of the smallest id (rows without id are one document, the last).
    Null and empty texts are one empty line: empty texts stay, and null ones become empty.  Texts are read whole, whatever their length.  A key that
    one document repeats is no reason to drop it, and repeated rows of one id and text change alike.  All columns and rows stay; an empty table stays empty.
    """
    n_lines, n_dropped, may, own, hash_, dropped, own_hash = unused(df, "n_lines", "n_dropped", "__may", "__id", "__hash", "__dropped", "__text_hash")
    lost = stored(dropped_lines(df, id_col, text_col, least_length, least_documents), "dropped-lines")
    told = lost.select(F.col("id").alias(own), F.col("text_hash").alias(hash_), F.col("dropped").alias(dropped))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = df.withColumn(own_hash, F.xxhash64(F.col(f"`{text_col}`")))
    marked = marked_ids(keyed, lost.select(F.col("text_hash").alias("id")), lost.count(), own_hash, may)
    some = marked.where(F.col(may)).join(told, F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.col(own_hash) == F.col(hash_)), "left")
    whole = F.when(F.col(dropped).isNull(), text).otherwise(
        F.get(F.transform(F.array(line_list(text)), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped)), lambda at: F.get(lines, at)), "\n")), F.lit(0))
    )

    def columns(text: Column, lost: Column) -> list[Column]:
        return [*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns], F.size(line_list(F.col(f"`{text_col}`"))).cast("long").alias(n_lines), lost.cast("long").alias(n_dropped)]

    return marked.where(~F.col(may)).select(*columns(text, F.lit(0))).unionAll(some.select(*columns(whole, F.coalesce(F.size(dropped), F.lit(0)))))
