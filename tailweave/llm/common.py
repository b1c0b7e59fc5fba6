"""What the operators share: stored intermediate tables, bounds, id maps, and reading the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.heavy import met
from ..storage import stored

__all__ = ["LETTERS", "MAP_BITS", "WORD", "ascii_lower", "marked_ids", "met", "remainder", "require_bound", "stored", "table", "unused", "without_ids"]

#: Characters that end a word: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Capital and small letters that fold: A to Z only.
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, by: int):
    """crc32 of the id as text, modulo by; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and no other letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, *LETTERS))


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores after it as keep it from clashing with a column of df."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def require_bound(n: int, most: int, what: str) -> None:
    if n > most:
        raise ValueError(f"{what}: {n} exceeds the documented bound of {most}")


#: Bits of the map of ids that may be meant; once it is full, more rows than needed are looked at closely.
MAP_BITS = 1 << 28


def marked_ids(docs: DataFrame, ids: DataFrame, n: int, id_col: str = "doc_id", name: str = "__may") -> DataFrame:
    """docs with a boolean column: may the row's id be among ids (column ``id``, n rows)?  True for all that are.

    A map of hashed ids, at most MAP_BITS, is broadcast in pieces of 4 KB; no row of docs moves.
    """
    bits = min(MAP_BITS, max(1 << 15, 1 << (32 * n).bit_length()))
    place, bucket, map_ = unused(docs, "__place", "__bucket", "__map")

    def hashed(column: str):
        return F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(bits))

    maps = ids.select(hashed("id").alias(place)).select(F.expr(f"`{place}` div 32768").alias(bucket), F.expr(f"`{place}` % 32768").alias(place))
    maps = maps.groupBy(bucket).agg(F.bitmap_construct_agg(place).alias(map_))
    marked = docs.withColumn(place, hashed(id_col)).withColumn(bucket, F.expr(f"`{place}` div 32768")).join(F.broadcast(maps), bucket, "left")  # at most MAP_BITS
    byte = F.conv(F.hex(F.expr(f"substring(`{map_}`, cast(`{place}` % 32768 as int) div 8 + 1, 1)")), 16, 10).cast("int")
    return marked.withColumn(map_, byte).select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.expr(f"shiftright(`{map_}`, cast(`{place}` % 8 as int)) & 1 = 1"), F.lit(False)).alias(name))


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not among ids (column ``id``, distinct).  Only rows that the map marks are joined; null ids stay."""
    may, own = unused(docs, "__may", "__id")
    marked = marked_ids(docs, ids, ids.count(), id_col, may)
    some = marked.where(F.col(may)).join(ids.select(F.col("id").alias(own)), F.col(f"`{id_col}`") == F.col(own), "left_anti")
    return marked.where(~F.col(may)).unionAll(some).select(*[F.col(f"`{c}`") for c in docs.columns])
