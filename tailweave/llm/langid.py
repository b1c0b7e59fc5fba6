"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every (language, bucket) are summed by Spark; the log-probability matrix (buckets x languages,
both bounded) is broadcast and whole texts are scored in numpy, sparse row by sparse row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, require_bound
from .textarrays import arrow_map, slices, text_array

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
MOST_LANGUAGES = 200
UNDETERMINED = "und"
#: Bytes of text handled at a time, for up to four languages; each byte takes some 60 bytes of arrays.
SLICE = 512 << 10


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n: the bucket of the n-gram at each character (BUCKETS where it would leave its text); offsets in characters."""
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    c = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    left = np.repeat(at[1:], np.diff(at)).astype(np.int32) - np.arange(len(c), dtype=np.int32)  # characters up to the text's end
    out, rolled = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        rolled *= np.uint32(0x01000193)
        rolled += np.uint32(1)
        rolled[: max(0, len(c) - n + 1)] += c[n - 1 :]
        if n in GRAMS:
            x = rolled + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            x *= np.uint32(0x297A2D39)
            bucket = (x >> np.uint32(16)).astype(np.int32)
            bucket[left < n] = BUCKETS
            out.append(bucket)
    return out, at


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: (BUCKETS + 1, languages); the last row, of n-grams that would leave their text, is 0.
    log_probability: np.ndarray
    log_prior: np.ndarray


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 10_000, smoothing: float = 0.1) -> LanguageModel:
    """Learn from the rows of df whose language is not null.

    Of each language about ``per_language`` rows count (all, if it has no more), chosen by a hash of the id.
    """
    known = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = known.select("lang").groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    require_bound(len(sizes), MOST_LANGUAGES, "languages")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    total = {r["lang"]: r["count"] for r in sizes}
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / total[lang]))])
    chosen = known.where((F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1_000_000)) / 1e6) < F.element_at(share, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, _, data, offsets in slices(batch.column(0), SLICE, pc.utf8_lower):
                buckets, at = gram_buckets(data, offsets)
                for d in range(len(offsets) - 1):
                    own = sums.setdefault(langs[first + d], np.zeros(BUCKETS + 1, np.int64))
                    for b in buckets:
                        np.add.at(own, b[at[d] : at[d + 1]], 1) if at[d + 1] - at[d] < 4096 else own.__iadd__(np.bincount(b[at[d] : at[d + 1]], minlength=BUCKETS + 1))
        for lang, own in sums.items():
            full = np.flatnonzero(own[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(own[full])], names=["lang", "bucket", "n"])

    table = chosen.select("text", "lang").transform(arrow_map, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x BUCKETS rows
    counts = np.zeros((BUCKETS + 1, len(languages)))
    column = {lang: k for k, lang in enumerate(languages)}
    counts[table["bucket"].to_numpy(), [column[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    counts[:BUCKETS] += smoothing
    logs = np.log(np.maximum(counts, 1e-300)) - np.log(counts[:BUCKETS].sum(axis=0))
    logs[BUCKETS] = 0
    seen = np.array([total[lang] for lang in languages], float)
    return LanguageModel(languages, logs.astype(np.float32), np.log(seen / seen.sum()))


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: id, lang_pred, score (posterior probability).

    Null texts, texts without a letter and, if nothing was learned, all texts are ``und`` with score 0.
    Ties go to the language first in code point order.  Very long texts are read whole; ids, null ones too, only pass through;
    repeated rows each get their row; an empty table gives none; other columns are not read, whatever their names.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_predicted(batch.column(1), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).transform(arrow_map, run, f"`id` {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def _predicted(column: pa.Array, m: LanguageModel) -> Iterator[tuple[str, float]]:
    """(language, posterior) of each text."""
    for first, end, data, offsets in slices(column, SLICE * 4 // max(4, len(m.languages)) + 1, pc.utf8_lower):
        n = end - first
        lettered = [any(map(str.isalpha, t)) and bool(m.languages) for t in text_array(column.slice(first, n)).to_pylist()]
        logs = np.tile(m.log_prior, (n, 1))
        if not m.languages:
            yield from [(UNDETERMINED, 0.0)] * n
            continue
        if len(data):
            buckets, at = gram_buckets(data, offsets)
            full = np.flatnonzero(np.diff(at))
            for b in buckets:
                logs[full] += np.add.reduceat(m.log_probability[b], at[full], axis=0, dtype=np.float64)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for ok, k, p in zip(lettered, logs.argmax(axis=1).tolist(), score.tolist(), strict=True):
            yield (m.languages[k], p) if ok else (UNDETERMINED, 0.0)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(remainder("doc_id", 5) != 0)


def keep_identified(df: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df whose predicted language is not ``und`` and has probability ``least`` at least; all columns stay, whatever their names.

    Null, empty and letterless texts are ``und``; very long ones are read whole; ties go to the first language by code point; null ids
    and repeated rows are judged by their text.  An empty table stays empty, and a model that learned nothing keeps no row.
    Batches pass through whole and are filtered where they are scored, so nothing is joined or shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [score >= least and lang != UNDETERMINED for lang, score in _predicted(batch.column(at), shared.value)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.transform(arrow_map, run, df.schema)
