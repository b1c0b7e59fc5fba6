"""Quality: Bradley-Terry pairwise ranking.

Preference pairs (a document labelled 1 beats one labelled 0) are fitted by logistic loss on the
differences of their features; a document's score is its strength.  The score quantile that matches the
labelled share of class 0 becomes the decision limit, and strengths are mapped so that it lies at LIMIT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .textarrays import arrow_map, distinct, shingles, slices, word_hashes, word_spans

LIMIT = 0.3
#: Labelled rows of each class that the fit uses at most, and preference pairs drawn from them.
PER_CLASS, PAIRS = 8_000, 200_000

#: Classes of bytes whose shares are features.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"|", b"*#$%&", b"'\"()[]{}", b"<>/\\=_-+", b"@~^`"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _k
_CLASS[128:] = len(_CLASSES) + 1
WIDTH = 2 * (len(_CLASSES) + 2) + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, WIDTH): shares of byte classes and their roots, lengths, and how much words and word runs repeat."""
    n, kinds = len(offsets) - 1, len(_CLASSES) + 2
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n, dtype=np.int64) * kinds, size)
    owner += _CLASS[data]
    share = np.bincount(owner, minlength=n * kinds).reshape(n, kinds) / np.maximum(size, 1)[:, None]
    starts, first = word_spans(data, offsets)
    hashes, count = word_hashes(data, starts), np.diff(first)
    own = np.maximum(count, 1)
    varied = np.diff(distinct(hashes, first)[1]) / own
    pairs, bounds = shingles(hashes, first, 3)
    runs = np.diff(distinct(pairs, bounds)[1]) / np.maximum(np.diff(bounds), 1)
    capital = np.bincount(np.repeat(np.arange(n), count), weights=_CLASS[data[starts]] == 1, minlength=n) / own
    length = share[:, [0, 1, 2, *range(5, kinds)]].sum(axis=1) * size / own
    rest = [np.log1p(size), np.log1p(count), np.log1p(length), varied, varied * np.log1p(count), runs, capital, np.sqrt(capital), (count < 5).astype(float)]
    return np.column_stack([share, np.sqrt(share), *rest])


def feature_rows(df: DataFrame, extra: str | None = None) -> DataFrame:
    """id, text [, extra]: id [, extra], x (array of WIDTH doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column("text")):
                x = pa.FixedSizeListArray.from_arrays(pa.array(features(data, offsets).ravel()), WIDTH).cast(pa.list_(pa.float64()))
                names = ["id", *([extra] if extra else [])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in names), x], names=[*names, "x"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ["id", *([extra] if extra else [])])
    return df.transform(arrow_map, run, f"{kinds}, x array<double>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = ((x - self.mean) / self.scale) @ self.weight
        return 1 / (1 + np.exp(-np.clip(strength - self.threshold + np.log(LIMIT / (1 - LIMIT)), -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, share_worse: float, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 7) -> QualityModel:
    """Fit strengths by Newton steps on mean log(1 + exp(-w.(a - b))) + penalty |w|^2 / 2."""
    both = np.concatenate([better, worse])
    if not len(better) or not len(worse):
        return QualityModel(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale[scale < 1e-9] = 1
    a, b = (better - mean) / scale, (worse - mean) / scale
    rng = np.random.default_rng(seed)
    d = a[rng.integers(len(a), size=pairs)] - b[rng.integers(len(b), size=pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = -(d * p[:, None]).mean(axis=0) + penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    strength = np.concatenate([a @ w, b @ w])
    mass = np.concatenate([np.full(len(a), (1 - share_worse) / len(a)), np.full(len(b), share_worse / len(b))])
    order = np.argsort(strength, kind="stable")
    at = int(np.searchsorted(np.cumsum(mass[order]), share_worse - 1e-12))
    high = strength[order][min(at + 1, len(order) - 1)]
    return QualityModel(mean, scale, w, float((strength[order][at] + high) / 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learn from the labelled documents; of each class the ``per_class`` labels first by a hash of the id.

    The chosen ids (at most 2 x per_class) are broadcast; their features, of fixed width, come to the driver, one row a chosen id: of
    several texts under one id, the first by a hash of the text.  Labels other than 0 and 1, null ids and labels without a
    document are passed over; an id with both labels counts in both classes.  If a class is missing, all scores are LIMIT.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").distinct()
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    chosen = [marked.where(F.col("label") == k).orderBy(F.xxhash64(F.lit("quality"), "id"), "id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "id").withColumn("text", F.coalesce("text", F.lit("")))
    one = labelled.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("id", "label", "first.text")
    found = feature_rows(one, "label").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, WIDTH)
    label = found["label"].to_numpy().astype(int)
    order = np.lexsort((*x.T[::-1], label))  # the same rows in whatever order they came
    x, label = x[order], label[order]
    return bradley_terry(x[label == 1], x[label == 0], sizes.get(0, 0) / max(1, sum(sizes.values())))


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, score (0 to 1), predicted (score >= LIMIT).

    Null texts score as empty ones and very long ones are read whole; equal texts score alike, so repeated rows do.  Ids,
    null ones too, only pass through; an empty table gives no rows; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                score = shared.value.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(score), pa.array((score >= LIMIT).astype(np.int32))], names=["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).transform(arrow_map, run, f"`id` {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.where(remainder("doc_id", 5) != 0)
