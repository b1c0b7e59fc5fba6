import zlib

import numpy as np
from pyspark.sql import functions as F

from tailweave.llm import quality, queries


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = (label == 1).sum()
    return (rank[label == 1].sum() - p * (p + 1) / 2) / (p * (len(label) - p))


def test_pairwise_fit_recovers_the_order():
    rng = np.random.default_rng(1)
    w = rng.standard_normal(quality.WIDTH)
    x = rng.standard_normal((600, quality.WIDTH))
    label = (x @ w > np.quantile(x @ w, 0.3)).astype(int)
    model = quality.bradley_terry(x[label == 1], x[label == 0], 0.3)
    score = model.score(x)
    assert auc(score, label) > 0.999
    assert abs((score < quality.LIMIT).mean() - 0.3) < 0.02  # the limit is the quantile of class 0


def test_gradient_vanishes_at_the_fit():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((50, quality.WIDTH)) + 0.2, rng.standard_normal((50, quality.WIDTH))
    model = quality.bradley_terry(a, b, 0.5, pairs=4000, penalty=0.05)
    scaled = [(x - model.mean) / model.scale for x in (a, b)]
    draw = np.random.default_rng(7)
    d = scaled[0][draw.integers(50, size=4000)] - scaled[1][draw.integers(50, size=4000)]
    g = -(d / (1 + np.exp(d @ model.weight))[:, None]).mean(axis=0) + 0.05 * model.weight
    assert np.abs(g).max() < 1e-6


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op1_quality(spark, d)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = found.join(labels, "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.97
    assert (out.predicted == out.quality).mean() > 0.93
    assert found.count() == spark.read.parquet(f"{d}/documents.parquet").count()


def test_awkward_rows(spark, awkward, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (10, 0, 1), (7, 1, None), (None, 1, 0), (5, None, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(awkward, labels)
    for docs in (awkward, clashing):
        got = quality.quality_scores(docs, model).toPandas()
        assert len(got) == awkward.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= quality.LIMIT)).all()
    assert got[got.doc_id == 1].score.nunique() == 1
    assert quality.quality_scores(nothing, model).count() == 0
    empty = quality.train(nothing, labels.where(F.lit(False)))
    assert quality.quality_scores(awkward, empty).select("score").distinct().count() == 1


def plain_features(text):
    """The same numbers, counted byte by byte and word by word."""
    import math
    import re

    raw = (text or "").encode()
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"|", b"*#$%&", b"'\"()[]{}", b"<>/\\=_-+", b"@~^`"]
    n = max(1, len(raw))
    share = [sum(b in k for b in raw) / n for k in kinds]
    high = sum(b >= 128 for b in raw) / n
    share += [len(raw) / n - sum(share) - high, high]
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() for w in words]
    own = max(1, len(words))
    varied = len(set(low)) / own
    runs = [tuple(low[k : k + 3]) for k in range(max(1, len(low) - 2))] if low else []
    length = sum(len(w) for w in words) / own
    capital = sum(65 <= w[0] <= 90 for w in words) / own
    rest = [math.log1p(len(raw)), math.log1p(len(words)), math.log1p(length), varied, varied * math.log1p(len(words)), len(set(runs)) / max(1, len(runs)), capital, math.sqrt(capital), float(len(words) < 5)]
    return share + [math.sqrt(max(0, x)) for x in share] + rest


def test_features_like_plain_counts(rng, awkward):
    import pyarrow as pa

    from tailweave.llm.textarrays import slices

    pieces = ["Word", "word", "WORD", "é", "漢字", "😀", " ", "  ", "\n", "\t", ".", ",", "!", "|", "#", "(", "<", "@", "1", "99", "\x01", "a b a b a b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [r["text"] for r in awkward.select("text").collect()]
    got = np.concatenate([quality.features(data, offsets) for _, _, data, offsets in slices(pa.array(texts, pa.string()))])
    want = np.array([plain_features(t) for t in texts])
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-7)
