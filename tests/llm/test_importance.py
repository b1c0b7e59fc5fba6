import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tailweave.llm import importance

BIG = "".join(chr(c) for c in range(65, 91))


def words(text):
    low = (text or "").translate(str.maketrans(BIG, BIG.lower()))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def buckets(text, width=3):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, percent=5, least=20):
    s, t = [0] * 10_000, [0] * 10_000
    for _, text in rows:
        for b in buckets(text):
            s[b] += 1
    for text in target:
        for b in buckets(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + 10_000.0) / ((s[b] + 1.0) * (sum(t) + 10_000.0)))) for b in range(10_000)]
    out = []
    for id_, text in rows:
        h = int(hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets(text))
        out.append([id_, len(buckets(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def texts(spark):
    import random

    rng = random.Random(3)
    pool = [f"w{k}" for k in range(60)] + ["É", "naïve", "漢字", "A1", "B,c"]
    return [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for k in range(400)]


def test_like_brute_force(spark, texts):
    docs, target = spark.createDataFrame(texts, "doc_id long, text string"), ["w1 w2 w3 w4", "É naïve w5", None]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(importance.resample(docs, bench, percent=20)) == brute(texts, target, 20)


def test_ranks_run_through_ranges(spark, texts, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    docs, target = spark.createDataFrame(texts, "doc_id long, text string").repartition(5), ["w1 w2 w3 w4"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(importance.resample(docs, bench, percent=60)) == brute(texts, target, 60)
    assert got(importance.resample(docs, bench, percent=100)) == brute(texts, target, 100)


def test_awkward_rows(spark, awkward, clashing, nothing):
    target = spark.createDataFrame([(None,), ("",), ("the quick brown fox",)], "text string")
    want = brute([(r["doc_id"], r["text"]) for r in awkward.collect()], [None, "", "the quick brown fox"], 50, 1)
    for docs in (awkward, clashing):
        out = got(importance.resample(docs, target, percent=50, least_words=1))
        # rows of one id tie: which of them is drawn is open, so ranks are held as a set
        assert [r[:4] for r in out] == [r[:4] for r in want]
        assert sorted(r[4] for r in out if r[4]) == sorted(r[4] for r in want if r[4])
    assert importance.resample(nothing, target).count() == 0
    assert all(r[4] is None for r in got(importance.resample(awkward, nothing, percent=0)))


def test_drawn_keeps_columns(spark, clashing):
    ranks = importance.resample(clashing, clashing, percent=60, least_words=1)
    kept = importance.drawn(clashing, ranks)
    ids = {r["doc_id"] for r in ranks.where("rank is not null").collect()} - {None}
    assert kept.columns == clashing.columns and ids
    assert kept.count() == clashing.where(F.col("doc_id").isin(list(ids))).count()


def test_no_feature_is_shuffled(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    plan = importance.importance(docs, [0] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
