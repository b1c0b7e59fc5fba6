import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailweave.llm import lmscore

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOW)) + [None]


def base(texts, learned):
    c = Counter(t for x in learned for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return [(len(tokens(x)), sum(t in c for t in tokens(x)), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for x in texts]


def model_score(text, learned):
    """The same estimates from exact dictionaries of quantised counts."""
    single, pair = Counter(), Counter()
    for x in learned:
        t = tokens(x)
        single.update(t)
        pair.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(single.values()), len(single)
    middle = lambda c: 0.0 if not c else (2 ** (c.bit_length() - 1) + 2 ** c.bit_length() - 1) / 2
    weight = min(0.9, sum(c - 1 for c in pair.values()) / n)
    t, total = tokens(text), 0.0
    for a, b in zip([None, *t[:-1]], t, strict=True):
        before, alone = middle(single[a]), (middle(single[b]) + 0.1) / (n + 0.1 * (v + 1))
        joint = min(middle(pair[a, b]), before) / max(before, 1)
        total += math.log10(weight * joint + (1 - weight) * alone if before else alone)
    return total


def texts(rng, n=120):
    return [" ".join(rng.choice(["the", "The", "of", f"w{rng.randint(0, 60)}", f"r{rng.randint(0, 5000)}"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("hot,flush", [(lmscore.HOT_WORDS, lmscore.FLUSH), (20, 100)])
def test_like_brute_force(spark, rng, monkeypatch, hot, flush):
    monkeypatch.setattr(lmscore, "HOT_WORDS", hot)
    monkeypatch.setattr(lmscore, "FLUSH", flush)
    monkeypatch.setattr(lmscore, "BITS", 400)  # false positives become too rare to matter here
    t = texts(rng) + [None, "", "only new wordzz"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lmscore.language_scores(df, df.where("doc_id < 100")).collect()}
    learned = t[:100]
    for k, (x, want) in enumerate(zip(t, base(t, learned), strict=True)):
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], abs=1e-8)
        assert r["score"] == pytest.approx(model_score(x, learned), abs=1e-6)


def test_filter_misses_nothing_and_seldom_errs(spark, rng):
    counts = {rng.randrange(2**63): rng.choice([1, 2, 3, 7, 100, 5000]) for _ in range(20_000)}
    grams = spark.createDataFrame(list(counts.items()), "gram long, n long").repartition(3)
    made = lmscore.filter_segments(lmscore._gram_blobs(grams, 7), 3).cache()
    assert made.agg(F.sum("grams"), F.sum("again")).first() == (len(counts), sum(counts.values()) - len(counts))
    (end, part), = lmscore.broadcast_parts(made, 7)
    q = lmscore.level(np.array(list(counts.values())))
    found = part.value.levels(np.array(list(counts), np.uint64))
    assert end == 7 and len(part.value.bits) * 8 <= q.sum() * lmscore.BITS + 7 * 64
    assert (found >= q).all() and (found == q).mean() > 0.98
    absent = np.array([rng.randrange(2**63) for _ in range(20_000)], np.uint64)
    assert (part.value.levels(absent) > 0).mean() < 0.03
    assert lmscore.level(np.array([1, 2, 3, 4, 7, 8])).tolist() == [1, 2, 2, 3, 3, 4]
    assert lmscore.count_of(np.array([0, 1, 2, 3])).tolist() == [0, 1, 2.5, 5.5]


def test_probabilities_keep_the_mass_of_pairs_seen_once(spark, rng, monkeypatch):
    """After a word of the training texts, all its followers' shares add up to the pair estimate's weight: none is left out."""
    monkeypatch.setattr(lmscore, "BITS", 400)
    t = ["a b", "a c", "a d", "b a"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lmscore.language_scores(df, df).collect()}
    assert all(got[k] == pytest.approx(model_score(x, t), abs=1e-6) for k, x in enumerate(t))


def test_equal_counts_score_alike_in_a_corpus_of_any_size(spark, rng, monkeypatch):
    """More segments, smaller flushes, other partitions: the same levels, so the same scores."""
    monkeypatch.setattr(lmscore, "BITS", 400)
    t = texts(rng)
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in lmscore.language_scores(df, df, segments=1).collect()}
    monkeypatch.setattr(lmscore, "FLUSH", 70)
    got = {r["doc_id"]: r["score"] for r in lmscore.language_scores(df.repartition(7), df.repartition(5), segments=900).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


@pytest.mark.parametrize("held", [lmscore.HELD, 50])
@pytest.mark.parametrize("most", [lmscore.MOST_BROADCAST, 0])
def test_a_filter_of_many_parts_or_one_that_stays_scores_like_one(spark, rng, monkeypatch, held, most):
    monkeypatch.setattr(lmscore, "MOST_BYTES", 1000)
    monkeypatch.setattr(lmscore, "MOST_BROADCAST", most)
    monkeypatch.setattr(lmscore, "BITS", 400)
    monkeypatch.setattr(lmscore, "HELD", held)
    t = [*texts(rng), None, "", "only new wordzz"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lmscore.language_scores(df, df.where("doc_id < 100")).collect()}
    assert len(got) == len(t)
    assert all(got[k]["score"] == pytest.approx(model_score(x, t[:100]), abs=1e-6) for k, x in enumerate(t))
    assert all(got[k]["base_score"] == pytest.approx(w[3], abs=1e-8) for k, w in enumerate(base(t, t[:100])))


@pytest.mark.parametrize("most", [lmscore.MOST_BROADCAST, 0])
def test_awkward_rows(awkward, clashing, nothing, monkeypatch, most):
    monkeypatch.setattr(lmscore, "MOST_BROADCAST", most)
    for docs in (awkward, clashing):
        got = lmscore.language_scores(docs, docs).collect()
        t = [r["text"] for r in docs.collect()]
        want = sorted((a, b, c, round(s, 6)) for a, b, c, s in base(t, t))
        assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert lmscore.language_scores(nothing, awkward).count() == 0
    unlearned = lmscore.language_scores(awkward, awkward.where(F.lit(False))).collect()
    assert all(r["n_known"] == 0 == r["train_tokens"] and r["score"] <= 0 for r in unlearned) and len(unlearned) == awkward.count()
