import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tailweave.llm import langid, queries
from tailweave.llm.textarrays import slices


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = queries.op7_language(spark, d).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.99 and out.score.between(0, 1).all()


def grams(text):
    c = [ord(x) for x in text]
    return [tuple(c[k : k + n]) for n in langid.GRAMS for k in range(len(c) - n + 1)]


def test_buckets_are_those_of_each_texts_own_grams():
    texts = ["abc", "", "a", "äß漢😀x", "ab"]
    for _, _, data, offsets in slices(pa.array(texts)):
        buckets, at = langid.gram_buckets(data, offsets)
    for k, t in enumerate(texts):
        own = np.concatenate([b[at[k] : at[k + 1]] for b in buckets])
        assert (own < langid.BUCKETS).sum() == len(grams(t))
    alone, end = langid.gram_buckets(np.frombuffer(b"ab", np.uint8), np.array([0, 2]))
    assert [sorted(b[at[4] : at[5]]) for b in buckets] == [sorted(b[: end[1]]) for b in alone]


def test_posterior_like_brute_force(spark, rng):
    letters = {"x": "abcd", "y": "cdef", "z": "efgh"}
    rows = [(k, "".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 12))), lang) for k, lang in enumerate([*letters] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    count, seen = defaultdict(Counter), Counter(r[2] for r in rows)
    for _, t, lang in rows:
        count[lang].update(grams(t))
    for t, got, score in [(r["text"], r["lang_pred"], r["score"]) for r in df.join(langid.predict(df, model), "doc_id").collect()]:
        logs = {}
        for lang in letters:
            total = sum(count[lang].values()) + 0.1 * langid.BUCKETS
            logs[lang] = np.log(seen[lang] / len(rows)) + sum(np.log((count[lang][g] + 0.1) / total) for g in grams(t))
        p = np.exp(np.array(list(logs.values())) - max(logs.values()))
        assert abs(score - p.max() / p.sum()) < 1e-4 and got in letters
        if p.max() / p.sum() > 0.6:
            assert got == max(logs, key=logs.get)


def test_awkward_rows(awkward, clashing, nothing):
    model = langid.train(awkward)
    assert model.languages == ["de", "en", "es", "fr"]
    for docs in (awkward, clashing):
        got = langid.predict(docs, model).toPandas()
        assert len(got) == awkward.count() and got.score.between(0, 1).all()
        assert (got[got.doc_id.isin([2, 3, 4, 8, 9])].lang_pred == "und").all() and (got[got.doc_id == 7].lang_pred != "und").all()
        kept = langid.keep_identified(docs, model, 0.0)
        assert kept.columns == docs.columns and kept.count() == (got.lang_pred != "und").sum()
    empty = langid.train(nothing)
    assert langid.predict(awkward, empty).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.predict(nothing, model).count() == 0 == langid.keep_identified(nothing, model, 0.5).count()
    assert langid.train(awkward.where(F.col("lang") == "en")).languages == ["en"]


def test_sample_is_bounded_and_stable(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 10 = 0, 'b', 'a') as lang")
    one, two = langid.train(df, per_language=200), langid.train(df.repartition(7), per_language=200)
    assert np.array_equal(one.log_probability, two.log_probability)
