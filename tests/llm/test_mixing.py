import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from tailweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, weights=(1, 2, 3)):
    """The mix by one sorted list of all parts."""
    rows = [(i, s, len(WORD.findall(t or ""))) for i, t, s in docs]
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    size = {n: sum(x for _, s, x in rows if s == n) for n in names}
    weight = {n: weights[k % 3] for k, n in enumerate(names)}
    rest, open_, target = Fraction(sum(size.values())), set(names), {}
    while open_:
        total = sum(weight[n] for n in open_)
        full = {n for n in open_ if rest * weight[n] / total > 3 * size[n]}
        for n in full or open_:
            target[n] = Fraction(3 * size[n]) if full else rest * weight[n] / total
        rest -= sum(3 * size[n] for n in full)
        open_ = open_ - full if full else set()
    parts = []
    for k, n in enumerate(names):
        own = sorted((int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:15], 16), -1 if i is None else i, x, j) for j, (i, s, x) in enumerate(rows) if s == n)
        at = 0
        for _ in range(3):
            for *_, x, j in own:
                at += x
                if x and target[n]:
                    parts.append((at / float(target[n]), k, x, j))
    taken, budget = defaultdict(int), sum(size.values())
    for _, _, words, j in sorted(parts):
        taken[j] += min(words, budget)
        budget -= min(words, budget)
    return [(rows[j][0], rows[j][2], size[rows[j][1]], float(target[rows[j][1]]), taken[j]) for j in range(len(rows))]


def result(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=key), key


@pytest.mark.parametrize("ranges,sorted_rows,alike", [(mixing.RANGES, mixing.SORTED, mixing.ALIKE), (4, 3, 2)])
def test_like_brute_force(spark, rng, monkeypatch, ranges, sorted_rows, alike):
    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "ALIKE", alike)
    monkeypatch.setattr(mixing, "SORTED", sorted_rows)
    docs = [(k, " ".join("w" for _ in range(rng.choice([0, 1, 3, 10, 200]))), rng.choice(["a", "a", "a", "B", "é", None, "z"])) for k in range(150)] + [(500, "one two", "tiny"), (None, "no id", "a"), (7, "again", "a")]
    docs += [(None, "many rows alike", "z")] * 9 + [(None, "many rows of one size", "z")] * 5 + [(600, None, "z")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got, key = result(mixing.mix_sources(df))
    want = sorted(brute(docs), key=key)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))


def test_targets_are_met(spark):
    """But for the document at the cut, and a part of the rest that all of these leave over."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix_sources(df).toPandas()
    got = found.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), size=("size", "sum"), longest=("size", "max"))
    assert ((got.taken - got.target).abs() <= got.longest).all() and got.taken.sum() == got["size"].sum()
    assert ((got.taken - got.target).abs() / got.target).mean() < 0.05
    assert (found.taken % found["size"].clip(lower=1) > 0).sum() <= 1  # whole documents but one


def test_resharing():
    got = {s.name: s.target for s in mixing.targets({"a": 1, "b": 100, "c": 50, None: 2})}
    assert got["a"] == 3 and got[None] == 6 and sum(got.values()) == pytest.approx(153)
    assert got["b"] / got["c"] == pytest.approx(2 / 3)
    assert [s.target for s in mixing.targets({"x": 0, "y": 0})] == [0, 0]


def test_awkward_rows(awkward, clashing, nothing):
    for docs in (awkward, clashing):
        got = mixing.mix_sources(docs).toPandas()
        assert len(got) == awkward.count() and (got.taken <= 3 * got["size"]).all() and got.taken.sum() == got["size"].sum()
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mix_sources(awkward.where("text is null")).toPandas().taken.sum() == 0
    one, two = ({tuple(r) for r in mixing.mix_sources(d).collect()} for d in (awkward, awkward.repartition(3)))
    assert one == two
