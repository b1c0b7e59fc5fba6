from collections import defaultdict

import pytest

from tailweave.llm import linededup

BIG = "".join(chr(c) for c in range(65, 91))
FOLD = str.maketrans(BIG, BIG.lower())


def brute(rows, least_length=10, least=2):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(FOLD)
    found = defaultdict(set)
    for id_, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_length:
                found[key(line)].add(id_)
    last = float("inf")
    out = []
    for id_, text in rows:
        lines = (text or "").split("\n")
        first = {k: min(last if d is None else d for d in found[k]) for k in map(key, lines) if len(found.get(k, ())) >= least}
        kept = [x for x in lines if key(x) not in first or first[key(x)] == (last if id_ is None else id_)]
        out.append((id_, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def got(df, *names):
    return sorted((tuple(r) for r in df.select("doc_id", "text", *(names or ("n_lines", "n_dropped"))).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    import random

    rng = random.Random(9)
    pool = [f"  Line number {k} of the POOL\t" for k in range(40)] + ["", "short", " \r", "É" * 10, "é" * 10, "\x85 nbsp line here  ", "line number 3 of the pool"]
    return [(k // 2 if k > 150 else k, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {k} {j} {rng.random()}" for j in range(rng.randint(0, 12)))) for k in range(200)]


@pytest.mark.parametrize("least", [2, 3])
def test_like_brute_force(spark, texts, least):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert got(linededup.without_repeated_lines(docs, least_documents=least)) == brute(texts, least=least)


def test_heavy_lines_are_met_by_broadcast(spark, texts, monkeypatch):
    from tailweave.functions import heavy

    monkeypatch.setattr(heavy, "LEAST_HEAVY", 3)
    monkeypatch.setattr(heavy, "MOST_HEAVY", 50)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert got(linededup.without_repeated_lines(docs)) == brute(texts)


def test_awkward_rows(spark, awkward, clashing, nothing):
    more = spark.createDataFrame([(20, "a line that repeats\nmine", None, None, 1), (21, "A line that repeats \nmine too", None, None, 1), (None, "a LINE that repeats\nno id", None, None, 1)], awkward.schema)
    docs = awkward.unionByName(more)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(linededup.without_repeated_lines(docs)) == brute(rows)
    wide = docs.selectExpr("*", "1 as n_lines", "2 as n_dropped", "3 as at", "4 as h1", "5 as dropped", "6 as __id")
    out = linededup.without_repeated_lines(wide)
    assert out.columns == [*wide.columns, "n_lines_", "n_dropped_"]
    assert got(out, "n_lines_", "n_dropped_") == brute(rows)
    assert linededup.without_repeated_lines(nothing).count() == 0


def test_long_texts(spark):
    lines = "\n".join(f"line of a long text {k % 5000}" for k in range(60_000))
    rows = [(1, lines), (2, lines + "\nand one of its own"), (3, "x" * 300_000)]
    assert got(linededup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
